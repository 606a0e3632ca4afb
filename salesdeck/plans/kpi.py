"""The one-row key-figure strip, from one pass over the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesdeck.functions.measures import not_cancelled, not_cancelled_pandas, tier, whole_days_between
from salesdeck.functions.money import div_half_up, round_half_up, safe_ratio
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.customers import _segmented
from salesdeck.plans.facts import order_totals
from salesdeck.plans.people import _reps
from salesdeck.sources.star import Star


def _platinum(star: Star, params: Params) -> DataFrame:
    s = _segmented(star, params, False)
    return s.agg(F.sum(F.when(F.col("segment") == "Platinum", F.col("profit_cents"))).alias("plat_cents"),
                 F.sum("profit_cents").alias("all_cents"))


def platinum_share(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Platinum tier's share of profit (cancelled excluded), in percent; NULL
    when there is no profit at all."""
    p = _platinum(star, params)
    return p.select((F.col("plat_cents") / F.lit(100.0)).alias("platinum_profit"),
                    (F.col("all_cents") / F.lit(100.0)).alias("total_profit"),
                    round_half_up(safe_ratio(F.col("plat_cents") * F.lit(100), F.col("all_cents")), 2)
                    .alias("platinum_share_pct"))


def _customer_figures(star: Star, params: Params) -> DataFrame:
    """One row per known customer with an order, every scope at once: profit of
    all orders, profit of the orders that are not cancelled, and whether the
    last order of any status is long past.  An order without priced lines
    counts for the last one only."""
    kept = not_cancelled_pandas if params.keep_null_status else not_cancelled
    in_scope = F.col("priced") & F.coalesce(kept("status", params.cancelled), F.lit(False))
    totals = order_totals(star).select("orderNumber", "profit_cents", F.lit(True).alias("has_lines"))
    orders = star.orders.join(totals, "orderNumber", "left").withColumn("priced", F.coalesce("has_lines", F.lit(False)))
    per = orders.groupBy("customerNumber").agg(
        F.max("orderDate").alias("last_order_date"),
        F.sum("profit_cents").alias("all_cents"), F.count_if("priced").alias("all_orders"),
        F.sum(F.when(in_scope, F.col("profit_cents"))).alias("kept_cents"), F.count_if(in_scope).alias("kept_orders"))
    days = whole_days_between(F.lit(params.as_of), F.col("last_order_date"))
    return per.join(star.customers.select("customerNumber", F.col("salesRepEmployeeNumber").alias("employeeNumber")), "customerNumber") \
        .withColumn("dormant", F.coalesce(days > params.dormant_days, F.lit(False)))


def kpi_strip(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Total profit (millions, over the reps' base join), top rep, top office,
    number of dormant customers, Platinum share.

    The reps count orders of every status, the tiers leave cancelled ones out:
    both scopes are conditional sums of one per-customer aggregate, which then
    rolls up to reps (customers without one in a row of their own), offices
    and the single row.  Each level moves aggregated rows only."""
    c = _customer_figures(star, params)
    tiered = F.col("kept_orders") > 0
    platinum = tiered & (tier("kept_cents", params.tiers) == "Platinum")
    per_rep = c.groupBy("employeeNumber").agg(
        F.sum("all_cents").alias("profit_cents"), F.sum("all_orders").alias("orders"),
        F.count_if("dormant").alias("dormant"),
        F.sum(F.when(platinum, F.col("kept_cents"))).alias("plat_cents"),
        F.sum(F.when(tiered, F.col("kept_cents"))).alias("tier_cents"))
    reps = _reps(star).select("employeeNumber", "officeCode", F.col("office").alias("city"),
                              F.concat("firstName", F.lit(" "), "lastName").alias("sales_rep"))
    sells = F.col("officeCode").isNotNull() & (F.col("orders") > 0)
    # rep order: higher profit first, then the lower employee number
    best = F.struct("profit_cents", (-F.col("employeeNumber")).alias("neg_emp"), "sales_rep")
    per_office = per_rep.join(reps, "employeeNumber", "left").groupBy("officeCode", "city").agg(
        F.sum(F.when(sells, F.col("profit_cents"))).alias("office_cents"), F.count_if(sells).alias("reps"),
        F.max(F.when(sells, best)).alias("best_rep"),
        F.sum("dormant").alias("dormant"), F.sum("plat_cents").alias("plat_cents"), F.sum("tier_cents").alias("tier_cents"))
    a = per_office.agg(
        F.sum("office_cents").alias("c"),
        F.max("best_rep").alias("best_rep"),
        # highest profit; on a tie the smallest office code (the app's sort order)
        F.min_by("city", F.when(F.col("reps") > 0, F.struct(-F.col("office_cents"), F.col("officeCode")))).alias("top_office"),
        F.coalesce(F.sum("dormant"), F.lit(0)).alias("dormant"),
        F.sum("plat_cents").alias("plat_cents"), F.sum("tier_cents").alias("tier_cents"))
    return a.select(
        # cents -> millions of dollars, half-up to 2 places: exact integer division
        (div_half_up(F.col("c"), 1_000_000) / F.lit(100.0)).alias("total_profit_m"),
        F.col("best_rep.sales_rep").alias("top_rep"), "top_office",
        F.col("dormant").alias("num_dormant"),
        round_half_up(safe_ratio(F.col("plat_cents") * F.lit(100), F.col("tier_cents")), 2).alias("platinum_share_pct"))
