"""Revenue and profit over time and by product line (cancelled orders excluded)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesdeck.functions.money import div_half_up, dollars, round_half_up, safe_ratio
from salesdeck.operators.ranking import present
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.facts import order_totals, orders_in_scope, product_line_sums, summed_profit_cents
from salesdeck.sinks.refresh import add_batch, read_months
from salesdeck.sources.star import Star
from salesdeck.sources.stored import scratch

#: Shared facts at the grain of an order, which hold for a part of the orders too.
BATCH_FACTS = ("order_totals", "priced_lines")


def _order_months(star: Star, params: Params) -> DataFrame:
    """Revenue/profit per non-cancelled order with its order date (order grain)."""
    o = orders_in_scope(star, params, False).select("orderNumber", "orderDate")
    return order_totals(star).join(o, "orderNumber")


def monthly_revenue(star: Star, params: Params = DEFAULT) -> DataFrame:
    """SQL form: year and month as text ('2003', '01')."""
    t = _order_months(star, params)
    return t.groupBy(F.date_format("orderDate", "yyyy").alias("year"),
                     F.date_format("orderDate", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("num_orders"),
        dollars(F.sum("revenue_cents")).alias("revenue"),
        dollars(F.sum("profit_cents")).alias("profit"),
    ).transform(present, params, "year", "month")


def _monthly_cents(star: Star, params: Params) -> DataFrame:
    t = _order_months(star, params)
    return t.groupBy(F.trunc("orderDate", "MM").alias("period")).agg(
        F.count(F.lit(1)).alias("num_orders"),
        F.sum("revenue_cents").alias("revenue_cents"),
        F.sum("profit_cents").alias("profit_cents"))


def monthly_rows(star: Star, params: Params = DEFAULT) -> DataFrame:
    """App form: year text, month number, and the first day of the month."""
    return _monthly_cents(star, params).select(
        F.year("period").cast("string").alias("year"),
        F.month("period").cast("long").alias("month"),
        "period", "num_orders", dollars("revenue_cents").alias("revenue"),
        dollars("profit_cents").alias("profit"))


def monthly_revenue_period(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Monthly rows (app form) in period order."""
    return monthly_rows(star, params).transform(present, params, "period")


def monthly_refreshed(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Monthly rows and distinct customers from a mart that was built in two
    batches: orders up to a day in the middle of a month, then the later ones."""
    spark = star.orders.sparkSession
    path = scratch(spark, "monthly")
    late = F.col("orderDate") >= F.lit(params.second_batch)
    for name, mine in (("first", ~late), ("second", late)):
        batch = replace(star, orders=star.orders.filter(mine), memo={k: v for k, v in star.memo.items() if k in BATCH_FACTS})
        add_batch(batch, path, name, params)
    return read_months(spark, path).transform(present, params, "year", "month")


def _line_year_totals(star: Star, params: Params) -> DataFrame:
    """Lines meet their order once, are summed per year and product, and only
    those sums meet the products and roll up to product lines."""
    o = orders_in_scope(star, params, False).select(
        "orderNumber", F.date_format("orderDate", "yyyy").alias("year"))
    sums = product_line_sums(star, "year", lines=star.orderdetails.join(o, "orderNumber"))
    p = star.products.select("productCode", "productLine", "buy_price_cents")
    return sums.join(p, "productCode").groupBy("year", "productLine").agg(
        F.sum("revenue_cents").alias("revenue_cents"),
        F.sum(summed_profit_cents()).alias("profit_cents"))


def product_line_by_year(star: Star, params: Params = DEFAULT) -> DataFrame:
    t = _line_year_totals(star, params)
    return t.select("year", "productLine", dollars("revenue_cents").alias("revenue"),
                    dollars("profit_cents").alias("profit")) \
            .transform(present, params, "year", F.desc("profit"), "productLine")


def product_line_pivot(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Product line x year profit in thousands.  The listed years have a
    column each, so the schema is fixed and no extra pass collects the distinct
    years; whatever falls in other years is in ``profit_other_years``, so a
    row always adds up to its product line's profit."""
    years = [str(y) for y in params.pivot_years]
    other = "other_years"
    t = _line_year_totals(star, params).withColumn(
        "column", F.when(F.col("year").isin(years), F.col("year")).otherwise(other))
    p = t.groupBy("productLine").pivot("column", [*years, other]).agg(F.sum("profit_cents"))
    p = p.select("productLine", *[(dollars(F.col(y)) / F.lit(1000.0)).alias(f"profit_{y}") for y in [*years, other]])
    return p.transform(present, params, F.desc_nulls_last(f"profit_{params.pivot_sort_year}"), "productLine")


def monthly_by_year_series(star: Star, params: Params = DEFAULT) -> DataFrame:
    """One row per year with its months and revenues as ordered lists (one chart
    trace per year).  A year holds at most 12 points: the group is bounded."""
    m = monthly_rows(star, params)
    g = m.groupBy("year").agg(F.sort_array(F.collect_list(F.struct("month", "revenue"))).alias("pts"))
    return g.select("year",
                    F.transform("pts", lambda p: p["month"]).alias("months"),
                    F.transform("pts", lambda p: p["revenue"]).alias("revenues"),
                    F.size("pts").cast("long").alias("n_points")).transform(present, params, "year")


def monthly_margin_proxy(star: Star, params: Params = DEFAULT) -> DataFrame:
    """The web page's monthly table: newest first, 'profit' shown as 40% of
    revenue rounded to whole dollars (exactly: 4/1000 of the cents, half-up).
    Named ``approx_profit`` because it is not the profit."""
    m = _monthly_cents(star, params)
    return m.select(F.year("period").cast("string").alias("year"),
                    F.date_format("period", "yyyy-MM").alias("period_label"),
                    dollars("revenue_cents").alias("revenue"),
                    div_half_up(F.col("revenue_cents") * F.lit(4), 1000).alias("approx_profit"),
                    "period").transform(present, params, F.desc("period")).drop("period")


def seasonal_peak(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Per year: the month of highest revenue and its ratio to January."""
    m = monthly_rows(star, params)
    g = m.groupBy("year").agg(
        F.max_by("month", F.struct("revenue", -F.col("month"))).alias("peak_month"),
        F.max("revenue").alias("peak_revenue"),
        F.max(F.when(F.col("month") == 1, F.col("revenue"))).alias("january_revenue"))
    return g.select("year", "peak_month", "peak_revenue", "january_revenue",
                    round_half_up(safe_ratio(F.col("peak_revenue"), F.col("january_revenue")), 2)
                    .alias("peak_to_january")).transform(present, params, "year")


def product_line_share(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Share of total profit per product line, in percent.  The total is a
    one-row aggregate (scalar subquery), not a window over the mart."""
    t = _line_year_totals(star, params).groupBy("productLine").agg(
        F.sum("profit_cents").alias("profit_cents"))
    total = t.agg(F.sum("profit_cents")).scalar()
    return t.select("productLine", dollars("profit_cents").alias("profit"),
                    round_half_up(safe_ratio(F.col("profit_cents") * F.lit(100), total), 2)
                    .alias("share_pct")).transform(present, params, F.desc("profit"), "productLine")


def product_line_rank(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Rank of each product line within its year (1 = most profitable)."""
    t = _line_year_totals(star, params).select(
        "year", "productLine", dollars("profit_cents").alias("profit"))
    w = Window.partitionBy("year").orderBy(F.desc("profit"))
    wl = Window.partitionBy("year").orderBy(F.asc("profit"))
    return t.select("year", "productLine", "profit",
                    F.rank().over(w).cast("long").alias("rank_desc"),
                    (F.rank().over(wl) == 1).alias("is_weakest")).transform(present, params, "year", "rank_desc", "productLine")


def year_to_date(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Same months (January .. ytd_through_month) of every year, and the change
    against the previous year.  One row per year: the window is bounded."""
    t = _order_months(star, params).filter(F.month("orderDate") <= params.ytd_through_month)
    y = t.groupBy(F.year("orderDate").cast("string").alias("year")).agg(
        dollars(F.sum("revenue_cents")).alias("revenue_ytd"),
        dollars(F.sum("profit_cents")).alias("profit_ytd"),
        F.count(F.lit(1)).alias("orders_ytd"))
    prev = F.lag("revenue_ytd").over(Window.orderBy("year"))
    return y.select("year", "revenue_ytd", "profit_ytd", "orders_ytd",
                    prev.alias("prev_revenue_ytd"),
                    round_half_up(safe_ratio(F.col("revenue_ytd") - prev, prev) * F.lit(100), 1)
                    .alias("growth_pct")).transform(present, params, "year")


def distinct_years(star: Star, params: Params = DEFAULT) -> DataFrame:
    return star.orders.select(F.date_format("orderDate", "yyyy").alias("year")).distinct()
