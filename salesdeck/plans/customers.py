"""Customer value tiers, tier summaries, dormant customers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesdeck.functions.labels import percent_label, truncate, truncate_ellipsis
from salesdeck.functions.measures import TIERS, tier, whole_days_between
from salesdeck.functions.money import avg_dollars, dollars, round_half_up, safe_ratio
from salesdeck.operators.joins import join_bounded
from salesdeck.operators.paging import last_key, next_page, store_pages, stored_page
from salesdeck.operators.ranking import present, top_k
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.facts import customer_totals
from salesdeck.sources.star import Star
from salesdeck.sources.stored import scratch

# Display colour per tier, and the colour of "no tier" (fixed values of the reference).
TIER_COLOURS = {"Platinum": "#ffd700", "Gold": "#50c8a0", "Silver": "#4a90e2", "Bronze": "#ff7c7c"}
NO_TIER_COLOUR = "#9aa0cc"


def _segmented(star: Star, params: Params, include_cancelled: bool) -> DataFrame:
    """Aggregate first (per customer), then join the customer dimension."""
    t = customer_totals(star, params, include_cancelled)
    c = star.customers.select("customerNumber", "customerName", "city", "country")
    return t.join(c, "customerNumber").select(
        "customerNumber", "customerName", "city", "country",
        "profit_cents", "total_orders", tier("profit_cents", params.tiers).alias("segment"))


def _segments_out(df: DataFrame, params: Params) -> DataFrame:
    return df.select("customerNumber", "customerName", "city", "country",
                     dollars("profit_cents").alias("total_profit"), "total_orders", "segment") \
             .transform(present, params, F.desc("total_profit"), "customerNumber")


def customer_segments_all(star: Star, params: Params = DEFAULT) -> DataFrame:
    """SQL form: every order status counts."""
    return _segments_out(_segmented(star, params, True), params)


def customer_segments(star: Star, params: Params = DEFAULT) -> DataFrame:
    """App form: cancelled orders excluded."""
    return _segments_out(_segmented(star, params, False), params)


def case_segment(star: Star, params: Params = DEFAULT) -> DataFrame:
    """The tier CASE alone, on per-customer profit (cancelled excluded)."""
    t = customer_totals(star, params, False)
    return t.select("customerNumber", dollars("profit_cents").alias("total_profit"),
                    tier("profit_cents", params.tiers).alias("segment"))


def _summary(seg: DataFrame) -> DataFrame:
    # averages over the cent-rounded customer profits, as the reference does
    return seg.groupBy("segment").agg(
        F.count(F.lit(1)).alias("num_customers"),
        avg_dollars("profit_cents", 2).alias("avg_profit"),
        dollars(F.sum("profit_cents")).alias("total_profit"),
        round_half_up(F.avg("total_orders"), 1).alias("avg_orders"))


def segment_summary_all(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Per tier (SQL form, every status): customers, avg/total profit, avg orders."""
    return _summary(_segmented(star, params, True)).transform(present, params, F.desc("total_profit"), "segment")


def segment_summary(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Per tier (app form, cancelled excluded): customers, avg/total profit, avg orders."""
    return _summary(_segmented(star, params, False)).transform(present, params, F.desc("total_profit"), "segment")


def tier_table(spark: SparkSession) -> DataFrame:
    """The fixed tier dimension: name and display order (4 rows)."""
    schema = T.StructType([T.StructField("segment", T.StringType(), False),
                           T.StructField("tier_order", T.LongType(), False)])
    return spark.createDataFrame([(s, i + 1) for i, s in enumerate(TIERS)], schema)


def _summary_ordered(star: Star, params: Params) -> DataFrame:
    s = _summary(_segmented(star, params, False))
    t = tier_table(star.orders.sparkSession)
    # s has at most 4 rows (one per tier): broadcast is bounded
    return join_bounded(t, s, "segment", "left").select(
        "segment", "tier_order",
        F.coalesce("num_customers", F.lit(0).cast("long")).alias("num_customers"),
        F.coalesce("total_profit", F.lit(0.0)).alias("total_profit"),
        "avg_profit", "avg_orders")


def segment_summary_ordered(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Summary in fixed tier order; a tier without customers keeps its row
    (count and total 0, averages NULL)."""
    return _summary_ordered(star, params).transform(present, params, "tier_order")


def segment_share(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Share of customers per tier, in percent (the donut).  The window spans
    the 4-row tier summary only."""
    s = _summary_ordered(star, params).select("segment", "tier_order", "num_customers")
    tot = F.sum("num_customers").over(Window.partitionBy())
    pct = round_half_up(safe_ratio(F.col("num_customers") * F.lit(100), tot), 1)
    return s.select("segment", "tier_order", "num_customers", pct.alias("share_pct"),
                    percent_label(pct).alias("share_label")).transform(present, params, "tier_order")


def segment_concentration(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Top tier against bottom tier: totals, counts and the ratio of totals."""
    s = _summary(_segmented(star, params, False))
    def pick(seg, col):
        return F.sum(F.when(F.col("segment") == seg, F.col(col)))
    g = s.agg(pick(TIERS[0], "total_profit").alias("top_total"),
              pick(TIERS[-1], "total_profit").alias("bottom_total"),
              pick(TIERS[0], "num_customers").alias("top_customers"),
              pick(TIERS[-1], "num_customers").alias("bottom_customers"))
    return g.select("*", round_half_up(safe_ratio(F.col("top_total"), F.col("bottom_total")), 2)
                    .alias("top_to_bottom_ratio"))


def segment_filter(star: Star, params: Params = DEFAULT, segment: str = "All") -> DataFrame:
    """The interactive tier filter: 'All' or one tier name; display columns."""
    s = _segmented(star, params, False)
    if segment != "All":
        s = s.filter(F.col("segment") == F.lit(segment))
    return s.select(F.col("customerName").alias("customer"), "city", "country",
                    dollars("profit_cents").alias("profit"),
                    F.col("total_orders").alias("orders"), "segment", "customerNumber") \
            .transform(present, params, F.desc("profit"), "customerNumber").drop("customerNumber")


def segment_code_lookup(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Tier -> display colour by map lookup, with a default for 'no tier'."""
    d = dormant_rows(star, params)
    cmap = F.create_map(*[F.lit(x) for kv in TIER_COLOURS.items() for x in kv])
    return d.select("customerNumber", "segment",
                    F.coalesce(F.try_element_at(cmap, F.col("segment")), F.lit(NO_TIER_COLOUR))
                    .alias("colour"))


def _page_table(star: Star, params: Params, sort_col: str, ascending: bool,
                segment: str) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The customer table under a tier filter, and its sort keys (the customer
    key breaks ties, so pages never overlap)."""
    s = _segments_out(_segmented(star, params, False), replace(params, ordered=False))
    if segment != "All":
        s = s.filter(F.col("segment") == F.lit(segment))
    return s, [(sort_col, ascending), ("customerNumber", True)]


def table_page(star: Star, params: Params = DEFAULT, page_no: int = 2,
               sort_col: str = "total_profit", ascending: bool = False,
               segment: str = "All", last: Row | None = None) -> DataFrame:
    """One page of the customer table under a user-chosen tier filter and sort.
    A page is sought past the last row of the page before: ``last``, which the
    view holds, or else found from page to page.  For a far page without one
    see ``table_page_stored``."""
    s, keys = _page_table(star, params, sort_col, ascending, segment)
    if last is not None:
        seen = F.struct(*[F.lit(last[k]).cast(s.schema[k].dataType).alias(k) for k, _ in keys])
        return next_page(s, keys, params.page_size, seen)
    shown = next_page(s, keys, params.page_size)
    for _ in range(page_no - 1):
        shown = next_page(s, keys, params.page_size, last_key(shown, keys))
    return shown


def table_page_stored(star: Star, params: Params = DEFAULT, sort_col: str = "total_profit",
                      ascending: bool = False, segment: str = "All") -> DataFrame:
    """Page ``deep_page`` of the same table, from its stored page index."""
    s, keys = _page_table(star, params, sort_col, ascending, segment)
    spark = star.orders.sparkSession
    path = scratch(spark, "pages")
    store_pages(s, keys, path)
    return stored_page(spark, path, params.deep_page, params.page_size)


def top_customers(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Head of the SQL-form segmentation (the printed top 20)."""
    s = _segments_out(_segmented(star, params, True), params)
    return top_k(s, [F.desc("total_profit"), F.asc("customerNumber")], params.top_customers)


# ---------------------------------------------------------------- dormant

def _last_orders(star: Star, params: Params) -> DataFrame:
    """Last order date per customer, every status counting as activity."""
    last = star.orders.groupBy("customerNumber").agg(F.max("orderDate").alias("last_order_date"))
    days = whole_days_between(F.lit(params.as_of), F.col("last_order_date"))
    return last.select("customerNumber", "last_order_date", days.alias("days_since")) \
               .filter(F.col("days_since") > params.dormant_days)


def dormant_customers(star: Star, params: Params = DEFAULT) -> DataFrame:
    """SQL form: customers whose last order is more than ``dormant_days`` old."""
    d = _last_orders(star, params)
    c = star.customers.select("customerNumber", "customerName", "city", "country")
    return d.join(c, "customerNumber").select(
        "customerNumber", "customerName", "city", "country", "last_order_date",
        F.col("days_since").alias("days_since_order")) \
        .transform(present, params, F.desc("days_since_order"), "customerNumber")


def dormant_rows(star: Star, params: Params = DEFAULT) -> DataFrame:
    """App form: plus tier and lifetime profit (cancelled excluded) by a left
    join on the key; a customer with only cancelled orders has NULL tier.

    The customer dimension is joined once: the dormant rows are already
    restricted to known customers, so joining the per-customer totals
    directly equals joining the (totals x customers) segmentation."""
    d = _last_orders(star, params)
    c = star.customers.select("customerNumber", "customerName", "city", "country")
    t = customer_totals(star, params, False).select(
        "customerNumber", tier("profit_cents", params.tiers).alias("segment"),
        dollars("profit_cents").alias("total_profit"))
    return d.join(c, "customerNumber").join(t, "customerNumber", "left").select(
        "customerNumber", "customerName", "city", "country", "last_order_date",
        "days_since", "segment", "total_profit")


def dormant_with_segment(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Dormant customers with tier and lifetime profit, longest inactive first."""
    return dormant_rows(star, params).transform(present, params, F.desc("days_since"), "customerNumber")


def dormant_top15(star: Star, params: Params = DEFAULT) -> DataFrame:
    """The dormant chart/table: longest inactive first, name cut to the label width."""
    d = dormant_rows(star, params)
    t = top_k(d, [F.desc("days_since"), F.asc("customerNumber")], params.top_dormant)
    return t.select(F.col("customerName"),
                    truncate(F.col("customerName"), params.label_width).alias("label"),
                    "country", "segment", "days_since", "total_profit")


def fn_truncate_label(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Label truncation on every dormant customer: app rule and web-page rule."""
    d = dormant_rows(star, params)
    text = F.concat(F.col("customerName"), F.lit(" ("), F.col("country"), F.lit(")"))
    return d.select("customerNumber", text.alias("label_full"),
                    truncate(text, params.label_width).alias("label_app"),
                    truncate_ellipsis(text, params.label_width).alias("label_web"))


def reengagement_target(star: Star, params: Params = DEFAULT) -> DataFrame:
    """The dormant customer with the highest lifetime profit."""
    d = dormant_rows(star, params)
    return top_k(d, [F.desc_nulls_last("total_profit"), F.asc("customerNumber")], 1).select(
        "customerNumber", "customerName", "country", "segment", "days_since", "total_profit")
