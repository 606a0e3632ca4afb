"""Inventory and product analyses (described but not coded by the reference; the
exact definitions here are ours: units ordered over units in stock, revenue
per product, products above the catalogue on both counts, top customers by
profit).

Lines are summed per product first; products are joined to the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesdeck.functions.money import dollars, round_half_up, safe_ratio
from salesdeck.operators.ranking import present, top_k
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.facts import customer_totals, product_line_sums, summed_profit_cents
from salesdeck.sources.star import Star


def _stock(star: Star) -> DataFrame:
    """Ordered products with their units, stock and revenue."""
    t = product_line_sums(star).select("productCode", F.col("units").alias("units_ordered"), "revenue_cents")
    p = star.products.select("productCode", "productName", "productLine", "quantityInStock")
    return t.join(p, "productCode")


def _stock_ratio(stock: DataFrame) -> DataFrame:
    return stock.select(
        "productCode", "productName", "productLine", "units_ordered", "quantityInStock",
        round_half_up(safe_ratio(F.col("units_ordered"), F.col("quantityInStock")), 2)
        .alias("low_stock_ratio"))


def low_stock(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Every ordered product by urgency: highest ratio of units ordered to
    units in stock first, no stock at all (NULL ratio) last."""
    return _stock_ratio(_stock(star)).transform(
        present, params, F.desc_nulls_last("low_stock_ratio"), "productCode")


def product_rows(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Revenue and profit of every catalogue product, by a correlated scalar
    subquery as written in SQL, over the per-product sums.  Catalyst rewrites
    it into a left outer join, so no per-product probe runs.  A product that
    was never ordered has NULL revenue and profit."""
    spark = star.products.sparkSession
    q = """
      SELECT productCode, productName, productLine, s.revenue_cents / 100.0D AS revenue,
             (s.revenue_cents - s.priced_units * buy_price_cents) / 100.0D AS profit
        FROM (SELECT p.*, (SELECT max(struct(t.revenue_cents, t.priced_units))
                             FROM {sums} t WHERE t.productCode = p.productCode) AS s
                FROM {products} p)
    """
    return spark.sql(q, sums=product_line_sums(star), products=star.products)


def product_performance(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Every catalogue product by revenue, highest first (never-ordered last)."""
    return product_rows(star, params).transform(present, params, F.desc_nulls_last("revenue"), "productCode")


def priority_restock(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Products to restock first: in the whole catalogue, those that sell
    ``restock_ratio`` times faster against their stock than the catalogue does
    and earn ``restock_revenue`` times an ordered product's mean revenue.

    The reference's two chained lists are two selections over one per-product
    aggregate, intersected by a semi join; the catalogue's figures are one row
    from the same aggregate."""
    stock = _stock(star)
    overall = stock.agg(
        (F.sum("units_ordered").cast("double") / F.sum("quantityInStock").cast("double")).alias("pace"),
        (F.sum("revenue_cents").cast("double") / F.count("revenue_cents")).alias("mean_cents"))
    pace, mean = overall.select("pace").scalar(), overall.select("mean_cents").scalar()
    ratio = safe_ratio(F.col("units_ordered"), F.col("quantityInStock"))
    urgent = _stock_ratio(stock.filter(ratio >= F.lit(params.restock_ratio) * pace))
    earners = stock.filter(F.col("revenue_cents").cast("double") >= F.lit(params.restock_revenue) * mean)
    return urgent.join(earners.select("productCode"), "productCode", "left_semi").transform(
        present, params, F.desc_nulls_last("low_stock_ratio"), "productCode")


def vip_customers(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Top customers by profit, with their details: rank first, then join the
    ten rows to the customer dimension."""
    t = customer_totals(star, params, True).select(
        "customerNumber", dollars("profit_cents").alias("total_profit"))
    top = top_k(t, [F.desc("total_profit"), F.asc("customerNumber")], params.top_vip)
    c = star.customers.select("customerNumber", "customerName", "city", "country")
    return top.join(c, "customerNumber").select(
        "customerNumber", "customerName", "city", "country", "total_profit")
