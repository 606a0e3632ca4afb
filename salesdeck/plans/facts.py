"""Shared plan fragments at three grains: line, order, customer (and rep).

Eager aggregation: the reference joins six tables down to the order line and
then counts DISTINCT customers and orders per rep.  Here the lines are summed
to one row per order first, orders to one row per customer, customers to one
row per rep.  Every key is unique at its own grain (orderNumber in orders,
customerNumber in customers, employeeNumber in employees), so each
``COUNT(DISTINCT ...)`` of the reference becomes a plain count or a sum of
counts: no Expand, no (group, distinct-key) shuffle, and every shuffle after
the first moves pre-aggregated rows instead of lines.

A key that holds a third of all rows (one customer, one rep, one product) is
harmless to these aggregations: partial aggregation collapses it map-side.
Product-keyed analyses sum the lines per product before they join products.
Only order-keyed ones need a price on every line first; their join of lines to
products is left to AQE, which splits oversized partitions of the line side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesdeck.functions.measures import line_profit_cents, not_cancelled, not_cancelled_pandas
from salesdeck.params import Params
from salesdeck.sources.star import Star


def priced_lines(star: Star, with_line: bool = False) -> DataFrame:
    """Order lines joined to their product: revenue and profit per line, in cents."""
    out = ["orderNumber", "productCode", "quantityOrdered", "revenue_cents", "profit_cents"] + (["productLine"] if with_line else [])
    if "priced_lines" in star.memo:  # priced when they were stored
        return star.memo["priced_lines"].select(*out)
    cols = ["productCode", "buy_price_cents"] + (["productLine"] if with_line else [])
    lines = star.orderdetails.join(star.products.select(*cols), "productCode")
    return lines.withColumn("profit_cents", line_profit_cents()).select(*out)


def product_line_sums(star: Star, *keys: str, lines: DataFrame | None = None) -> DataFrame:
    """Lines summed to one row per product (and ``keys``) before any product
    column is looked up: units, priced units, lines and revenue.  The sums are
    partial on the map side, so a hot product is a handful of rows when the
    shuffle starts, and the product dimension meets aggregated rows only."""
    priced = F.col("revenue_cents").isNotNull()
    return (star.orderdetails if lines is None else lines).groupBy(*keys, "productCode").agg(
        F.sum("quantityOrdered").cast("long").alias("units"),
        F.count("quantityOrdered").alias("quantities"),
        F.sum(F.when(priced, F.col("quantityOrdered"))).cast("long").alias("priced_units"),
        F.sum("revenue_cents").alias("revenue_cents"),
        F.count("revenue_cents").alias("revenues"))


def summed_profit_cents():
    """Profit of summed lines: every line of a product has the same buying price."""
    return F.col("revenue_cents") - F.col("priced_units") * F.col("buy_price_cents")


def _memo(star: Star, key: str, build):
    """A fact materialised by a refresh job, else the plan that computes it."""
    return star.memo[key] if key in star.memo else build()


def order_totals(star: Star) -> DataFrame:
    """One row per order with at least one priced line."""
    return _memo(star, "order_totals", lambda: _order_totals(star))


def _order_totals(star: Star) -> DataFrame:
    return priced_lines(star).groupBy("orderNumber").agg(
        F.sum("revenue_cents").alias("revenue_cents"),
        F.sum("profit_cents").alias("profit_cents"))


def orders_in_scope(star: Star, params: Params, include_cancelled: bool) -> DataFrame:
    o = star.orders
    if include_cancelled:
        return o
    keep = not_cancelled_pandas if params.keep_null_status else not_cancelled
    return o.filter(keep("status", params.cancelled))


def customer_totals(star: Star, params: Params, include_cancelled: bool) -> DataFrame:
    """customerNumber, profit_cents, revenue_cents, total_orders (orders with priced lines)."""
    key = f"customer_totals/{include_cancelled}/{params.cancelled}/{params.keep_null_status}"
    return _memo(star, key, lambda: _customer_totals(star, params, include_cancelled))


def _customer_totals(star: Star, params: Params, include_cancelled: bool) -> DataFrame:
    o = orders_in_scope(star, params, include_cancelled).select("orderNumber", "customerNumber")
    return order_totals(star).join(o, "orderNumber").groupBy("customerNumber").agg(
        F.sum("profit_cents").alias("profit_cents"),
        F.sum("revenue_cents").alias("revenue_cents"),
        F.count(F.lit(1)).alias("total_orders"))


def rep_totals(star: Star, params: Params) -> DataFrame:
    """employeeNumber, total_customers, total_orders, profit_cents (all statuses)."""
    return _memo(star, "rep_totals", lambda: _rep_totals(star, params))


def _rep_totals(star: Star, params: Params) -> DataFrame:
    c = star.customers.select("customerNumber", F.col("salesRepEmployeeNumber").alias("employeeNumber"))
    return customer_totals(star, params, True).join(c, "customerNumber").groupBy("employeeNumber").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("total_orders").alias("total_orders"),
        F.sum("profit_cents").alias("profit_cents"))
