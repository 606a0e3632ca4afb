"""Single operators of the reference, each exercised on its own over the
whole tables (filters, joins, aggregates, scalar functions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesdeck.functions.labels import grouped_label, thousands_label
from salesdeck.functions.measures import days_between, full_name, not_cancelled, whole_days_between
from salesdeck.functions.money import cents_ratio, div_half_up, dollars, round_half_up
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.facts import customer_totals, order_totals, priced_lines, product_line_sums
from salesdeck.plans.people import rep_rows
from salesdeck.sources.star import Star


# ------------------------------------------------------------- predicates

def filter_not_cancelled(star: Star, params: Params = DEFAULT) -> DataFrame:
    """``status <> cancelled``: a NULL status is dropped too (SQL rule)."""
    return star.orders.filter(not_cancelled("status", params.cancelled)) \
               .select("orderNumber", "customerNumber", "orderDate", "status")


def filter_shipped(star: Star, params: Params = DEFAULT) -> DataFrame:
    return star.orders_shipped.filter(F.col("shippedDate").isNotNull()) \
               .select("orderNumber", "orderDate", "shippedDate", "status")


# ------------------------------------------------------------------ joins

def join_inner(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Inner equi join on differently named keys (customer -> its rep)."""
    e = star.employees.select("employeeNumber", full_name("firstName", "lastName").alias("sales_rep"))
    c = star.customers.select("customerNumber", "customerName", "salesRepEmployeeNumber")
    return c.join(e, c.salesRepEmployeeNumber == e.employeeNumber).select(
        "customerNumber", "customerName", "employeeNumber", "sales_rep")


def join_left(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Left outer join of an aggregate to a dimension: every customer, with
    its number of orders (NULL when it never ordered)."""
    n = star.orders.groupBy("customerNumber").agg(F.count(F.lit(1)).alias("num_orders"))
    return star.customers.select("customerNumber", "customerName").join(n, "customerNumber", "left")


# ------------------------------------------------------------- aggregates

def _status_totals(star: Star) -> DataFrame:
    return order_totals(star).join(star.orders.select("orderNumber", "status"), "orderNumber")


def agg_sum(star: Star, params: Params = DEFAULT) -> DataFrame:
    t = _status_totals(star)
    return t.groupBy("status").agg(dollars(F.sum("revenue_cents")).alias("revenue"),
                                   dollars(F.sum("profit_cents")).alias("profit"))


def agg_count(star: Star, params: Params = DEFAULT) -> DataFrame:
    return star.orders.groupBy("status").agg(F.count(F.lit(1)).alias("num_orders"))


def agg_count_distinct(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Two exact distinct counts per product line.  The product lines of an
    order are collected as a set (partly on the map side, and no larger than
    the order), which de-duplicates before the shuffle by order; the join to
    orders uses the same partitioning.  The order fixes the customer, so
    distinct orders become a plain count."""
    lines = priced_lines(star, with_line=True).groupBy("orderNumber").agg(
        F.collect_set(F.struct("productLine")).alias("lines"))  # a struct, so that NULL is kept
    o = star.orders.select("orderNumber", "customerNumber")
    d = lines.join(o, "orderNumber").select("customerNumber", F.explode("lines").alias("l")) \
             .select("customerNumber", "l.productLine")
    return d.groupBy("productLine").agg(
        F.count(F.lit(1)).alias("num_orders"),
        F.countDistinct("customerNumber").alias("num_customers"))


def agg_avg(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Averages over lines from sums and counts per product, rolled up."""
    t = product_line_sums(star).join(star.products.select("productCode", "productLine"), "productCode")
    return t.groupBy("productLine").agg(
        cents_ratio(F.sum("revenue_cents"), F.sum("revenues"), 2).alias("avg_line_revenue"),
        round_half_up(F.try_divide(F.sum("units").cast("double"), F.sum("quantities")), 1).alias("avg_quantity"))


def agg_min_max(star: Star, params: Params = DEFAULT) -> DataFrame:
    p = star.products
    return p.groupBy("productLine").agg(
        dollars(F.min("buy_price_cents")).alias("min_buy_price"),
        dollars(F.max("buy_price_cents")).alias("max_buy_price"),
        F.min("quantityInStock").cast("long").alias("min_stock"),
        F.max("quantityInStock").cast("long").alias("max_stock"))


# ------------------------------------------------------- scalar functions

def fn_concat(star: Star, params: Params = DEFAULT) -> DataFrame:
    off = star.offices.select("officeCode", "city", "territory")
    e = star.employees.join(off, "officeCode")
    return e.select("employeeNumber", full_name("firstName", "lastName").alias("employee"),
                    F.concat("city", F.lit(" / "), "territory").alias("office_label"))


def fn_year_month(star: Star, params: Params = DEFAULT) -> DataFrame:
    d = F.col("orderDate")
    return star.orders.select("orderNumber",
                              F.date_format(d, "yyyy").alias("year"),
                              F.date_format(d, "MM").alias("month"),
                              F.year(d).cast("long").alias("year_num"),
                              F.month(d).cast("long").alias("month_num"))


def fn_month_start(star: Star, params: Params = DEFAULT) -> DataFrame:
    return star.orders.select("orderNumber", "orderDate", F.trunc("orderDate", "MM").alias("period"))


def fn_days_between(star: Star, params: Params = DEFAULT) -> DataFrame:
    s = star.orders_shipped.filter(F.col("shippedDate").isNotNull())
    return s.select("orderNumber",
                    days_between("shippedDate", "orderDate").alias("days_fractional"),
                    whole_days_between("shippedDate", "orderDate").alias("days_whole"),
                    whole_days_between(F.lit(params.as_of), "orderDate").alias("days_to_as_of"))


def fn_round(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Half-up rounding to 2, 1 and 0 places of the average profit per order
    (exact: integer cents divided with half-up rounding, no double step)."""
    t = customer_totals(star, params, False)
    c, n = "profit_cents", "total_orders"
    return t.select("customerNumber",
                    cents_ratio(c, n, 2).alias("avg_order_profit_2"),
                    cents_ratio(c, n, 1).alias("avg_order_profit_1"),
                    div_half_up(c, F.col(n) * F.lit(100)).alias("avg_order_profit_0"))


def fn_labels(star: Star, params: Params = DEFAULT) -> DataFrame:
    reps = rep_rows(star, params)
    p = F.col("total_profit")
    return reps.select("employeeNumber", thousands_label(p).alias("profit_k_label"),
                       grouped_label(p).alias("profit_label"))
