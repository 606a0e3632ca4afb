"""Adapter views: supplied test tables -> retail model (see FIXTURES.md §3).

offices      nation x region           (25 rows at every scale factor)
employees    supplier                  4-ary reporting tree, key 0 is the root
customers    customer x nation x region, rep assigned by key arithmetic
orders       orders                    status 'P' plays "Cancelled"
shipments    lineitem                  ship date of an order = its last line's
orderdetails lineitem                  money as integer cents
products     part                      stock = size * 10
productlines part                      its distinct types
payments     orders                    an order that isn't cancelled is paid in full

All expressions are built-ins; the only aggregates are the per-order ship date and the product lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cents_from_double(col: str):
    """Exact cents of a double that carries at most two decimals.

    ``x * 100`` lies within ~1e-9 of an integer, so rounding to the nearest
    integer has no ties: ``rint`` (a primitive ``Math.rint``) gives the same
    cents as ``round`` without ``round``'s per-row BigDecimal, which is a
    third of the cost of the line-table scan stage."""
    return F.rint(F.col(col) * F.lit(100.0)).cast("long")


def offices(nation: DataFrame, region: DataFrame) -> DataFrame:
    # nation and region are fixed 25- and 5-row tables: broadcasting them, and
    # the 25 offices made of them, is bounded (offices read from files are not)
    made = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("officeCode"),
        F.col("n_name").alias("city"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("territory"),
    )
    return F.broadcast(made)


def employees(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("employeeNumber"),
        F.split_part("s_name", F.lit("#"), F.lit(1)).alias("firstName"),
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("lastName"),
        F.when(k == 0, "President").when(k <= 4, "Sales Manager").otherwise("Sales Rep")
         .alias("jobTitle"),
        F.when(k == 0, F.lit(None).cast("long")).otherwise(F.expr("(s_suppkey - 1) div 4"))
         .alias("reportsTo"),
        F.col("s_nationkey").cast("string").alias("officeCode"),
    )


def customers(customer: DataFrame, nation: DataFrame, region: DataFrame,
              supplier: DataFrame) -> DataFrame:
    # number of reps in rotation: a one-row aggregate, evaluated once as a
    # scalar subquery (no join, nothing grows with the data)
    n_rot = supplier.agg(F.count(F.lit(1))).scalar() - F.lit(2)
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    k = F.col("c_custkey")
    return customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey).select(
        k.alias("customerNumber"),
        F.col("c_name").alias("customerName"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("country"),
        F.when(k % 5 == 0, F.lit(None).cast("long")).otherwise(k % n_rot)
         .alias("salesRepEmployeeNumber"),
    )


def orders(orders_raw: DataFrame) -> DataFrame:
    return orders_raw.select(
        F.col("o_orderkey").alias("orderNumber"),
        F.col("o_custkey").alias("customerNumber"),
        F.col("o_orderdate").cast("date").alias("orderDate"),
        F.col("o_orderstatus").alias("status"),
    )


def shipments(lineitem: DataFrame) -> DataFrame:
    # one row per order that has lines; partial aggregation map-side
    return lineitem.groupBy(F.col("l_orderkey").alias("orderNumber")).agg(
        F.max("l_shipdate").cast("date").alias("shippedDate"))


def orderdetails(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("orderNumber"),
        F.col("l_partkey").alias("productCode"),
        F.col("l_quantity").cast("int").alias("quantityOrdered"),
        cents_from_double("l_extendedprice").alias("revenue_cents"),
    )


def products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("productCode"),
        F.col("p_name").alias("productName"),
        F.col("p_type").alias("productLine"),
        cents_from_double("p_retailprice").alias("buy_price_cents"),
        (F.col("p_size") * 10).alias("quantityInStock"),
    )


def productlines(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_type").alias("productLine")).filter("productLine is not null").distinct()


def payments(orders_raw: DataFrame) -> DataFrame:
    return orders_raw.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_custkey").alias("customerNumber"), cents_from_double("o_totalprice").alias("amount_cents"))
