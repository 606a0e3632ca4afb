"""The retail model as SQL temp views, for users who query it in SQL.

``register_views(star)`` publishes ``offices``, ``employees``, ``customers``,
``orders`` (with ``shippedDate``), ``orderdetails``, ``products`` and, where the
source has them, ``productlines`` and ``payments`` in the session; money is
exact ``DECIMAL(18,2)`` (``orderdetails.line_revenue``, ``products.buyPrice``,
``payments.amount``).  Statements written for SQLite need four dialect
changes:

* ``strftime('%Y', d)`` / ``strftime('%m', d)``  ->  ``date_format(d, 'yyyy')`` / ``'MM'``
* ``julianday(a) - julianday(b)``                ->  ``datediff(a, b)`` (dates) or
  ``timestampdiff(SECOND, b, a) / 86400D``
* ``GROUP BY key`` with bare dependent columns   ->  list those columns in ``GROUP BY``
* ``quantityOrdered * priceEach``                ->  ``line_revenue`` (the exact line amount;
  ``priceEach`` is not materialised because revenue / quantity is not exact)

``HAVING alias`` and ``GROUP BY alias`` work unchanged.  Catalyst plans the
statements exactly like the DataFrame analyses (same pushdown, pruning and
join selection).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesdeck.params import DEFAULT, Params
from salesdeck.sources.star import Star
from salesdeck.sources.stored import scratch

MONEY = "decimal(18,2)"


def _money(cents: str, name: str):
    return (F.col(cents).cast("decimal(20,0)") / F.lit(100)).cast(MONEY).alias(name)


def canonical_views(star: Star) -> dict[str, DataFrame]:
    more = {}
    if star.productlines is not None:
        more["productlines"] = star.productlines
    if star.payments is not None:
        more["payments"] = star.payments.select("customerNumber", _money("amount_cents", "amount"))
    return more | {
        "offices": star.offices,
        "employees": star.employees,
        "customers": star.customers,
        "orders": star.orders_shipped,
        "orderdetails": star.orderdetails.select(
            "orderNumber", "productCode", "quantityOrdered", _money("revenue_cents", "line_revenue")),
        "products": star.products.select(
            "productCode", "productName", "productLine", _money("buy_price_cents", "buyPrice"),
            "quantityInStock"),
    }


def register_views(star: Star, prefix: str = "") -> list[str]:
    names = []
    for name, df in canonical_views(star).items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def publish(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """A temporary table that is computed once: ``df`` is written (to the
    cluster's shared folder unless ``path`` names another) and the files are
    published as the temp view ``name``, so every later statement over it reads
    them and none computes it again."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.createOrReplaceTempView(name)
    return stored


CUSTOMER_PROFIT = """
SELECT o.customerNumber, COUNT(DISTINCT o.orderNumber) AS orders, SUM(d.line_revenue) AS revenue,
       SUM(d.line_revenue - d.quantityOrdered * p.buyPrice) AS profit
  FROM {0}orderdetails d JOIN {0}products p ON p.productCode = d.productCode
  JOIN {0}orders o ON o.orderNumber = d.orderNumber
 WHERE o.status <> '{1}' GROUP BY o.customerNumber"""
BY_COUNTRY = """
SELECT c.country, COUNT(*) AS customers, SUM(t.orders) AS orders, SUM(t.revenue) AS revenue, SUM(t.profit) AS profit
  FROM {0} t JOIN {1}customers c ON c.customerNumber = t.customerNumber GROUP BY c.country"""
WITH_SHARE = """
SELECT country, customers, orders, CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit,
       (SELECT COUNT(*) FROM {1} t JOIN {2}customers c ON c.customerNumber = t.customerNumber
         WHERE c.country = {0}.country AND t.profit > (SELECT AVG(profit) FROM {1})) AS above_average
  FROM {0}"""


def country_profit(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Chained SQL statements: profit per customer as a temporary table, two
    statements over it.  The order lines are read by the first alone."""
    spark = star.orders.sparkSession
    prefix = f"r{uuid.uuid4().hex[:12]}_"
    register_views(star, prefix)
    per_customer, per_country = f"{prefix}customer_profit", f"{prefix}country_profit"
    publish(spark.sql(CUSTOMER_PROFIT.format(prefix, params.cancelled)), per_customer)
    spark.sql(BY_COUNTRY.format(per_customer, prefix)).createOrReplaceTempView(per_country)
    return spark.sql(WITH_SHARE.format(per_country, per_customer, prefix))
