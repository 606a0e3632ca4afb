"""Tables written in a layout that later scans can prune.

``store_orders`` writes the orders with their ship date, partitioned by the
year of it (orders not shipped yet lie apart).  What was a join with the ship
dates of all lines is then a column of the files, and the reference's
``WHERE shippedDate IS NOT NULL`` is a partition filter and a filter pushed
into the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.session import ensure_checkpoint_dir
from salesdeck.sources.star import Star

YEAR = "shippedYear"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/salesdeck-{label}-{uuid.uuid4().hex}"


def store_orders(star: Star, path: str) -> DataFrame:
    """Write the dated orders to ``path`` and read them back."""
    star.orders_shipped.withColumn(YEAR, F.year("shippedDate")).write.mode("overwrite").partitionBy(YEAR).parquet(path)
    return read_orders(star.orders.sparkSession, path, star)


def read_orders(spark: SparkSession, path: str, star: Star) -> DataFrame:
    """The stored orders; types from the star's own, so that no file is opened for them."""
    schema = star.orders_shipped.withColumn(YEAR, F.year("shippedDate")).schema
    return spark.read.schema(schema).parquet(path)


def shipped(orders: DataFrame) -> DataFrame:
    """Orders that have shipped: years with a value (whole folders), then the column."""
    return orders.filter(F.col(YEAR).isNotNull() & F.col("shippedDate").isNotNull())


def shipped_between(orders: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Orders shipped from ``first`` to ``last``: only the folders of those years are read."""
    return orders.filter(F.col(YEAR).between(first.year, last.year) & F.col("shippedDate").between(F.lit(first), F.lit(last)))
