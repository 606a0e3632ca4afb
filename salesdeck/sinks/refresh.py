"""A monthly mart that batches are added to.

A batch (new orders with their lines) is summed per month and written as
partial aggregates into ``year=/month=/batch=`` folders with dynamic partition
overwrite: only the months that the batch has orders in are touched, other
folders keep their files, and a batch that runs again replaces its own rows.
Readers merge the partial rows: sums add up, and the customers of a month, kept
as bitmaps, are united, so even the distinct count is that of one run over
everything.  ``compact`` folds the batches of given months into one.

A batch holds whole orders; an order that comes again belongs in its old batch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.functions.money import dollars
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.distinct import count_members
from salesdeck.plans.facts import order_totals, orders_in_scope
from salesdeck.sources.star import Star
from salesdeck.sources.stored import scratch

PARTS = ["year", "month", "batch"]
SCHEMA = "bucket long, num_orders long, revenue_cents long, profit_cents long, members binary, year int, month int, batch string"


def monthly_partials(batch: Star, params: Params = DEFAULT) -> DataFrame:
    """(``year``, ``month``, ``bucket``): orders, revenue and profit of the
    customers in a bucket of numbers, and who they are."""
    o = orders_in_scope(batch, params, False).select("orderNumber", "customerNumber", "orderDate")
    return order_totals(batch).join(o, "orderNumber") \
        .groupBy(F.year("orderDate").alias("year"), F.month("orderDate").alias("month"),
                 F.bitmap_bucket_number("customerNumber").alias("bucket")).agg(
            F.count(F.lit(1)).alias("num_orders"), F.sum("revenue_cents").alias("revenue_cents"),
            F.sum("profit_cents").alias("profit_cents"),
            F.bitmap_construct_agg(F.bitmap_bit_position("customerNumber")).alias("members"))


def _put(partials: DataFrame, path: str) -> None:
    partials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def add_batch(batch: Star, path: str, name: str, params: Params = DEFAULT) -> None:
    """Add the orders of ``batch`` to the mart at ``path``, under ``name``."""
    _put(monthly_partials(batch, params).withColumn("batch", F.lit(name)), path)


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("year", "month", "bucket").agg(
        *[F.sum(c).alias(c) for c in ("num_orders", "revenue_cents", "profit_cents")], F.bitmap_or_agg("members").alias("members"))


def compact(spark: SparkSession, path: str, months: Iterable[tuple[int, int]], name: str) -> None:
    """One batch, ``name``, in place of all batches of ``months``.  The merged
    rows are written aside first: a folder is only replaced by what is safe."""
    for year, month in months:
        at = f"{path}/year={year}/month={month}"
        rows = merged(read_partials(spark, path).filter((F.col("year") == year) & (F.col("month") == month)))
        aside = scratch(spark, "compacted")
        rows.drop("year", "month").withColumn("batch", F.lit(name)).write.partitionBy("batch").parquet(aside)
        spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "static") \
            .partitionBy("batch").parquet(at)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The mart as its readers see it: one row per month."""
    rows = read_partials(spark, path)
    sums = rows.groupBy("year", "month").agg(
        F.sum("num_orders").alias("num_orders"), dollars(F.sum("revenue_cents")).alias("revenue"),
        dollars(F.sum("profit_cents")).alias("profit"))
    return sums.join(count_members(rows, "year", "month"), ["year", "month"]).select(
        F.col("year").cast("string").alias("year"), F.col("month").cast("long").alias("month"),
        "num_orders", "revenue", "profit", "num_customers")
