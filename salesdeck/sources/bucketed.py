"""The order-grain tables bucketed by order.

Every analysis of orders sums the lines per order and joins the sums to the
orders.  ``store_bucketed`` prices the lines once (their only look-up, by
product) and writes lines and orders in the same number of buckets of the
order key, one sorted file each; a star loaded from these tables sums and
joins them where they lie, so no analysis shuffles lines or orders by order.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from salesdeck.plans.facts import priced_lines
from salesdeck.sources.star import Star

#: Bytes of order lines that a bucket should hold.
BUCKET_BYTES = 256 << 20


def buckets_for(line_bytes: int, cores: int) -> int:
    """Buckets of the size a task sorts in memory, at least one for every core."""
    return max(cores, -(-line_bytes // BUCKET_BYTES))


def store_bucketed(star: Star, name: str, path: str, buckets: int) -> None:
    """Tables ``<name>_lines`` and ``<name>_orders`` with their files under ``path``."""
    for part, df in (("lines", priced_lines(star, with_line=True)), ("orders", star.orders_shipped)):
        # dealt by the bucketing hash first: a task then writes its bucket as one file
        df.repartition(buckets, "orderNumber").write.mode("overwrite").format("parquet") \
            .bucketBy(buckets, "orderNumber").sortBy("orderNumber").option("path", f"{path}/{part}").saveAsTable(f"{name}_{part}")


def load_bucketed(spark: SparkSession, star: Star, name: str) -> Star:
    """``star`` with its orders and lines read from the bucketed tables."""
    lines, orders = spark.table(f"{name}_lines"), spark.table(f"{name}_orders")
    return replace(star, orders=orders.drop("shippedDate"), shipments=None, dated_orders=orders,
                   orderdetails=lines.select("orderNumber", "productCode", "quantityOrdered", "revenue_cents"),
                   memo={"priced_lines": lines})


def bucketed(star: Star, name: str, path: str, buckets: int) -> Star:
    store_bucketed(star, name, path, buckets)
    return load_bucketed(star.orders.sparkSession, star, name)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forget the tables; the files under their path stay."""
    for part in ("lines", "orders"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
