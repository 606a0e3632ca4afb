"""Type repair on load that keeps what it can't use.

Orders whose dates are text are read in one pass into one written table: the
repaired row, and a ``reason`` where the row is rejected.  Order dates are
strict (a value that is no date rejects the row), ship dates lenient (such a
value becomes NULL), as the reference loads them.  The same pass counts rows,
rejects by reason and blanked ship dates (``DataFrame.observe``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from salesdeck.sources.parse import parse_date_lenient

REASONS = {
    "no order number": "orderNumber IS NULL",
    "no order date": "orderDate IS NULL OR trim(orderDate) = ''",
    "order date is no date": "__ordered IS NULL",
    "shipped before ordered": "__shipped < __ordered",
}


@dataclass(frozen=True)
class Repaired:
    good: DataFrame      # the orders, dates as DATE
    rejects: DataFrame   # the rows as they came, with their reason
    counts: dict         # rows, good, rejected, blanked_ship_dates and one count per reason


def judged(raw: DataFrame) -> DataFrame:
    """``raw`` (``orderNumber``, text ``orderDate`` and ``shippedDate``, others)
    with ``__ordered``, ``__shipped`` and the first ``reason`` that applies."""
    dated = raw.withColumn("__ordered", parse_date_lenient("orderDate")).withColumn("__shipped", parse_date_lenient("shippedDate"))
    reason = F.lit(None).cast("string")
    for name, test in reversed(REASONS.items()):
        reason = F.when(F.expr(test), name).otherwise(reason)
    return dated.withColumn("reason", reason)


def repair_orders(raw: DataFrame, path: str) -> Repaired:
    """Write ``raw`` repaired to ``path`` (folders ``rejected=true/false``) in one pass."""
    seen = Observation("order repair")
    rejected = F.col("reason").isNotNull()
    blanked = ~rejected & F.col("__shipped").isNull() & (F.trim("shippedDate") != "")
    rows = judged(raw)
    counted = rows.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(~rejected).alias("good"), F.count_if(rejected).alias("rejected"),
        F.count_if(blanked).alias("blanked_ship_dates"),
        *[F.count_if(F.col("reason") == name).alias(name) for name in REASONS])
    counted.withColumn("rejected", rejected).write.mode("overwrite").partitionBy("rejected").parquet(path)
    schema = rows.withColumn("rejected", rejected).schema
    stored = raw.sparkSession.read.schema(schema).parquet(path)
    good = stored.filter(~F.col("rejected")).withColumns({"orderDate": F.col("__ordered"), "shippedDate": F.col("__shipped")})
    return Repaired(good.select(*raw.columns), stored.filter("rejected").select(*raw.columns, "reason"), dict(seen.get))
