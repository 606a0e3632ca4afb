"""Small column and table helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesdeck.session import ensure_checkpoint_dir

#: The white space of every contract here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def save_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the cluster's shared checkpoint folder and read
    it back: lineage is cut by files every executor can reach."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def key_of(name: str) -> Column:
    """A never-null grouping key; null and the empty string stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


#: Bits of the largest bitmap that ``split_by_keys`` broadcasts: half a million rows of 64-bit words.
MOST_BITS = 1 << 24


def split_by_keys(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose long ``key`` may be among ``keys`` (one long column,
    written already), and those whose key surely is not: the latter need no
    join.  A bitmap with one hash function and about 16 bits for a key, up to
    ``MOST_BITS``, tells them apart at the scan; a false positive only takes
    the longer way."""
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(F.col("__key"), F.lit(bits))
    bitmap = keys.toDF("__key").select(F.shiftright(place, 5).alias("__word"), F.pmod(place, F.lit(32)).cast("int").alias("__bit")) \
        .groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__mask"))
    marked = rows.withColumn("__key", F.col(key)).withColumn("__word", F.shiftright(place, 5)) \
        .withColumn("__bit", F.pmod(place, F.lit(32)).cast("int")).join(F.broadcast(bitmap), "__word", "left")
    hit = F.coalesce(F.expr("getbit(__mask, __bit)") == 1, F.lit(False))
    return marked.filter(hit).select(*rows.columns), marked.filter(~hit).select(*rows.columns)


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str,
                out: str, sums: DataFrame | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, ordered by
    (``bucket``, ``order``), without putting a group into one task.

    Rows are summed per (group, bucket); the bucket sums, a bounded number per
    group, give each bucket its offset; the rows then add up inside their
    bucket only.  ``sums`` (group, bucket, ``__sum``) may be passed if known."""
    if sums is None:
        sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.join(offsets, [*group, bucket])
            .withColumn(out, F.col("__offset") + F.sum(value).over(inside) - F.col(value))
            .drop("__offset"))
