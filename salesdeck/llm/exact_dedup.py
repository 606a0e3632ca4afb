"""Exact duplicates by progressive refinement.

Texts are equal when identical without white space.  Rows are grouped by
length, the groups of two or more by a hash of their first characters, and
only rows whose group still has two or more members have their whole content
hashed and grouped.  Which rows those are is told to the scan by a bitmap of
fixed size (one hash function): it holds every surviving group, and a false
positive costs one extra hash, never a wrong result.  No text is shuffled to
find the duplicates.

Nulls: a null text counts as empty.  A null id loses against any other.
Repeated rows (same id, same content): all are members, one is kept.
Empty table: no rows.  Very long texts are hashed whole.  Ties: see
``exact_groups``.  Other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesdeck.llm.common import SPACES, read, text_of

PREFIX = 64
#: Bits of the survivors' bitmap; its table has at most a 32nd as many rows.
BITMAP_BITS = 1 << 22
#: Copies of the group table, so that a hot group spreads over as many tasks.
SALTS = 32


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def survivors(rows: DataFrame) -> DataFrame:
    """(length, prefix) groups with two rows or more.  Rows are counted by
    length and prefix at once, on the map side first, so a hot length is a few
    counts when it meets; lengths with one row fall away, then prefixes."""
    pairs = rows.groupBy("length", "prefix").count()
    lengths = pairs.groupBy("length").agg(F.sum("count").alias("rows")).filter("rows > 1")
    return pairs.filter("count > 1").join(lengths, "length", "left_semi").select("length", "prefix")


def exact_groups(docs: DataFrame, carry: Sequence[str], key: str = "doc_id", text: str = "text",
                 prefix: int = PREFIX, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (struct of the carried columns),
    ``keep_id``, ``group_size``, ``kept``.  Of a group, the row with the most
    code points, then the smallest key, is kept."""
    norm = normalised(text_of(text))
    rows = docs.select(
        F.col(key).alias("id"), F.length(text_of(text)).alias("points"), F.length(norm).alias("length"),
        F.xxhash64(F.substring(norm, 1, prefix)).alias("prefix"), norm.alias("norm"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"))
    position = F.pmod(F.xxhash64("length", "prefix"), F.lit(bitmap_bits))
    word, bit = F.shiftright(position, 5), F.pmod(position, F.lit(32)).cast("int")
    bitmap = survivors(rows).select(word.alias("word"), bit.alias("bit")) \
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    marked = rows.withColumn("word", word).withColumn("bit", bit) \
        .join(F.broadcast(bitmap), "word", "left")  # at most bitmap_bits / 32 rows
    hit = F.coalesce(F.expr("getbit(mask, bit)") == 1, F.lit(False))
    hashed = marked.select("id", "points", "doc", F.when(hit, F.sha2("norm", 256)).alias("digest"))

    # one row per group of two or more; copies of one id are counted first
    found = hashed.filter("digest IS NOT NULL").groupBy("digest", "id", "points").agg(F.count("*").alias("n")) \
        .groupBy("digest").agg(
            F.sum("n").alias("group_size"),
            F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("no_id"), "id")).alias("first")) \
        .filter("group_size > 1")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = hashed.withColumn("digest", F.coalesce("digest", F.hex(F.xxhash64("id")))) \
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")) \
        .join(salted, ["digest", "salt"], "left")
    # rows of one id in a group lie together already: the number needs no other shuffle
    same = Window.partitionBy("digest", "salt", "id", "points").orderBy("digest")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (-F.col("points") == F.col("first.less"))
    grouped = F.col("group_size").isNotNull()
    return joined.withColumn("number", F.row_number().over(same)).select(
        "doc", F.when(grouped, F.col("first.id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, first & (F.col("number") == 1)).otherwise(F.lit(True)).alias("kept"))


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the copies."""
    return exact_groups(docs, docs.columns, key, text).filter("kept").select("doc.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text") \
        .withColumn("text_sha256", F.sha2(normalised(text_of()), 256))
    return exact_groups(docs, ["doc_id", "text_sha256"]).select(
        "doc.doc_id", "keep_id", "group_size", "kept", "doc.text_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
