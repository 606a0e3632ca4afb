"""Time-varying curriculum: sources mixed to target weights.

A source's schedule is a weight that changes linearly over training time 0..1.
Its integral up to a time, scaled to the source's target, is the words the
source must have delivered by then; inverting that at a document's place in
its source's word count gives the document's time.  Sorting all documents by
time gives the training order, and at any time the sources flow in proportion
to target times schedule.  A target above a source's size means further
passes over it.

Nulls: a null text has no words; a null source is a source of its own, last in
order.  Very long texts are counted whole.  Repeated rows are documents of their own.  Empty texts take no words
and no position.  Empty table: no rows.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesdeck.llm.common import key_of, read, running_sum, text_of, words_of

#: Weights of the sources in order, repeating, and their schedules (weight at
#: the start and at the end of training).
WEIGHTS = (1, 2, 3)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: No document is taken more often.
MOST_PASSES = 3
#: Buckets of a source, one task's share; a power of 16.
BUCKET_DIGITS = 2


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """Adds ``rank``, ``weight`` and ``target`` to a table with one row per
    source (``source``, ``source_size``): shares of all words by weight, none
    above ``passes`` times the source's size, the excess shared by weight among
    the rest.  In order of size over weight the capped sources come first, so
    one running sum settles all rounds of sharing."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1) \
        .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                                           (F.col("rank") % len(weights) + 1).cast("int")))
    shared = ranked.withColumn("words", F.sum("source_size").over(everything)) \
        .withColumn("weights", F.sum("weight").over(everything)) \
        .withColumn("cap", passes * F.col("source_size")) \
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))) \
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))) \
        .withColumn("capped", F.col("cap") * (F.col("weights") - F.col("weight_before"))
                    <= F.col("weight") * (F.col("words") - F.col("cap_before")))
    cap_sum = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    weight_sum = F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    return shared.withColumn("left_words", F.col("words") - cap_sum) \
        .withColumn("left_weight", F.col("weights") - weight_sum) \
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
            F.col("weight") * F.col("left_words") / F.col("left_weight"))) \
        .select(*sizes.columns, "rank", "weight", "target")


def time_of(fraction: Column, start: Column, end: Column) -> Column:
    """The time at which a linear schedule has delivered ``fraction`` of its integral."""
    slope = end - start
    root = F.sqrt(start * start + slope * (start + end) * fraction)
    return F.when(slope == 0, fraction).otherwise((root - start) / slope)


def curriculum(docs: DataFrame, carry: Sequence[str], key: str = "doc_id", source: str = "source", text: str = "text",
               weights: Sequence[int] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES,
               passes: int = MOST_PASSES) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (the carried columns), ``size``,
    ``source_size``, ``target``, ``taken`` and ``uses``: an array with, for
    every pass that takes words of it, ``taken`` and ``position`` (0..1).

    Within a source documents come in the order of a hash of their key, the
    same on every run."""
    draw = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(source).alias("source"),
                       key_of(source).alias("group"), draw.alias("draw"),
                       F.substring(draw, 1, BUCKET_DIGITS).alias("bucket"), word_count(text_of(text)).alias("size"))
    sums = rows.groupBy("group", "bucket").agg(F.sum("size").alias("__sum"), F.first("source").alias("source"))
    sizes = sums.groupBy("group").agg(F.first("source").alias("source"), F.sum("__sum").alias("source_size"))
    starts, ends = (F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]),
                                 (F.col("rank") % len(schedules) + 1).cast("int")) for i in (0, 1))
    aims = targets(sizes, weights, passes).select(
        "group", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("cut"),
        starts.alias("start"), ends.alias("end"))
    # each bucket of a source carries its source's figures, so a row needs one join
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("group", "bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("offset")) \
        .join(aims, "group")
    inside = Window.partitionBy("group", "bucket").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.drop("source").join(offsets, ["group", "bucket"]) \
        .withColumn("at", F.col("offset") + F.sum("size").over(inside) - F.col("size"))

    def use(p: int) -> Column:
        begin = F.col("at") + p * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - begin)).cast("long")
        fraction = (begin + taken / 2) / F.col("cut")
        position = F.when(taken > 0, time_of(fraction, F.col("start"), F.col("end")))
        return F.struct(taken.alias("taken"), position.alias("position"))

    uses = F.filter(F.array(*[use(p) for p in range(passes)]), lambda u: u["taken"] > 0)
    return placed.withColumn("uses", uses).select(
        "doc", "size", "source_size", "target", "uses",
        F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["taken"]).alias("taken"))


def training_order(docs: DataFrame) -> DataFrame:
    """``docs`` as they are trained on: a row for every pass that takes at
    least half of a document, sorted by position over all partitions."""
    return curriculum(docs, docs.columns).select("doc", "size", F.explode("uses").alias("use")) \
        .filter("2 * use.taken >= size").orderBy("use.position", "doc.doc_id").select("doc.*")


def op7_time_varying_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return curriculum(docs, ["doc_id"]).select(
        "doc.doc_id", "size", "source_size", "target", "taken", F.get("uses", F.lit(0))["position"].alias("position")) \
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, rk % 3 + 1 AS weight FROM r),
c AS (
  SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, cap * (weights - weight_before) <= weight * (words - cap_before) AS capped FROM c),
t AS (
  SELECT source, source_size, rk,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * (words - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) AS DOUBLE)
                   / CAST(weights - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS DOUBLE) END AS target
  FROM p),
a AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS cut,
         CASE t.rk % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS s0,
         CASE t.rk % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS s1,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT *, greatest(0, least(size, cut - begins)) AS t1,
         greatest(0, least(size, cut - begins - source_size)) + greatest(0, least(size, cut - begins - 2 * source_size)) AS t2
  FROM a),
f AS (SELECT *, CASE WHEN t1 > 0 THEN (begins + CAST(t1 AS DOUBLE) / 2) / cut END AS fraction FROM u)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
       CASE WHEN s1 = s0 THEN fraction
            ELSE (sqrt(s0 * s0 + (s1 - s0) * (s0 + s1) * fraction) - s0) / (s1 - s0) END AS position
FROM f
"""
