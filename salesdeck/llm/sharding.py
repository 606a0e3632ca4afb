"""Rendezvous (highest random weight) hashing over weighted shards.

Every shard draws a pseudo-random number from the record key; the shard with
the least ``-ln(u) / weight`` takes the record.  A shard's draw does not
depend on the others, so adding one moves only the records it wins, and a
shard's share is its share of the weights.

Nulls: a null key is a key like any other.  Empty table: no rows.  Repeated
rows: the same shard, a slot each.  Ties of two shards' draws: the first of
them.  A very long text is only measured and summed up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.llm.common import read, running_sum, text_of

SHARDS = 40
#: Numbering buckets of a shard: a bucket, not a shard, is one task's share.
BUCKETS = 1024


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that takes ``key``; ``weights`` has one positive
    weight per shard.  Equal draws go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight"))
                       for i, w in enumerate(weights)])

    def cost(s: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / s["weight"]).alias("cost"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, cost))["shard"]


def with_slots(rows: DataFrame, key: str, shard: str, ties: Sequence[str] = (),
               buckets: int = BUCKETS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: by key hash bucket,
    then key, then ``ties``.  No task gets a whole shard."""
    spread = rows.withColumn("__bucket", F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int")) \
                 .withColumn("__one", F.lit(1).cast("long"))
    return running_sum(spread, [shard], "__bucket", [F.col(c) for c in (key, *ties)], "__one", "slot") \
        .drop("__bucket", "__one")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 equal shards, law ``key``."""
    data = F.encode(text_of(), "UTF-8")
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text_of()) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), [1.0] * SHARDS).alias("shard"),
        shard_of(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"))
    return with_slots(rows, "doc_id", "shard", ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
