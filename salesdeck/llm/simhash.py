"""Near duplicates by 64-bit SimHash, found through deletion variants.

Fingerprints at most ``d`` bits apart are cut into ``d // 2 + 1`` segments: if
every segment differed by two bits, the distance would exceed ``d``, so one
differs by at most one.  Each fingerprint is indexed once for every segment
and every bit of it left out; two that agree in a segment but for one bit meet
in the variant that leaves that bit out.  Variants are joined by equality on
distinct fingerprints, the distance is checked in the join itself, and a pair
that meets in several variants comes out of the first one only.  Linked
fingerprints are joined into components by alternating large and small stars.

Nulls and texts without words: fingerprint zero, linked like any other.  Fewer
words than a shingle: the whole sequence is one shingle.  Very long texts are
read whole, a few thousand shingles at a time.  Rows with the same
id and text count as one.  A null id takes part in links and loses against any
other as a component's name.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesdeck.llm.common import read, save_shared, text_of

SHINGLE = 4
DISTANCE = 4
BITS = 64
SALTS = 16
#: Fingerprints with more than this part of all rows are joined by broadcast.
HOT = 1024


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint: the majority, bit by bit, of the shingles'
    XXH64 (seed 42) over the words in lower case, repeats included."""
    import xxhash
    words = (text or "").encode().lower().split()  # bytes: only A-Z and U+0009 to U+000D and space
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:n - 1].tolist()]
    ends = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
            .sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return of(text)


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    n = distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """(``seg``, ``bit``, ``rest``, ``fp``): each segment less each of its bits."""
    made = []
    for s, (shift, width) in enumerate(segments(distance)):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        made += [F.struct(F.lit(s).alias("seg"), F.lit(b).alias("bit"),
                          part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << b))).alias("rest")) for b in range(width)]
    return fps.select("fp", F.explode(F.array(*made)).alias("v")).select("fp", "v.*")


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Pairs (``a`` < ``b``) of distinct fingerprints at most ``distance`` bits apart, each once."""
    # fingerprints are few bytes but make many variants: spread them before
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = variants(fps.repartition(partitions, F.xxhash64("fp")), distance)
    # both sides are renamed alike, so the variants are made and shuffled once
    other = index.withColumnRenamed("fp", "other")
    index = index.withColumnRenamed("fp", "one")
    differ = F.col("one").bitwiseXOR(F.col("other"))
    # a case expression, from which no filter on one side can be drawn: the
    # sides stay equal
    first, earlier = F, F.lit(True)
    for s, (shift, width) in enumerate(segments(distance)):
        part = F.shiftrightunsigned(differ, shift).bitwiseAND(F.lit((1 << width) - 1))
        here = F.when(part == 0, F.col("l.bit") == 0).otherwise(part == F.expr("shiftleft(1L, l.bit)"))
        first = first.when(F.col("l.seg") == s, earlier & here)
        earlier = earlier & (F.bit_count(part) > 1)
    left, right = index.alias("l"), other.alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("seg", "bit", "rest")]
    return left.join(right, on + [F.col("one") < F.col("other"), F.bit_count(differ) <= distance, first]) \
        .select(F.col("one").alias("a"), F.col("other").alias("b"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``); the
    root is the least node of the component.  Alternates large stars (hang
    greater neighbours on the least one) and small stars (hang lesser
    neighbours and the node on the least) until nothing changes; every round
    is written to the shared folder."""
    def least(pairs: DataFrame) -> DataFrame:
        """(u, v, m): m the least of u and its partners v."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")) \
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low, ["u", "salt"])

    stars = save_shared(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        mark = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .union(stars.select("v", "v").distinct())
        seen = mark
        both = stars.union(stars.select("v", "u"))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = least(large)
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(hung.select("u", F.col("m").alias("v"))).distinct()
        stars = save_shared(small, "links")
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(``id``, ``content``, ``fp``) per row, written once; ``content`` is a hash of the text."""
    return save_shared(docs.select(F.col(key).alias("id"), F.xxhash64(text_of(text)).alias("content"),
                                   fingerprint_column(F.col(text), shingle).alias("fp")), "fingerprints")


def classes(rows: DataFrame, distance: int) -> DataFrame:
    """(``fp``, ``rows``, ``first``) per distinct fingerprint: ``first`` is the
    (id, content) of least id among all rows linked to it."""
    fps = rows.groupBy("fp").agg(F.count("*").alias("rows"),
                                 F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "content")).alias("first"))
    roots = components(links(fps.select("fp"), distance))
    # only linked fingerprints have a component beyond themselves; the largest
    # may hold any share of them, so its name is handed out over salted keys
    linked = fps.join(roots, fps.fp == roots.node).select("fp", "root", "first")
    names = linked.groupBy("root").agg(F.min("first").alias("name")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(names, ["root", "salt"])
    return fps.join(named.select("fp", "name"), "fp", "left").select("fp", "rows", F.coalesce("name", "first").alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """(``id``, ``content``, ``fp``, ``component``) per row of ``docs``:
    ``component`` is the least id of the linked rows."""
    rows = fingerprints(docs, key, text, shingle)
    named = save_shared(classes(rows, distance), "classes")
    # at most HOT fingerprints have a HOT-th of all rows: they are joined by broadcast
    hot = named.filter(F.col("rows") > rows.count() / HOT).select("fp", "first")
    out = [F.col("id"), F.col("content"), F.col("fp"), F.col("first.id").alias("component")]
    return rows.join(F.broadcast(hot), "fp").select(*out) \
        .union(rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named, "fp").select(*out))


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
              distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group: the one with the least id."""
    stay = classes(fingerprints(docs, key, text, shingle), distance) \
        .select(F.col("first.id").alias("sid"), F.col("first.content").alias("scontent")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("id"),
                       F.xxhash64(text_of(text)).alias("content"))
    # the join has brought rows of one id and text together: no other shuffle
    same = Window.partitionBy("content", "id").orderBy("content")
    return rows.join(stay, (F.col("content") == F.col("scontent")) & F.col("id").eqNullSafe(F.col("sid"))) \
        .withColumn("number", F.row_number().over(same)).filter("number = 1").select("doc.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))
