"""Language model scoring with a probabilistic suffix tree.

A text is its words in lower case, then an end.  The tree predicts the bytes
of that sequence (words joined by a space, a line feed as the end) from the
longest context it retains, up to ``depth`` bytes.  Every context of the
training texts is a candidate, however rare; it is retained if its next-byte
distribution diverges from its parent's (the context without its first byte)
by more than the length of its description; the parts of a retained context
are kept too.  Distributions are smoothed by their parent's (Witten-Bell),
down to half a count per byte at the root.

The tree is a table for each level and grows with the corpus: a row is a
(context, next byte) with its probability, and counts, smoothing, test and
longest retained suffix are joins, windows and sums.  No part of it passes
through the driver or is broadcast.  Texts are scored in chunks: a chunk's
distinct windows and words are joined to the tree and to the counts of words,
once each, and meet the chunk's texts again.  Words above a ``frequent``-th of
all tokens, at most that many, go to the tasks instead.

Nulls: a null text is empty (just the end).  A null id trains (its text is
empty).  Repeated rows are scored and counted each.  Empty table: no rows.
No training text: the base is null, the tree uniform.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesdeck.llm.common import read, save_shared

DEPTH = 5
FREQUENT = 1 << 20
#: Words and bytes a counting task holds before it passes partial counts on.
HELD_WORDS = 600_000
HELD_BYTES = 1 << 22
#: Bytes of text that are scored together at most, and of those packed in a row.
CHUNK_BYTES = 1 << 25
PACKED_BYTES = 1 << 20
#: Windows or words that a task sorts by chunk at a time.
PACKED_ROWS = 1 << 20
END = 10
LONG = T.LongType()


def training(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 != 1


def words_and_bytes(text: str | None) -> tuple[list[bytes], bytes]:
    words = (text or "").encode().lower().split()
    return words, b" ".join(words) + b"\n"


def grams_of(buffer: bytes, depth: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of ``depth + 1`` bytes that end at a kept place, with counts."""
    a = np.frombuffer(buffer, np.uint8)
    keys = np.zeros(len(a) - depth, np.uint64)
    for i in range(depth + 1):
        keys = (keys << np.uint64(8)) | a[i:len(a) - depth + i]
    return np.unique(keys[keep[depth:]], return_counts=True)


def prepare(docs: DataFrame, depth: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Three kinds of rows.  ``chunk``, ``word``, ``n``: the words of a chunk of
    texts (the end is the empty word), and how often its training documents
    have them.  ``chunk``, ``gram``, ``n``: the same of the distinct windows of
    ``depth + 1`` bytes.  ``chunk``, ``texts``, ``lengths``, ``keys``,
    ``held``: documents of the chunk, their bytes compressed."""
    key_type = docs.schema["key"].dataType
    schema = T.StructType([
        T.StructField("word", T.BinaryType()), T.StructField("chunk", LONG), T.StructField("gram", LONG),
        T.StructField("n", LONG), T.StructField("texts", T.BinaryType()), T.StructField("lengths", T.ArrayType(LONG)),
        T.StructField("keys", T.ArrayType(key_type)), T.StructField("held", T.ArrayType(T.BooleanType()))])
    pad = bytes([END]) * depth

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        trained: list[bytes] = []
        others: list[bytes] = []
        held = size = 0
        chunk = TaskContext.get().partitionId() << 24
        grams, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        packed: list[tuple[bytes, object, bool]] = []
        packed_size = 0
        key_arrow = types = None

        def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            buffer = b"".join(texts)
            keep = np.ones(len(buffer), bool)
            at = 0
            for t in texts:
                keep[at:at + depth] = False
                at += len(t)
            return grams_of(buffer, depth, keep)

        def gather() -> None:
            nonlocal trained, others, held, grams, counts
            found, numbers = [grams], [counts]
            for texts, counted in ((trained, 1), (others, 0)):
                if texts:
                    g, n = windows(texts)
                    found.append(g)
                    numbers.append(n * counted)
            grams, inverse = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate(numbers)).astype(np.int64)
            trained, others, held = [], [], 0

        def batch_of(m: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(m, types[k])
                                               for k in schema.names], names=schema.names)

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal packed, packed_size
            if packed:
                data, keys, is_held = zip(*packed, strict=True)
                yield batch_of(1, chunk=pa.array([chunk], pa.int64()),
                               texts=pa.array([zlib.compress(b"".join(data), 1)], pa.binary()),
                               lengths=pa.array([[len(t) for t in data]], types["lengths"]),
                               keys=pa.array([list(keys)], types["keys"]), held=pa.array([list(is_held)], types["held"]))
            packed, packed_size = [], 0

        def passed_words() -> Iterator[pa.RecordBatch]:
            if words:
                yield batch_of(len(words), chunk=pa.array(np.full(len(words), chunk), pa.int64()),
                               word=pa.array(words.keys(), pa.binary()), n=pa.array(words.values(), pa.int64()))
                words.clear()

        def passed() -> Iterator[pa.RecordBatch]:
            """Ends the chunk."""
            nonlocal grams, counts, chunk, size
            yield from pack()
            yield from passed_words()
            gather()
            for i in range(0, len(grams), 1 << 19):
                g = grams[i:i + (1 << 19)].astype(np.int64)
                yield batch_of(len(g), chunk=pa.array(np.full(len(g), chunk), pa.int64()), gram=pa.array(g),
                               n=pa.array(counts[i:i + (1 << 19)]))
            grams, counts, size = grams[:0], counts[:0], 0
            chunk += 1

        for batch in batches:
            if types is None:
                key_arrow = batch.column(0).type
                types = {"word": pa.binary(), "chunk": pa.int64(), "gram": pa.int64(), "n": pa.int64(), "texts": pa.binary(),
                         "lengths": pa.list_(pa.int64()), "keys": pa.list_(key_arrow), "held": pa.list_(pa.bool_())}
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key = key.as_py()
                tokens, data = words_and_bytes(text.as_py())
                counted = training(key)
                if counted:
                    words.update(tokens)
                    words[b""] += 1
                else:  # to be looked up only
                    for word in tokens:
                        words.setdefault(word, 0)
                    words.setdefault(b"", 0)
                (trained if counted else others).append(pad + data)
                packed.append((data, key, not counted))
                packed_size += len(data)
                held += len(data) + depth
                size += len(data)
                if packed_size > PACKED_BYTES:
                    yield from pack()
                if size > chunk_bytes:
                    yield from passed()
                elif held > HELD_BYTES:
                    gather()
                if len(words) > HELD_WORDS:
                    yield from passed_words()
        if size:
            yield from passed()

    return docs.mapInArrow(count, schema)


def below(column: str, size: int) -> Column:
    """The last ``size`` bytes."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1))


def tree_levels(grams: DataFrame, depth: int) -> list[DataFrame]:
    """For each length of context (``pair``: context and next byte, ``p``:
    smoothed probability, ``diverges``: whether the context does by itself).
    ``grams`` (``pair``, ``n``) holds the windows to score too, with n = 0."""
    counts = [save_shared(grams, "lm-counts")]
    for d in range(depth - 1, -1, -1):
        counts.insert(0, save_shared(counts[0].groupBy(below("pair", d + 1).alias("pair")).agg(F.sum("n").alias("n")), "lm-counts"))
    total = counts[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cost = F.lit(0.5 * float(np.log(max(total, 2))))
    levels = [counts[0].select("pair", ((F.col("n") + 0.5) / F.lit(total + 128.0)).alias("p"), F.lit(True).alias("diverges"))]
    for d in range(1, depth + 1):
        context = Window.partitionBy("context")  # at most 256 rows
        parents = levels[-1].select(F.col("pair").alias("up"), F.col("p").alias("parent"))
        seen, kinds, n, parent = F.col("seen"), F.col("kinds"), F.col("n"), F.col("parent")
        smoothed = counts[d].withColumn("up", below("pair", d)).join(parents, "up") \
            .withColumn("context", F.shiftrightunsigned("pair", 8)) \
            .withColumn("seen", F.sum("n").over(context)) \
            .withColumn("kinds", F.sum((n > 0).cast("long")).over(context)) \
            .withColumn("p", F.when(seen > 0, (n + kinds * parent) / F.greatest(F.lit(1), seen + kinds)).otherwise(parent))
        gain = F.sum(n * F.log(F.col("p") / parent)).over(context)
        levels.append(save_shared(smoothed.select("pair", F.col("p").cast("float").alias("p"), (gain > cost * kinds).alias("diverges")), "lm-level"))
    return levels


def window_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(``gram``, ``log10``): log probability of each window's last byte after
    the longest retained suffix of the bytes before it."""
    levels = tree_levels(grams, depth)
    retained: list[DataFrame] = []
    for d in range(depth, 0, -1):
        own = levels[d].filter("diverges").select(F.shiftrightunsigned("pair", 8).alias("context"))
        if retained:  # parts of a retained context
            own = own.unionByName(retained[0].select(F.shiftrightunsigned("context", 8).alias("context"))) \
                .unionByName(retained[0].select(below("context", d).alias("context")))
        retained.insert(0, save_shared(own.distinct(), "lm-retained"))
    best = levels[0].select("pair", "p")
    for d in range(1, depth + 1):
        kept = retained[d - 1].withColumn("kept", F.lit(True))
        shorter = best.select(F.col("pair").alias("up"), F.col("p").alias("before"))
        best = levels[d].select("pair", "p", F.shiftrightunsigned("pair", 8).alias("context"), below("pair", d).alias("up")) \
            .join(kept, "context", "left").join(shorter, "up") \
            .select("pair", F.when(F.col("kept"), F.col("p")).otherwise(F.col("before")).alias("p"))
    return best.select(F.col("pair").alias("gram"), F.log10("p").cast("float").alias("log10"))


class WindowScores:
    """Looks up windows: a table by hash, the order for what collides there."""

    factor = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, grams: np.ndarray, log10: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.log10 = grams[order], log10[order].astype(np.float64)
        bits = len(grams).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[(self.grams * self.factor) >> self.shift] = np.arange(len(grams), dtype=np.int32)

    def of(self, windows: np.ndarray) -> np.ndarray:
        at = self.table[(windows * self.factor) >> self.shift]
        other = self.grams[at] != windows
        at[other] = np.searchsorted(self.grams, windows[other])
        return self.log10[at]

    def texts(self, texts: list[bytes], depth: int) -> np.ndarray:
        """log10 probability of each text."""
        pad = bytes([END]) * depth
        a = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        keys = np.zeros(len(a) - depth, np.uint64)
        for i in range(depth + 1):
            keys = (keys << np.uint64(8)) | a[i:len(a) - depth + i]
        starts = np.cumsum(lengths) - lengths
        # a window between two texts ends in the padding of the second
        keep = np.arange(lengths.sum()) + depth * np.repeat(np.arange(len(texts)), lengths)
        return np.add.reduceat(self.of(keys[keep]), starts)


def packed_by_chunk(found: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of one chunk that lie together, each column as bytes: a row a
    window is slow to pass on, and a struct for each takes up more bytes
    than its two numbers.  Words are joined by a line feed, which is in none."""
    def joined(column: pa.Array) -> bytes:
        return b"\n".join(column.to_pylist()) if pa.types.is_binary(column.type) else column.to_numpy().tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            chunks = table.column(0).to_numpy()
            order = np.argsort(chunks, kind="stable")
            distinct, first = np.unique(chunks[order], return_index=True)
            rows, ends = table.take(pa.array(order)), [*first[1:].tolist(), len(order)]
            return pa.RecordBatch.from_arrays(
                [pa.array(distinct, pa.int64()),
                 *[pa.array([joined(rows.column(c).slice(a, b - a)) for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())
                   for c in (1, 2)]], names=["chunk", f"{key}s", f"{key}s_{value}"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= PACKED_ROWS:
                yield packed(held)
                held = []
        if any(x.num_rows for x in held):
            yield packed(held)

    return found.select("chunk", key, value).mapInArrow(pack, f"chunk long, {key}s binary, {key}s_{value} binary")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH,
                    frequent: int = FREQUENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    prepared = save_shared(prepare(rows, depth, chunk_bytes), "lm-chunks")
    held_words = prepared.filter("word IS NOT NULL").select("chunk", "word", "n")
    words = save_shared(held_words.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "lm-words")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mass = tokens + 0.5 * (kinds + 1)
    known = words.filter(F.col("n") >= tokens / frequent)  # at most ``frequent`` words
    known = known.toArrow()
    logs = dict(zip(known.column("word").to_pylist(), np.log10((known.column("n").to_numpy() + 0.5) / mass).tolist(), strict=True))
    windows = prepared.filter("gram IS NOT NULL")
    grams = windows.groupBy(F.col("gram").alias("pair")).agg(F.sum("n").alias("n"))

    looked = packed_by_chunk(windows.select("chunk", "gram").join(window_scores(grams, depth), "gram"), "gram", "log10")
    rare = words.filter(F.col("n") < tokens / frequent).withColumnRenamed("n", "times")
    looked_words = packed_by_chunk(held_words.select("chunk", "word").join(rare, "word"), "word", "times")
    shared = spark.sparkContext.broadcast(logs)
    key_type = rows.schema["key"].dataType
    schema = T.StructType([
        T.StructField("key", key_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", LONG),
        T.StructField("n_known", LONG), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(chunk: pa.Table) -> pa.Table:
        """A row for each document of the chunk."""
        def column(name: str) -> list[bytes]:
            return chunk.column(name).drop_null().to_pylist()

        tree = WindowScores(np.frombuffer(b"".join(column("grams")), np.uint64), np.frombuffer(b"".join(column("grams_log10")), np.float32))
        times = np.frombuffer(b"".join(column("words_times")), np.int64)
        seldom = [w for part in column("words") for w in part.split(b"\n")]
        rare_logs = dict(zip(seldom, np.log10((times + 0.5) / mass).tolist(), strict=True))
        logs = shared.value
        unknown = float(np.log10(0.5 / mass))
        packed = chunk.filter(chunk.column("texts").is_valid())
        key_arrow = chunk.schema.field("keys").type.value_type
        made: list[pa.Table] = []
        for i in range(packed.num_rows):
            data = zlib.decompress(packed.column("texts")[i].as_py())
            lengths, held = packed.column("lengths")[i].as_py(), packed.column("held")[i].as_py()
            texts, part, at = [], [], 0
            for n in lengths:
                texts.append(data[at:at + n])
                at += n
            for t in texts:
                words = t.split()
                words.append(b"")  # the end
                hits = [v for v in map(logs.get, words) if v is not None]
                if len(hits) < len(words):
                    hits += [v for v in map(rare_logs.get, [w for w in words if w not in logs]) if v is not None]
                part.append((len(words), len(hits), sum(hits) + (len(words) - len(hits)) * unknown))
            counts, hits, base = zip(*part, strict=True)
            made.append(pa.Table.from_arrays(
                [pa.array(packed.column("keys")[i].as_py(), key_arrow), pa.array(held, pa.bool_()), pa.array(counts, pa.int64()),
                 pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(tree.texts(texts, depth))], names=schema.names))
        return pa.concat_tables(made)

    parts = prepared.filter("texts IS NOT NULL").select("chunk", "texts", "lengths", "keys", "held") \
        .unionByName(looked, allowMissingColumns=True).unionByName(looked_words, allowMissingColumns=True)
    scored = parts.groupBy("chunk").applyInArrow(score, schema)
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                         F.when(F.lit(tokens > 0), F.col("base_score")).alias("base_score"), "score")


def op9_probabilistic_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
