"""Cost-balanced packing of token sequences.

A piece of ``l`` tokens costs ``linear * l + quadratic * l * l`` (feed-forward
and attention).  Documents are cut at the sequence length; what is left of
each is assigned, in descending order, to the sequence of least cost that has
room.  A piece that fits nowhere is cut into the largest rooms, so a block
wastes less than one sequence.  Blocks hold a bounded number of pieces: each
is packed by itself, in any task, in an order that a rerun repeats.

Rows that come in an order are cut and packed where they lie, in one pass and
without a shuffle.  Other rows are cut first and their pieces dealt by a hash;
pieces that fill a sequence already then travel without their ids, unless the
ids are asked for.

Nulls: a null text is empty (its only token is the end token).  Repeated rows
are packed once each.  Empty table: no rows.  A long document spreads over
many sequences and tasks.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesdeck.llm.common import read

SEQUENCE = 1024
END_TOKEN = 0
#: Vocabulary of the public tokenizer byte_bpe_50k, as ranks.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The tokenizer itself, for its added tokens.
TOKENIZER = "byte_bpe_50k.json"
#: Pieces that are packed together, and parts of a text that a task remembers.
BLOCK = 4096
REMEMBERED = 300_000
#: A part that is remembered must be looked up so many times, on average, to be worth it.
LEAST_LOOKED_UP = 10
#: Bytes of ids that are cut or placed before they are handed on.
HELD = 1 << 23
#: A sequence id of ordered rows: file, row in the file, sequence.
ROW_BITS, SEQUENCE_BITS = 24, 19


class Encoder(dict):
    """Text to token ids (little-endian 32 bit).  A text is cut at single
    spaces, where the tokenizer's pattern always begins a new part, and the
    ids of each part are remembered, as most parts come again.  If too few do
    by the time the memory is full, texts are encoded whole from then on: the
    ids are the same, and one call a text costs less than looking up its parts
    in vain.  The added tokens of the tokenizer file ``added`` are recognised
    inside texts."""

    #: a space between two white spaces or at the end belongs to a longer run
    run = re.compile(r"\s (?!\S)")

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED, added: str | None = None):
        import public_tokenizers
        import tiktoken
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added: dict[str, bytes] = {}
        if added:
            with open(public_tokenizers.path(added), encoding="utf-8") as f:
                self.added = {a["content"]: np.array([a["id"]], "<u4").tobytes() for a in json.load(f)["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = encoding.encode_ordinary
        self.encode_to_array = functools.partial(encoding.encode_to_numpy, disallowed_special=())
        self.remembered = remembered
        self.looked_up = 0  # parts since the memory was empty
        self.whole = False

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.encode(part)).tobytes()
        if len(part) < 64:
            if len(self) >= self.remembered:
                self.whole = self.looked_up < LEAST_LOOKED_UP * len(self)
                self.looked_up = 0
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.cuts and self.cuts.search(text):
            return b"".join(self.added[x] if i % 2 else self.ordinary(x) for i, x in enumerate(self.cuts.split(text)))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if self.whole or self.run.search(text):
            return self.encode_to_array(text).astype("<u4", copy=False).tobytes()
        first, *rest = text.split(" ")
        self.looked_up += 1 + len(rest)
        return b"".join([self[first], *map(self.__getitem__, [" " + x for x in rest])])


@functools.cache
def encoder_of(vocabulary: str, added: str | None) -> Encoder:
    """One for each Python worker: the next task finds it loaded, with the parts it remembers."""
    return Encoder(vocabulary, added=added)


def pack_block(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) for pieces shorter than
    ``capacity``; as few sequences as the tokens need."""
    bins = max(1, -(-int(lengths.sum()) // capacity))
    room, cost = np.full(bins, capacity), np.zeros(bins)
    placed = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[piece])
        while left:
            fits = room >= left
            if fits.any():
                best, take = int(np.where(fits, cost, np.inf).argmin()), left
            else:
                best = int(room.argmax())
                take = int(room[best])
            placed.append((piece, start, take, best))
            room[best] -= take
            cost[best] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return placed


def cut(batches: Iterator[pa.RecordBatch], encoder: Encoder, end: bytes, capacity: int,
        whole_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of rows (``key``, ``text``, others): all but the text, then
    ``start``, ``length``, ``doc_tokens``, ``ids_crc32``, ``ids``.  Without
    ``whole_ids`` pieces of full length have null ids."""
    step = 4 * capacity
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        out: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            index, *numbers, ids = zip(*out, strict=True)
            index = pa.array(index)
            return pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(index) for c in others], *[pa.array(x, pa.int64()) for x in numbers],
                 pa.array(ids, pa.binary())], names=[*others, "start", "length", "doc_tokens", "ids_crc32", "ids"])

        for i, one in enumerate(batch.column("text")):
            ids = encoder.ids(one.as_py() or "") + end
            tokens = len(ids) // 4
            for at in range(0, len(ids), step):
                part = ids[at:at + step]
                length = len(part) // 4
                out.append((i, at // 4, length, tokens, zlib.crc32(part), part if whole_ids or length < capacity else None))
            held += len(ids)
            if held > HELD:
                yield made()
                out, held = [], 0
        if out:
            yield made()


def place(pieces: pa.RecordBatch, sequence: int, capacity: int, linear: float, quadratic: float,
          with_ids: bool) -> tuple[pa.RecordBatch, int]:
    """One block packed into sequences numbered from ``sequence``, and the next number."""
    starts, lengths, tokens, crcs = (pieces.column(c).to_numpy() for c in ("start", "length", "doc_tokens", "ids_crc32"))
    full, rest = np.flatnonzero(lengths == capacity), np.flatnonzero(lengths < capacity)
    put = pack_block(lengths[rest], capacity, linear, quadratic) if len(rest) else []
    index = np.concatenate((full, rest[[p for p, *_ in put]])).astype(np.int64)
    skip = np.concatenate((np.zeros(len(full), np.int64), [s for _, s, _, _ in put])).astype(np.int64)
    take = np.concatenate((lengths[full], [n for _, _, n, _ in put])).astype(np.int64)
    bins = np.array([b for *_, b in put], np.int64)
    # the pieces of a sequence lie one after another in the order they came
    order = np.argsort(bins, kind="stable")
    before = np.concatenate(([0], np.cumsum(take[len(full):][order])))[:-1]
    first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))[:len(order)]
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    ids = pieces.column("ids")
    crc = crcs[index]
    for at in np.flatnonzero(take < lengths[index]).tolist():  # pieces that were cut again
        part = ids[int(index[at])].as_buffer().to_pybytes()
        crc[at] = zlib.crc32(part[4 * skip[at]:4 * (skip[at] + take[at])])
    arrays = [pieces.column("key").take(pa.array(index)),
              *[pa.array(x, pa.int64()) for x in (starts[index] + skip, take, tokens[index], crc,
                                                  sequence + np.concatenate((np.arange(len(full)), len(full) + bins)).astype(np.int64),
                                                  np.concatenate((np.zeros(len(full), np.int64), offsets)))]]
    names = ["key", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    if with_ids:
        arrays.append(pa.array([ids[i].as_py()[4 * a:4 * (a + n)] for i, a, n in zip(index.tolist(), skip.tolist(), take.tolist(), strict=True)],
                               pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names), sequence + len(full) + (int(bins.max()) + 1 if len(bins) else 0)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows; the last one, and the last of each ``file`` if there is such a column, may be shorter."""
    waiting: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches(max_chunksize=size)[0]

    for batch in batches:
        files = batch.column("file").to_numpy() if "file" in batch.schema.names else np.zeros(batch.num_rows)
        edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if waiting and "file" in batch.schema.names and waiting[-1].column("file")[0].as_py() != files[a]:
                yield joined()
                waiting, rows = [], 0
            while a < b:
                n = min(size - rows, b - a)
                waiting.append(batch.slice(a, n))
                a, rows = a + n, rows + n
                if rows == size:
                    yield joined()
                    waiting, rows = [], 0
    if waiting:
        yield joined()


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE,
         end_token: int = END_TOKEN, vocabulary: str = VOCABULARY, linear: float = 1.0,
         quadratic: float = 1.0 / 4096, block: int = BLOCK, order: Sequence[Column] = (),
         stored: bool = False, tokenizer: str = TOKENIZER, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of ``docs``: ``key``, ``start``, ``length``,
    ``doc_tokens``, ``ids_crc32``, ``sequence_id``, ``offset``, and ``ids``
    (little-endian 32 bit) if asked for.

    With an ``order`` of the rows, or in the order in which they are
    ``stored``, blocks are formed along it and sequence ids follow it from
    block to block; else pieces are dealt by a hash."""
    long = T.LongType()
    kind = docs.schema[key].dataType
    numbers = [T.StructField(n, long) for n in ("start", "length", "doc_tokens", "ids_crc32")]
    ids = T.StructField("ids", T.BinaryType())
    packed_type = T.StructType([T.StructField("key", kind), *numbers, T.StructField("sequence_id", long),
                                T.StructField("offset", long), *([ids] if with_ids else [])])
    end = np.array([end_token], "<u4").tobytes()

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = 0
        for one in blocks(cut(batches, encoder_of(vocabulary, tokenizer), end, capacity, with_ids), block):
            file, row = (one.column(c)[0].as_py() for c in ("file", "row"))
            # one row has fewer sequences than its bits count: ids of files and rows never meet
            sequence = max(sequence, (file << ROW_BITS | row) << SEQUENCE_BITS)
            made, sequence = place(one, sequence, capacity, linear, quadratic, with_ids)
            yield made

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(batches, encoder_of(vocabulary, tokenizer), end, capacity, with_ids)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for one in blocks(batches, block):
            made, sequence = place(one, sequence, capacity, linear, quadratic, with_ids)
            yield made

    rows = [F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")]
    if order or stored:
        if order:
            places = [f"order{i}" for i in range(len(order))]
            sorted_rows = docs.select(*rows, *[c.alias(n) for c, n in zip(order, places, strict=True)]) \
                .repartitionByRange(*places).sortWithinPartitions(*places)
            placed = sorted_rows.select("key", "text", *partition_places())
        else:
            placed = stored_places(docs, rows)
        return placed.mapInArrow(in_order, packed_type).withColumnRenamed("key", key)
    cut_type = T.StructType([T.StructField("key", kind), *numbers, ids])
    made = docs.select(*rows).mapInArrow(pieces, cut_type).withColumn("order", F.xxhash64("key", "start"))
    return made.repartition("order", "key", "start").sortWithinPartitions("order", "key", "start", "doc_tokens", "ids_crc32") \
        .drop("order").mapInArrow(dealt, packed_type).withColumnRenamed("key", key)


def partition_places() -> list[Column]:
    """Partition and row in it, as ``file`` and ``row``."""
    number = F.monotonically_increasing_id()
    return [F.shiftright(number, 33).alias("file"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")]


def stored_places(docs: DataFrame, rows: list[Column]) -> DataFrame:
    """``rows`` of ``docs`` with ``file`` (files numbered by part and name) and
    ``row`` in it.  There is one number for each file, so their table is as
    long as the list of files that the driver holds anyway.  A table that is
    not read from files has the order of its partitions."""
    name = F.col("_metadata.file_name")
    try:
        named = docs.select(*rows, name.alias("name"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select(*rows, *partition_places())
    part = F.regexp_extract("name", r"part-(\d+)", 1)
    files = docs.select(name.alias("name")).distinct() \
        .select("name", (F.row_number().over(Window.orderBy(F.length(part), part, "name")) - 1).cast("long").alias("file"))
    return named.join(F.broadcast(files), "name").select("key", "text", "file", "row")


def packed_documents(docs: DataFrame, stored: bool = False) -> DataFrame:
    return pack(docs, stored=stored, with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
