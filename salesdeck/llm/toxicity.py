"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is the sum of the embeddings at the hashes of itself and of its first
letters, so forms of one stem are alike.  Filters of several widths run over
the words of the whole text; each gives its greatest value anywhere in it, and
a logistic layer makes the score of these.

All labelled rows outside the held-out fold are learnt from, with their whole
texts.  They are packed into units of a bounded number of rows; tasks train on
a unit each, from the same weights, and what the units changed is averaged for
the next round.  One in four of these rows, by a hash of the text, is kept from
training: all of these set the score's middle (0.5) and a threshold for every
language.

The score is made of the text alone.  A row's language only picks the
threshold that ``flagged`` compares the score with; ``predicted`` is the
decision at 0.5.

Nulls: a null text is empty; a null or unseen language has the threshold of
all.  A null key has no label and counts as held out.  Empty texts get the
score of no words.  A row of ``labels`` without a label teaches nothing; of
several labels of one key toxic wins.  Repeated rows get equal scores.
Without a toxic and a clean labelled row every score is 0.  Empty table: no
rows.  A very long text is trained on and scored whole, a bounded number of
words at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.llm.common import key_of, read, running_sum, save_shared, split_by_keys

#: ``labelled_sample``: so many rows of each class, of texts with at most so many code points.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: A unit ends after so many rows, words or distinct words.
UNIT_ROWS, UNIT_WORDS, UNIT_KINDS = 8192, 6_000_000, 1 << 20
#: Rows and code points that a shard has on average, at most: most shards are one unit.
SHARD_ROWS, SHARD_CHARS = UNIT_ROWS * 7 // 8, 30_000_000
#: One in so many labelled rows is kept from training, for the thresholds;
#: a language needs so many of each class there for one of its own.
CALIBRATION, LEAST_CALIBRATED = 4, 8
#: One in so many labelled keys (by CRC-32) is held out.
FOLDS = 5

BUCKETS, EMBEDDED = 1 << 16, 16
#: Letters of a word's beginning that are hashed beside the whole word.
STEMS = (3, 4, 5, 6, 7)
WIDTHS, FILTERS = (1, 2, 3), 16
#: Passes over all units after each round; at a round's end the units are
#: averaged.  Ten in all, fewer if a unit's rows make so many steps in fewer.
PASSES, STEPS = (1, 3, 6, 10), 24_000
BATCH, RATE, DROPPED = 32, 0.2, 0.3
#: Blocks of embedding rows that are averaged apart.
BLOCKS = 64
#: Words whose vectors a task remembers, and words of a text that are filtered at a time.
REMEMBERED, AT_ONCE = 100_000, 16_384

words_of = re.compile(r"\w+").findall


@dataclass
class Network:
    """``embedded``: a row per bucket and one of zeros for padding; ``filters``:
    for each width its (width, embedding, filter) weights."""
    embedded: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    middle: float = 0.0                                        # the logit that scores 0.5
    thresholds: dict[str, float] = field(default_factory=dict)  # score by language


#: CRC-32 goes on from that of the letter before a whole word and of the digit before a stem.
BEFORE_WORD, BEFORE_STEM = zlib.crc32(b"="), [(n, zlib.crc32(str(n).encode())) for n in STEMS]


def pieces_of(word: str) -> list[int]:
    """Buckets of a word, padded to an equal number."""
    data, size = word.encode(), len(word)
    made = [zlib.crc32(data, BEFORE_WORD) % BUCKETS]
    if len(data) == size:
        made += [zlib.crc32(data[:n], before) % BUCKETS for n, before in BEFORE_STEM if n < size]
    else:
        made += [zlib.crc32(word[:n].encode(), before) % BUCKETS for n, before in BEFORE_STEM if n < size]
    return made + [BUCKETS] * (1 + len(STEMS) - len(made))


def logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, np.float64)))


class Scorer:
    """Logits of texts, for one task: what the filters make of a word is
    computed once and remembered."""

    class Seen(dict):
        def __init__(self):
            self.new: list[str] = []

        def __missing__(self, word: str) -> int:
            self[word] = at = len(self) + 1  # 0 is padding
            self.new.append(word)
            return at

    def __init__(self, network: Network):
        self.network = network
        # (embedding, all columns): widths one after another, each offset of a width by itself
        self.flat = np.concatenate([w[j] for w in network.filters for j in range(len(w))], axis=1).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.seen = self.Seen()
        self.table = np.zeros((1024, self.flat.shape[1]), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        new = self.seen.new
        if new:
            while len(self.seen) >= len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            for at in range(0, len(new), 4096):
                some = new[at:at + 4096]
                vectors = self.network.embedded[np.array([pieces_of(w) for w in some])].sum(axis=1)
                first = self.seen[some[0]]
                self.table[first:first + len(some)] = vectors @ self.flat
            new.clear()
        return found

    def logit(self, text: str) -> float:
        best = np.full(len(self.network.bias), -np.inf, np.float32)
        words = words_of(text.lower())
        longest = max(WIDTHS) - 1
        for at in range(0, max(1, len(words)), AT_ONCE):
            if len(self.seen) > REMEMBERED:
                self.clear()
            some = words[at:at + AT_ONCE + longest]
            n = max(1, min(AT_ONCE, len(words) - at))
            ids = np.append(self.ids(some), [0] * (1 + longest))[:n + longest]
            made = self.table.take(ids, axis=0)
            column = 0
            for i, width in enumerate(WIDTHS):
                total = made[:n, column:column + FILTERS]
                for j in range(1, width):
                    total = total + made[j:n + j, column + j * FILTERS:column + (j + 1) * FILTERS]
                column += width * FILTERS
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                best[part] = np.maximum(best[part], total.max(axis=0))
        hidden = np.maximum(best + self.network.bias, 0)
        return float(hidden @ self.network.out[:-1] + self.network.out[-1])


@dataclass
class Unit:
    """Labelled texts that are trained on together.  ``ids``: the words of all
    texts, -1 stands for none; ``ends`` of the texts in it; ``pieces`` of the
    distinct words; ``kept``: for the thresholds, not trained on."""
    ids: np.ndarray
    ends: np.ndarray
    pieces: np.ndarray
    labels: np.ndarray
    kept: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], seen: dict[str, int], labels: list[int], kept: list[bool]) -> Unit:
        pieces = np.array([pieces_of(w) for w in seen] + [[BUCKETS] * (1 + len(STEMS))], np.int32)
        return cls(np.concatenate(words), np.cumsum([len(w) for w in words]), pieces, np.array(labels, np.int8), np.array(kept, bool))

    def rows(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0:self.ends[i]]


def ids_of(text: str, seen: dict[str, int]) -> np.ndarray:
    return np.array([seen.setdefault(w, len(seen)) for w in words_of(text.lower())] or [-1], np.int32)


def strongest(filters: list[np.ndarray], vectors: np.ndarray, place: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every text (``place``: rows of ``vectors``, padded after each text)
    the greatest value of each filter and the word where it begins.  A long
    text is passed in parts."""
    longest = max(WIDTHS) - 1
    made = [[vectors @ w[j] for j in range(len(w))] for w in filters]
    best = np.full((len(ends), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    spots = np.zeros(best.shape, np.int64)
    across = np.arange(FILTERS)
    start = 0
    for i, end in enumerate(ends.tolist()):
        for a in range(start, end - longest, AT_ONCE):
            b = min(a + AT_ONCE, end - longest)
            for k, parts in enumerate(made):
                total = parts[0].take(place[a:b], axis=0)
                for j in range(1, len(parts)):
                    total += parts[j].take(place[a + j:b + j], axis=0)
                at = total.argmax(axis=0)
                top = total[at, across]
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                spots[i, mine] = np.where(top > best[i, mine], a + at, spots[i, mine])
                best[i, mine] = np.maximum(best[i, mine], top)
        start = end
    return best, spots


def batches_of(unit: Unit, order: np.ndarray, dropped: np.random.Generator | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of ``order``, a batch at a time: rows, distinct words, ``place``
    and ``ends`` as in ``strongest``."""
    longest = max(WIDTHS) - 1
    pad = len(unit.pieces) - 1
    used, at = np.zeros(pad + 1, bool), np.zeros(pad + 1, np.int64)
    for first in range(0, len(order), BATCH):
        batch = order[first:first + BATCH]
        parts = []
        for i in batch.tolist():
            ids = unit.rows(i)
            if dropped is not None:
                ids = np.where(dropped.random(len(ids), np.float32) < DROPPED, -1, ids)
            parts += [ids, np.full(longest, -1, np.int32)]
        ids = np.concatenate(parts)  # -1 is the last row of the pieces, the padding
        used[ids] = True
        words = np.flatnonzero(used)
        at[words] = np.arange(len(words))
        used[words] = False
        yield batch, words, at[ids], np.cumsum([len(p) for p in parts])[1::2]


def first_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(np.append(rng.normal(0, 0.01, (BUCKETS, EMBEDDED)), np.zeros((1, EMBEDDED)), axis=0).astype(np.float32),
                  [rng.normal(0, (w * EMBEDDED) ** -0.5, (w, EMBEDDED, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.2, len(WIDTHS) * FILTERS + 1).astype(np.float32))
    net.out[-1] = 0
    return net


def train(start: Network, unit: Unit, weights: tuple[float, float], passes: int, seed: tuple[int, ...]) -> Network:
    """``passes`` over a unit's rows, from the weights of ``start``; ``weights``
    of a row of class 0 and 1."""
    rng = np.random.default_rng(seed)
    net = Network(start.embedded.copy(), [w.copy() for w in start.filters], start.bias.copy(), start.out.copy())
    y, pieces, pad = unit.labels.astype(np.float64), unit.pieces, len(unit.pieces) - 1
    weight = np.array(weights)[unit.labels]
    squares = [np.full_like(x, 1e-2) for x in (net.embedded, net.bias, net.out, *net.filters)]

    def step(weights: np.ndarray, square: np.ndarray, slope: np.ndarray, at=slice(None)) -> None:
        square[at] += slope * slope
        weights[at] -= RATE * slope / np.sqrt(square[at])

    for _ in range(passes):
        for batch, words, place, ends in batches_of(unit, rng.permutation(np.flatnonzero(~unit.kept)), rng):
            vectors = net.embedded[pieces[words]].sum(axis=1)
            best, spots = strongest(net.filters, vectors, place, ends)
            pooled = best + net.bias
            hidden = np.maximum(pooled, 0)
            score = logistic(hidden @ net.out[:-1] + net.out[-1])
            slope = ((score - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            back = slope[:, None] * net.out[:-1] * (pooled > 0)
            toward = np.zeros_like(vectors)
            slopes = []
            for i, w in enumerate(net.filters):
                mine = slice(i * FILTERS, (i + 1) * FILTERS)
                turned = np.empty_like(w)
                for j in range(len(w)):
                    hit = place[spots[:, mine] + j]
                    turned[j] = np.einsum("bfd,bf->df", vectors[hit], back[:, mine])
                    np.add.at(toward, hit.ravel(), (back[:, mine, None] * w[j].T[None]).reshape(-1, EMBEDDED))
                slopes.append(turned)
            step(net.out, squares[2], np.append(slope @ hidden, slope.sum()))
            step(net.bias, squares[1], back.sum(axis=0))
            for w, square, turned in zip(net.filters, squares[3:], slopes, strict=True):
                step(w, square, turned)
            moved = np.flatnonzero(toward.any(axis=1) & (words != pad))
            if len(moved):
                buckets, where = np.unique(pieces[words[moved]], return_inverse=True)
                turned = np.zeros((len(buckets), EMBEDDED), np.float32)
                np.add.at(turned, where.ravel(), np.repeat(toward[moved], pieces.shape[1], axis=0))
                step(net.embedded, squares[0], turned, buckets)
                net.embedded[BUCKETS] = 0
    return net


def unit_logits(net: Network, unit: Unit, rows: np.ndarray) -> np.ndarray:
    made = [np.empty(0)]
    for _, words, place, ends in batches_of(unit, rows):
        best, _ = strongest(net.filters, net.embedded[unit.pieces[words]].sum(axis=1), place, ends)
        made.append(np.maximum(best + net.bias, 0) @ net.out[:-1] + net.out[-1])
    return np.concatenate(made).astype(np.float64)


def moves_of(start: Network, net: Network) -> Iterator[tuple[int, np.ndarray]]:
    """What training has changed, in numbered blocks: rows of the embedding, then all else in one row."""
    moved = (net.embedded - start.embedded)[:BUCKETS]
    yield from enumerate(np.split(moved, BLOCKS))
    yield BLOCKS, (np.concatenate([x.ravel() for x in (net.bias, net.out, *net.filters)])
                   - np.concatenate([x.ravel() for x in (start.bias, start.out, *start.filters)]))[None]


def average(moves: list[np.ndarray], rows: list[int]) -> np.ndarray:
    """The mean of several units' moves by their rows; a line counts for the units that moved it."""
    total, mass = np.zeros(moves[0].shape), np.zeros(len(moves[0]))
    for move, n in zip(moves, rows, strict=True):
        total += n * move.astype(np.float64)
        mass += n * move.any(axis=1)
    return (total / np.maximum(mass, 1)[:, None]).astype(np.float32)


def moved(start: Network, moves: dict[int, np.ndarray]) -> Network:
    embedded = start.embedded.copy()
    embedded[:BUCKETS] += np.concatenate([moves[i] for i in range(BLOCKS)])
    made, at = [], 0
    for x in (start.bias, start.out, *start.filters):
        made.append(x + moves[BLOCKS][0, at:at + x.size].reshape(x.shape))
        at += x.size
    return Network(embedded, made[2:], made[0], made[1])


def passes_of(rows: float) -> list[int]:
    """Passes in each round, over units of so many rows on average."""
    all_passes = min(PASSES[-1], max(len(PASSES), -(-STEPS // max(1, rows))))
    ends = [max(i + 1, int(all_passes * p / PASSES[-1])) for i, p in enumerate(PASSES)]
    return np.diff(ends, prepend=0).tolist()


def class_weights(counts: tuple[int, int]) -> tuple[float, float]:
    """Both classes weigh the same."""
    return tuple(0.5 * sum(counts) / max(1, n) for n in counts)


def best_cut(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The cut of greatest F1, in the middle between the logits beside it."""
    order = np.argsort(-logits, kind="stable")
    hits, taken = np.cumsum((labels * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (taken + (labels * weight).sum())
    ranked = logits[order]
    f1[:-1][ranked[:-1] == ranked[1:]] = -1  # a cut can't part equals
    at = int(f1.argmax())
    return float(ranked[at] + ranked[at + 1]) / 2 if at + 1 < len(ranked) else float(ranked[at] - 1)


def fit(texts: list[str], labels: list[int], langs: list[str | None]) -> Network | None:
    """A network with its middle and thresholds, from one unit of rows."""
    if len(set(labels)) < 2:
        return None
    kept = [zlib.crc32(t.encode()) % CALIBRATION == 0 for t in texts]
    all_kept = any(len({y for y, k in zip(labels, kept, strict=True) if k == part}) < 2 for part in (True, False))
    seen: dict[str, int] = {}
    unit = Unit.of([ids_of(t, seen) for t in texts], seen, labels, [False] * len(texts) if all_kept else kept)
    weights = class_weights(tuple((unit.labels[~unit.kept] == y).sum() for y in (0, 1)))
    net = first_network()
    for i, passes in enumerate(passes_of((~unit.kept).sum())):
        net = train(net, unit, weights, passes, (i, 0))
    part = np.arange(len(texts)) if all_kept else np.flatnonzero(unit.kept)
    logits, y, by = unit_logits(net, unit, part), unit.labels[part].astype(np.int64), np.array([langs[i] or "" for i in part])
    weight = np.ones(len(y))
    net.middle = best_cut(logits, y, weight)
    for lang in sorted(set(by) - {""}):
        mine = by == lang
        if min((y[mine] == 0).sum(), (y[mine] == 1).sum()) >= LEAST_CALIBRATED:
            net.thresholds[str(lang)] = float(logistic(best_cut(logits[mine], y[mine], weight[mine]) - net.middle))
    return net


# -------------------------------------------------------------------- Spark

def fold_of(key: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str,
                    rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int], list[str | None], tuple[float, float]]:
    """Texts, labels and languages of the ``rows`` keys of each class with the
    least hash, and how many labelled rows each stands for: a look at the
    labels, which training doesn't use."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")) \
        .filter("key is not null and label in (0, 1)").filter(fold_of(F.col("key")) != 0) \
        .groupBy("key").agg(F.max("label").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    least = [known.filter(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(rows) for y in (0, 1)]
    found = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")) \
        .filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(least[0].union(least[1])), "key") \
        .groupBy("key", "label").agg(F.min(F.struct("text", "lang")).alias("one")) \
        .orderBy(F.xxhash64("key"), "key").collect()
    y = [int(r.label) for r in found]
    return [r.one.text for r in found], y, [r.one.lang for r in found], \
        tuple(counts.get(k, 0) / max(1, y.count(k)) for k in (0, 1))


def labelled_units(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str) -> DataFrame:
    """All labelled rows outside the held-out fold, one for each key, packed
    into units.  Keys are dealt to shards by a hash; a shard's rows follow one
    another by hash and are cut where a unit is full."""
    key_hash = F.xxhash64(F.col("key").cast("string"))
    known = save_shared(labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"))
                        .filter("key is not null and label in (0, 1)").filter(fold_of(F.col("key")) != 0)
                        .groupBy("key").agg(F.max("label").cast("int").alias("label")).withColumn("hash", key_hash), "toxic-labels")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
                       F.col(f"`{lang}`").alias("lang")).filter("key is not null").withColumn("hash", key_hash)
    labelled, _ = split_by_keys(rows, "hash", known.select("hash"))
    chars = labelled.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-known.count() // SHARD_ROWS), -(-chars // SHARD_CHARS))
    found = labelled.drop("hash").join(known, "key").groupBy("key", "label", "hash").agg(F.min(F.struct("text", "lang")).alias("one")) \
        .select("key", "hash", "label", "one.text", "one.lang", F.pmod("hash", F.lit(shards)).alias("shard"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        words: list[np.ndarray] = []
        rest: list[tuple[int, str | None, bool]] = []
        shard, number, held = None, 0, 0

        def made() -> pa.RecordBatch:
            y, langs, kept = zip(*rest, strict=True)
            unit = Unit.of(words, seen, y, kept)
            counts = [int(((unit.labels == c) & (unit.kept == k)).sum()) for k in (False, True) for c in (0, 1)]
            return pa.RecordBatch.from_pylist([{
                "unit": shard << 20 | number, "ids": unit.ids.tobytes(), "ends": unit.ends.astype(np.int64).tobytes(),
                "pieces": unit.pieces.tobytes(), "labels": unit.labels.tobytes(), "kept": unit.kept.tobytes(), "langs": list(langs),
                "clean": counts[0], "toxic": counts[1], "kept_clean": counts[2], "kept_toxic": counts[3]}], schema=arrow)

        arrow = pa.schema([("unit", pa.int64()), *[(c, pa.binary()) for c in ("ids", "ends", "pieces", "labels", "kept")],
                           ("langs", pa.list_(pa.string())), *[(c, pa.int64()) for c in ("clean", "toxic", "kept_clean", "kept_toxic")]])
        for batch in batches:
            for own, y, one, name in zip(*[batch.column(c) for c in ("shard", "label", "text", "lang")], strict=True):
                own, one = own.as_py(), one.as_py()
                if rest and (own != shard or len(rest) >= UNIT_ROWS or held >= UNIT_WORDS or len(seen) >= UNIT_KINDS):
                    yield made()
                    seen, words, rest, held = {}, [], [], 0
                    number = number + 1 if own == shard else 0
                shard = own
                words.append(ids_of(one, seen))
                held += len(words[-1])
                rest.append((y.as_py(), name.as_py(), zlib.crc32(one.encode()) % CALIBRATION == 0))
        if rest:
            yield made()

    units = found.repartition(4 * shards, "shard").sortWithinPartitions("shard", "hash", "key").select("shard", "label", "text", "lang") \
        .mapInArrow(packed, "unit long, ids binary, ends binary, pieces binary, labels binary, kept binary, langs array<string>, "
                            "clean long, toxic long, kept_clean long, kept_toxic long")
    return save_shared(units, "toxic-units")


def unit_from(row: dict, keep: bool) -> Unit:
    """A row of ``labelled_units``; without ``keep`` all its rows are trained on."""
    kept = np.frombuffer(row["kept"], bool)
    return Unit(np.frombuffer(row["ids"], np.int32), np.frombuffer(row["ends"], np.int64),
                np.frombuffer(row["pieces"], np.int32).reshape(-1, 1 + len(STEMS)), np.frombuffer(row["labels"], np.int8),
                kept if keep else np.zeros(len(kept), bool))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def trained(units: DataFrame, weights: tuple[float, float], keep: bool, rows: float) -> Network:
    """Rounds of passes over all units (of ``rows`` to train on, on average):
    every unit is trained on from the same weights, and what it changed is averaged."""
    context = units.sparkSession.sparkContext
    net = first_network()
    for i, passes in enumerate(passes_of(rows)):
        shared = context.broadcast(net)

        def moves(batches: Iterator[pa.RecordBatch], i=i, passes=passes, shared=shared) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                unit = unit_from(row, keep)
                made = train(shared.value, unit, weights, passes, (i, row["unit"]))
                n = max(1, int((~unit.kept).sum()))
                for block, move in moves_of(shared.value, made):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([row["unit"]], pa.int64()),
                                                      pa.array([n], pa.int64()), pa.array([move.tobytes()], pa.binary())],
                                                     names=["block", "unit", "n", "move"])

        def merged(table: pa.Table) -> pa.Table:
            block = table.column("block")[0].as_py()
            width = EMBEDDED if block < BLOCKS else -1
            rows = sorted(zip(table.column("unit").to_pylist(), table.column("n").to_pylist(), table.column("move").to_pylist(), strict=True))
            found = [np.frombuffer(m, np.float32) for *_, m in rows]
            mean = average([m.reshape((-1, width) if width > 0 else (1, -1)) for m in found], [n for _, n, _ in rows])
            return pa.table({"block": pa.array([block], pa.int32()), "move": pa.array([mean.tobytes()], pa.binary())})

        done = units.mapInArrow(moves, "block int, unit long, n long, move binary") \
            .groupBy("block").applyInArrow(merged, "block int, move binary").collect()
        mean = {r.block: np.frombuffer(r.move, np.float32).reshape((-1, EMBEDDED) if r.block < BLOCKS else (1, -1)) for r in done}
        net = moved(net, mean)
        shared.unpersist()
    return net


def cuts(logits: DataFrame) -> dict[str | None, float]:
    """``best_cut`` of all rows (None) and of each language with enough rows of
    both classes, from ``lang``, ``label``, ``logit``."""
    enough = logits.filter("lang != ''").groupBy("lang").agg(F.sum("label").alias("hits"), F.count("*").alias("taken")) \
        .filter((F.col("hits") >= LEAST_CALIBRATED) & (F.col("taken") - F.col("hits") >= LEAST_CALIBRATED))
    parts = logits.select(F.lit(None).cast("string").alias("lang"), "label", "logit") \
        .unionByName(logits.join(F.broadcast(enough.select("lang")), "lang"))
    part = key_of("lang").alias("part")
    bucket = F.floor(-64 * F.least(F.greatest(F.col("logit"), F.lit(-64.0)), F.lit(64.0)))
    distinct = parts.groupBy(part, "lang", "logit").agg(F.sum("label").alias("hits"), F.count("*").alias("taken")) \
        .withColumn("bucket", bucket)
    down = [F.col("logit").desc()]
    both = running_sum(running_sum(distinct, ["part"], "bucket", down, "hits", "hits_before"), ["part"], "bucket", down, "taken", "taken_before")
    totals = distinct.groupBy("part").agg(F.sum("hits").alias("all_hits"))
    f1 = 2 * (F.col("hits_before") + F.col("hits")) / (F.col("taken_before") + F.col("taken") + F.col("all_hits"))
    best = both.join(F.broadcast(totals), "part").groupBy("part", "lang").agg(F.max(F.struct(f1.alias("f1"), "logit"))["logit"].alias("best"))
    found = distinct.join(F.broadcast(best.select("part", "best")), "part") \
        .groupBy("part", "lang", "best").agg(F.max(F.when(F.col("logit") < F.col("best"), F.col("logit"))).alias("next")).collect()
    return {r.lang: r.best - 1 if r.next is None else (r.best + r.next) / 2 for r in found}


def fit_labelled(units: DataFrame) -> Network | None:
    """``fit`` of all units."""
    clean, toxic, kept_clean, kept_toxic, number = (x or 0 for x in units.agg(
        *[F.sum(c) for c in ("clean", "toxic", "kept_clean", "kept_toxic")], F.count("*")).first())
    if not clean + kept_clean or not toxic + kept_toxic:
        return None
    keep = min(clean, toxic, kept_clean, kept_toxic) > 0  # else too few rows to keep any from training
    counts = (clean, toxic) if keep else (clean + kept_clean, toxic + kept_toxic)
    net = trained(units, class_weights(counts), keep, sum(counts) / number)
    shared = units.sparkSession.sparkContext.broadcast(net)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            unit = unit_from(row, keep)
            part = np.flatnonzero(unit.kept) if keep else np.arange(len(unit.ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["langs"][i] for i in part.tolist()], pa.string()), pa.array(unit.labels[part].astype(np.int64)),
                 pa.array(unit_logits(shared.value, unit, part))], names=["lang", "label", "logit"])

    found = cuts(save_shared(units.mapInArrow(logits, "lang string, label long, logit double"), "toxic-logits"))
    net.middle = found.pop(None)
    net.thresholds = {lang: float(logistic(cut - net.middle)) for lang, cut in sorted(found.items())}
    return net


def scores(docs: DataFrame, network: Network | None, text: str = "text", lang: str = "lang", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``into``: ``score``, ``predicted`` at 0.5, and by
    language ``threshold`` and ``flagged``."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = network and Scorer(network)
        for texts in batches:
            yield pd.Series([float(logistic(scorer.logit(t or "") - network.middle)) if scorer else 0.0 for t in texts], dtype="float64")

    known = network.thresholds if network else {}
    own = F.lit(0.5)
    for name, cut in known.items():
        own = F.when(F.col(f"`{lang}`") == name, cut).otherwise(own)
    made = docs.withColumn(into, F.struct(score(F.col(f"`{text}`")).alias("score"), own.alias("threshold")))
    return made.withColumn(into, F.col(into).withField("predicted", (F.col(into)["score"] >= 0.5).cast("int"))
                           .withField("flagged", (F.col(into)["score"] >= F.col(into)["threshold"]).cast("int")))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             label: str = "toxic", into: str = "toxicity") -> DataFrame:
    """``scores`` of all ``docs`` by a network fitted to all ``labels`` outside
    the held-out fold."""
    return scores(docs, fit_labelled(labelled_units(docs, labels, key, text, lang, label)), text, lang, into)


def op12_convolutional_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    made = classify(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return made.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"),
                       *[F.col(f"toxicity.{c}").alias(c) for c in ("score", "predicted", "threshold", "flagged")])
