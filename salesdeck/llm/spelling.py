"""Spelling variants: words one edit apart, grouped under the more frequent one.

Letters are hashed to a few symbols.  The full one-edit neighbourhood of every
distinct reduced word (each deletion, replacement and insertion, and the word
itself) is generated and joined by equality with the reduced vocabulary, so
two words one edit apart always meet: one edit of the words is one edit, or
none, of their reduced words.  What meets is verified on the original strings.
Being near is mutual, so a neighbour whose hash is below the reduced word's
own is left to the other side.

Every word may have a form, its most frequent near word that is common enough;
forms are followed to the last one by doubling (a form is at least twice as
frequent, so few rounds settle).

Words are counted in the tasks before they are shuffled, so a word that makes
up any share of the texts is a few rows.  Nothing is gathered per word but its
number of near words, which its length bounds.

Nulls: a null text has no words, a null key is the empty string in the hash of
slips.  Repeated rows count each.  Ties go to the least word in code-point
order.  A very long text is counted in its row.  Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.llm.common import read, save_shared

#: The letters of a word (after A-Z are lower-cased).
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
SYMBOLS = 6
SHORTEST, RAREST = 5, 3
#: A form is at least so many times as frequent.
RATIO = 2
#: One in so many (document, word) loses a letter.
SLIPS = 97
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
SALTS = 16


def slip(key: str, word: str, one_in: int) -> str:
    """``word`` as it stands in document ``key``."""
    h = zlib.crc32(f"{key}:{word}".encode())
    at = h % len(word)
    return word if h % one_in else word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST,
                slips: int = SLIPS) -> DataFrame:
    """(``word``, ``n``): every word of the texts with its occurrences."""
    runs = re.compile(f"[{LETTERS}]+").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for one, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lowered = whole.as_buffer()  # bytes: only A-Z change
                if lowered is None:
                    continue
                for word, n in Counter(runs(lowered.to_pybytes().lower().decode())).items():
                    word = slip(one, word, slips)
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield counted()
        if counts:
            yield counted()

    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{text}`").cast("binary"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """``word`` with its letters hashed to ``symbols`` symbols."""
    alphabet = _alphabet(symbols)
    return F.translate(word, LETTERS, "".join(alphabet[zlib.crc32(x.encode()) % symbols] for x in LETTERS))


def _alphabet(symbols: int) -> str:
    return "".join(map(chr, range(0x61, 0x61 + symbols)))


def neighbourhood(code: Column, symbols: int = SYMBOLS) -> Column:
    """Hashes of all strings at most one edit from ``code``, each once."""
    letters = F.array(*map(F.lit, _alphabet(symbols)))

    def cut(at: Column, middle: Column | None, skipped: int) -> Column:
        parts = [F.substring(code, F.lit(1), at - 1), *([] if middle is None else [middle]), F.substring(code, at + skipped, F.length(code))]
        return F.xxhash64(F.concat(*parts))

    def each(last: Column, edit: Callable[[Column, Column], Column]) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), last), lambda at: F.transform(letters, lambda s: edit(at, s))))

    return F.array_distinct(F.concat(
        F.transform(F.sequence(F.lit(1), F.length(code)), lambda at: cut(at, None, 1)),
        each(F.length(code), lambda at, s: cut(at, s, 1)),
        each(F.length(code) + 1, lambda at, s: cut(at, s, 0))))


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(``word``, ``n``, ``other``, ``other_n``) for all words of ``words``
    (``word``, ``n``) and every other one edit away; both ways."""
    code = reduced(F.col("word"), symbols)
    coded = save_shared(words.select("word", "n", code.alias("code"), F.xxhash64(code).alias("hash")), "reduced-words")
    codes = coded.select("code", "hash").distinct()
    # codes are few bytes but have many neighbours: spread them before
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meeting = codes.repartition(partitions, "hash").select("hash", F.explode(neighbourhood(F.col("code"), symbols)).alias("met")) \
        .filter(F.col("met") >= F.col("hash")).join(codes.select(F.col("hash").alias("met")), "met", "left_semi")
    one = coded.select("hash", F.col("word").alias("w1"), F.col("n").alias("n1"))
    two = coded.select(F.col("hash").alias("met"), F.col("word").alias("w2"), F.col("n").alias("n2"))
    ordered = (F.col("hash") < F.col("met")) | (F.col("w1") < F.col("w2"))
    pairs = meeting.join(one, "hash").join(two, "met").filter(ordered & (F.levenshtein("w1", "w2", 1) == 1))

    def way(a: str, b: str) -> Column:
        return F.struct(F.col(f"w{a}").alias("word"), F.col(f"n{a}").alias("n"), F.col(f"w{b}").alias("other"), F.col(f"n{b}").alias("other_n"))

    return pairs.select(F.explode(F.array(way("1", "2"), way("2", "1"))).alias("p")).select("p.*")


def last_forms(forms: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``word``, ``root``) for rows (``word``, ``form``): forms followed to the
    last.  Every round doubles the steps taken; what many words lead to is
    handed out over salted keys."""
    steps = save_shared(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(most_rounds):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"),
                              F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = steps.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        taken = save_shared(salted.join(onward, ["root", "salt"], "left").select("word", "root", "next"), "forms")
        if taken.filter("next is not null").isEmpty():
            return taken.select("word", "root")
        steps = taken.select("word", F.coalesce("next", "root").alias("root"))
    raise RuntimeError(f"forms: not settled after {most_rounds} rounds")


def variants(words: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """(``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``) for every
    row of ``words`` (``word``, ``n``)."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= ratio * F.col("n")
    named = save_shared(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "variants")
    roots = last_forms(named.filter("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST,
                      rarest: int = RAREST, slips: int = SLIPS, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """``variants`` of the words of ``docs`` that occur often enough."""
    words = word_counts(docs, key, text, shortest, slips).filter(F.col("n") >= rarest)
    return variants(save_shared(words, "words"), symbols, ratio)


def op11_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents", "doc_id", "text"))
