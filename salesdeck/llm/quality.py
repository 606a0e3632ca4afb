"""Quality rules: counts on a document and line frequency across documents.

Base rules reject short texts and texts whose 3-word windows repeat.  Beyond
them, lines are normalised (lower case, white space collapsed) and hashed, and
the distinct documents that hold a line are counted per host (``source``).
A line in more than the allowed documents is removed (``remove_lines``), and a
document that keeps too few of its words is depleted and rejected.

Copies must not make a document's own lines look like boilerplate, so distinct
documents are counted by a signature.  Copies, in any case, spacing or order of
lines, have one signature, the hash of all their line hashes.  So have near
copies: a document most of whose lines and words stand in other documents of
its host as well is signed by the longest of those lines.  However many near
copies there are, they have as many signatures as lines at most.

Nulls: a null text has no words (and fails the base rules); a null source is a
host of its own.  Repeated rows get equal verdicts.  Empty table: no rows.
Ties: a line in exactly the allowed documents stays, of lines of equal length
the greatest hash signs, and a text that keeps exactly the least share stays.
Very long texts are counted whole, in their row.
DataFrame functions only; a document is handled in its row, texts are split
into lines once, and a frequent line is counted on the map side and joined back
over salted keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.llm.common import SPACES, key_of, let, read, save_shared, split_by_keys, text_of, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineLimits:
    """A line is removed if over ``documents`` distinct documents and over
    ``share`` of a host's hold it; a document is depleted if under ``left`` of
    its words remain.  A document is a near copy if at least ``near`` of its
    lines and of its words stand elsewhere on the host.  ``salts`` spreads the
    join on frequent lines."""
    documents: int = 20
    share: float = 0.001
    left: float = 0.2
    near: float = 0.8
    salts: int = 32


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside windows that occur twice or more, first ones included.
    Windows are compared by 64-bit hash."""
    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(r: Column) -> Column:
            twice = F.filter(r, lambda x, i: F.coalesce(F.get(r, i - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(r, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            spans = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)) \
            .otherwise(let(let(ranked, places), total))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes, covered))

    return of(words).cast("long")


def line_keys(text: Column) -> Column:
    """The normalised lines that have a word, in order, each with its place ``at`` among all lines."""
    # a single space is no match, so most of the text is only looked at
    flat = F.regexp_replace(F.lower(text), "[ \\t\\x0B\\f\\r]{2,}|[\\t\\x0B\\f\\r]", " ")
    lines = F.transform(F.split(flat, "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("at")))
    return F.filter(lines, lambda x: x["line"] != "")


def base_counts(text: Column) -> list[Column]:
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return [F.length(bare).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                   repeated_words(w).alias("n_repeat_words"))).alias("w")]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def document_lines(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(``id``, ``content``, ``host``, ``whole``, ``all_words``, ``all_lines``,
    ``line``, ``at``, ``words``): each line of each row, with its place and its
    words; ``whole`` is the hash of all lines, ``all_words`` and ``all_lines``
    count the distinct ones."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text_of(text)).alias("content"), key_of(source).alias("host"),
                       line_keys(text_of(text)).alias("lines"))
    hashed = rows.select("id", "content", "host", F.transform("lines", lambda x: F.struct(
        F.md5(x["line"]).alias("line"), x["at"].alias("at"),
        (F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(" "))) + 1).alias("words"))).alias("lines"))
    whole = F.md5(F.array_join(F.sort_array(F.transform("lines", lambda x: x["line"])), ""))
    # text, not structs: those are told apart by comparing each with each
    distinct = F.array_distinct(F.transform("lines", lambda x: F.concat(x["line"], x["words"].cast("string"))))
    signed = hashed.select("id", "content", "host", "lines", F.unhex(whole).alias("whole"), distinct.alias("distinct"))
    counts = [F.aggregate("distinct", F.lit(0).cast("long"), lambda a, x: a + F.substring(x, 33, 10).cast("long")).alias("all_words"),
              F.size("distinct").cast("long").alias("all_lines")]
    return signed.select("id", "content", "host", "whole", *counts, F.explode("lines").alias("l")) \
        .select("id", "content", "host", "whole", "all_words", "all_lines", F.unhex("l.line").alias("line"), "l.at", "l.words")


def boilerplate(lines: DataFrame, limits: LineLimits) -> DataFrame:
    """(``host``, ``line``) above the limits: distinct documents per host."""
    units = save_shared(lines.select("host", "whole", "all_words", "all_lines", "line", "words").distinct(), "line-units")
    common = units.groupBy("host", "line").agg(F.count("*").alias("n")).filter("n > 1")
    shared = units.join(common, ["host", "line"]).groupBy("host", "whole", "all_words", "all_lines").agg(
        F.sum("words").alias("words"), F.count("*").alias("lines"), F.max(F.struct("words", "line")).alias("longest"))
    near = save_shared(shared.filter((F.col("words") >= limits.near * F.col("all_words")) & (F.col("lines") >= limits.near * F.col("all_lines")))
                       .select("host", "whole", F.col("longest.line").alias("signature")), "near-copies")

    def signed(held: DataFrame, *by: str) -> DataFrame:
        """Distinct documents for each of ``by``."""
        return held.join(near, ["host", "whole"], "left").select(*by, F.coalesce("signature", "whole").alias("signature")) \
            .distinct().groupBy(*by).agg(F.count("*").alias("documents"))

    often = _salted(common.filter(F.col("n") > limits.documents).select("host", "line"), limits)
    held = units.withColumn("salt", _salt(limits, "whole")).join(often, ["host", "line", "salt"]).select("host", "line", "whole")
    hosts = signed(units.select("host", "whole").distinct(), "host").withColumnRenamed("documents", "of")
    return signed(held, "host", "line").filter(F.col("documents") > limits.documents) \
        .join(hosts, "host").filter(F.col("documents") > limits.share * F.col("of")).select("host", "line")


def _salted(few: DataFrame, limits: LineLimits) -> DataFrame:
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(limits.salts - 1))))


def _salt(limits: LineLimits, *names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(limits.salts)).cast("int")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                  limits: LineLimits = LineLimits()) -> DataFrame:
    """Distinct (``id``, ``content``, ``host``) of documents with boilerplate,
    the places of those lines (``removed``) and their words (``removed_words``)."""
    lines = save_shared(document_lines(docs, key, text, source), "lines")
    common = _salted(boilerplate(lines, limits), limits)
    # repeated rows have the same places
    return lines.withColumn("salt", _salt(limits, "id", "content")).join(common, ["host", "line", "salt"]) \
        .groupBy("id", "content", "host") \
        .agg(F.collect_set(F.struct("at", "words")).alias("found")) \
        .select("id", "content", "host", F.transform("found", lambda x: x["at"]).alias("removed"),
                F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("removed_words"))


def _keys() -> list[Column]:
    return [F.xxhash64(text_of()).alias("r_content"), F.col("doc_id").alias("r_id"), key_of("source").alias("r_host")]


def _losing(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """``rows`` joined with the lines they lose: ``removed``, ``removed_words``."""
    on = (F.col("r_content") == F.col("content")) & (F.col("r_host") == F.col("host")) & F.col("r_id").eqNullSafe(F.col("id"))
    return rows.join(bad, on, "left")


def is_depleted(limits: LineLimits) -> Column:
    """Whether the lines that stay have too few of the words."""
    left = F.col("w.n_words") - F.coalesce("removed_words", F.lit(0))
    return (left < limits.left * F.col("w.n_words")).alias("gone")


def _apart(docs: DataFrame, limits: LineLimits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``doc``, keys) that may lose lines, rows that don't, and the lines lost."""
    bad = save_shared(removed_lines(docs, limits=limits), "removed-lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_keys()) \
        .withColumn("r_key", F.xxhash64("r_content", "r_host", "r_id"))
    return *split_by_keys(rows, "r_key", bad.select(F.xxhash64("content", "host", "id"))), bad


def _without_lines(length: str | None) -> Column:
    kept = F.filter(F.split(F.col("doc.text"), "\n"), lambda x, i: ~F.array_contains("removed", i))
    text = F.array_join(kept, "\n")
    doc = F.col("doc").withField("text", text)
    return F.when(F.col("removed").isNull(), F.col("doc")) \
        .otherwise(doc.withField(f"`{length}`", F.length(text).cast("long")) if length else doc).alias("doc")


def remove_lines(docs: DataFrame, limits: LineLimits = LineLimits(), length: str | None = None) -> DataFrame:
    """``docs`` without boilerplate: every text without the lines above the
    limits, all else as it is (but for a column ``length`` of the text's code
    points).  A text that has none stays equal, and is not shuffled."""
    some, others, bad = _apart(docs, limits)
    return others.select("doc.*").union(_losing(some, bad).select(_without_lines(length)).select("doc.*"))


def drop_poor(docs: DataFrame, limits: LineLimits = LineLimits(), length: str | None = None) -> DataFrame:
    """``docs`` without those that fail a rule, and without boilerplate: as
    ``remove_lines``.  The base rules are those of the text as it came."""
    some, others, bad = _apart(docs, limits)

    def passing(rows: DataFrame) -> DataFrame:
        return rows.select("*", *base_counts(text_of("doc.text"))).select(*rows.columns, "w", "w.*").filter(~base_failed()).select(*rows.columns, "w")

    left = _losing(passing(some), bad).filter(~is_depleted(limits)).select(_without_lines(length))
    return passing(others).select("doc.*").union(left.select("doc.*"))


def op6_cross_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    limits = LineLimits()
    rows = _losing(docs.select(*_keys(), *base_counts(text_of())), removed_lines(docs, limits=limits))
    return rows.select(F.col("r_id").alias("doc_id"), "word_chars", "n_symbols", "n_dup_lines", "w.*", is_depleted(limits)) \
        .withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("gone")) \
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS words FROM d),
g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM q, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM raw WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY r),
l AS (
  SELECT r, host, md5(line) AS line, length(line) - length(replace(line, ' ', '')) + 1 AS words
  FROM (SELECT d.r, host, trim(regexp_replace(unnest(string_split(lower(text), chr(10))), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM d)
  WHERE line <> ''),
g2 AS (SELECT r, md5(string_agg(line, '' ORDER BY line)) AS whole FROM l GROUP BY r),
u AS (SELECT DISTINCT host, whole, line, words FROM l JOIN g2 USING (r)),
t AS (SELECT host, whole, sum(words) AS all_words, count(*) AS all_lines FROM u GROUP BY host, whole),
c AS (SELECT host, line FROM u GROUP BY host, line HAVING count(*) > 1),
near AS (
  SELECT host, whole, signature
  FROM (SELECT host, whole, sum(words) AS words, count(*) AS lines, max({'words': words, 'line': line}).line AS signature
        FROM u JOIN c USING (host, line) GROUP BY host, whole) x
  JOIN t USING (host, whole)
  WHERE x.words >= 0.8 * t.all_words AND x.lines >= 0.8 * t.all_lines),
s AS (SELECT u.host, u.line, coalesce(signature, whole) AS signature FROM u LEFT JOIN near USING (host, whole)),
h AS (SELECT host, count(DISTINCT signature) AS n FROM s GROUP BY host),
b AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT signature) AS n FROM s GROUP BY host, line) x JOIN h USING (host)
  WHERE x.n > 20 AND x.n > 0.001 * h.n),
v AS (
  SELECT l.r, sum(CASE WHEN b.line IS NULL THEN l.words ELSE 0 END) < 0.2 * sum(l.words) AS gone
  FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY l.r),
o AS (
  SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w.words, '')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(gone, false) AS gone
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN v USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT gone AS kept
FROM o
"""
