"""Fill-in-middle rows, cut between tokens found through an indexable skip list.

A text is a row of tokens (white space and the word after it).  Its skip list
has a node for each token; a node is promoted to an express lane by a coin that
depends on its place only, and every link of a lane carries two widths: the
tokens and the code points it passes over.  A cut rank is reached by descending
from the sparsest lane, taking each link whose tokens still fit and adding up
both widths, so rank and place in the text are found together.

Whether a text is transformed, where it is cut and in which order the parts
are written follow from SHA-256 of the seed and the row's key.

Nulls: a null text is empty, a null key is the empty string in the hash.
Empty texts, and texts that contain a sentinel, stay plain.  Repeated rows
get equal results.  Empty table: no rows.  A very long text is handled in its
row, in about ten times its bytes.  All other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.llm.common import read

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 rows, how many are transformed, and of 100 of those, how many suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: A node is promoted from lane to lane with one chance in 2 ** PROMOTION.
PROMOTION = 2

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def token_ends(text: str) -> np.ndarray:
    """Code-point places where tokens end: after every run of other characters
    than white space, and at the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(points))


def coins(n: int) -> np.ndarray:
    """How many express lanes each of ``n`` nodes is promoted to."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    low = x & (~x + np.uint64(1))  # the lowest set bit: one chance in 2 ** k to be 2 ** k
    trailing = np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)
    return trailing // PROMOTION


class SkipList:
    """Tokens of a text with their widths.  ``lanes[0]`` links neighbouring
    tokens; the links of a lane lead from one promoted node to the next, the
    first one from the head.  A lane is (``down``: the number of links of the
    lane below before this link's end, ``units``, ``chars``)."""

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        self.n = n
        place = np.arange(1, n + 1)
        self.lanes = [(place, np.ones(n, np.int64), np.asarray(widths, np.int64))]
        height = coins(n)
        nodes = np.arange(n)  # of the lane below
        for lane in range(1, int(height.max(initial=0)) + 1):
            up = np.flatnonzero(height[nodes] >= lane)
            _, units, chars = self.lanes[-1]
            starts = np.concatenate(([0], up[:-1] + 1))
            # links of the lane below after its last promoted node belong to no link of this lane
            self.lanes.append((up + 1, np.add.reduceat(units[:up[-1] + 1], starts),
                               np.add.reduceat(chars[:up[-1] + 1], starts)))
            nodes = nodes[up]

    def seek(self, rank: int) -> tuple[int, int]:
        """(code points before ``rank`` tokens, links taken)."""
        units = chars = link = taken = 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            down, u, c = self.lanes[lane]
            while link < len(u) and units + u[link] <= rank:
                units, chars = units + int(u[link]), chars + int(c[link])
                link, taken = link + 1, taken + 1
            if lane:
                link = int(down[link - 1]) if link else 0
        if units != rank:
            raise IndexError(f"rank {rank} of {self.n}")
        return chars, taken


def hashes(key: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[at:at + 8], 16) for at in (0, 8, 16, 24)]


def transform(text: str, key: str, seed: int = SEED, rate: int = RATE,
              suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and middle, output)."""
    one, two, three, four = hashes(key, seed)
    ends = token_ends(text)
    n = len(ends)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= rate:
        return n, "plain", None, None, text
    tokens = SkipList(np.diff(ends, prepend=0))
    start, end = (tokens.seek(rank)[0] for rank in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if four % 100 < suffix_first:
        return n, "spm", start, end - start, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", start, end - start, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def transformed(text: Column, key: Column, seed: int = SEED, rate: int = RATE,
                suffix_first: int = SUFFIX_FIRST) -> Column:
    """Struct of ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``."""
    @F.pandas_udf(RESULT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            rows = [transform(t, k, seed, rate, suffix_first) for t, k in zip(texts, keys, strict=True)]
            made = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
    return of(F.coalesce(text, F.lit("")), F.coalesce(key.cast("string"), F.lit("")))


def restored(output: Column, form: Column) -> Column:
    """The text again, from ``output`` and ``form`` alone.  A text that is not
    plain has no sentinel, so each occurs once."""
    def part(value: Column, sentinel: str, number: int) -> Column:
        return F.split_part(value, F.lit(sentinel), F.lit(number))

    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), part(output, MIDDLE, 2),
                   part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), part(output, MIDDLE, 2),
                   part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "fim", seed: int = SEED,
                   rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with a struct column ``into``: the transformed rows."""
    return docs.withColumn(into, transformed(F.col(f"`{text}`"), F.col(f"`{key}`"), seed, rate, suffix_first))


def op13_indexable_skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                       F.sha2("fim.output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+') AS tokens,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT *, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM c),
p AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:low], '') AS prefix,
         array_to_string(tokens[low + 1:high], '') AS middle, array_to_string(tokens[high + 1:], '') AS suffix
  FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
