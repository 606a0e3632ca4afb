"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence: the likelihood of the page's text under each language
(byte trigrams, counted over all labelled documents), the
language its markup declares, the suffix of its address, and a prior for its
host.  All but the first are learned from the pages themselves: grouped
aggregation of the text posteriors gives, per language, how often a
declaration or a suffix comes with it, and the mix of languages of a host.
Host mixes are smoothed towards their domain's, those towards the whole
collection's.  A page's own evidence is left out of its host's counts.

Text likelihoods are tempered: neighbouring trigrams are not independent, so
a text counts as at most ``TEXT_UNITS`` of them.

Nulls: a page without text, declaration, url or host gets what the other
evidence says.  Very long pages are read whole, in their row.  Ties: of equally
likely languages the first by name answers.  Repeated rows give equal results.  No labelled documents: the
languages are empty and so are the results' language and probability.  Empty
table: no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesdeck.llm.common import read, save_shared
from salesdeck.llm.html_extract import host_of

#: Buckets of trigrams.
BUCKETS = 1 << 15
TEXT_UNITS = 20.0
#: Pseudo-pages of smoothing: declarations and suffixes, host to domain, domain to all.
EVIDENCE_SMOOTHING = 1.0
HOST_SMOOTHING = 5.0
DOMAIN_SMOOTHING = 20.0
SALTS = 32

SKIPPED = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def trigrams(text: str) -> np.ndarray:
    a = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8).astype(np.uint32)
    return ((a[:-2] * 961 + a[1:-1] * 31 + a[2:]) * 2654435761 >> 7) % BUCKETS


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, bucket) of all labelled
    documents (``lang``, ``text``).  The tasks count; what reaches the driver
    is one number per language and bucket."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                counts.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))[:] += \
                    np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(n[at])], names=schema.names)

    found = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(count, schema) \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang = found.column("lang").to_pylist()
    languages = sorted(set(lang))
    counts = np.full((len(languages), BUCKETS), 0.1)
    counts[[languages.index(x) for x in lang], found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def page_text(source: str | None) -> str:
    return html.unescape(SKIPPED.sub(" ", source or ""))


def text_posterior(source: Column, languages: list[str], weights: np.ndarray, units: float = TEXT_UNITS) -> Column:
    """Array with each language's probability from the page's text alone."""
    shared = weights.T.copy()

    def posteriors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            out = []
            for s in sources:
                grams = trigrams(page_text(s))
                fit = shared[grams].sum(axis=0, dtype=np.float64) * min(1.0, units / max(1, len(grams)))
                odds = np.exp(fit - fit.max()) if len(languages) else fit
                out.append((odds / odds.sum()).tolist() if len(languages) else [])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(posteriors, "array<double>")(source)


def identify(pages: DataFrame, carry: list[str], languages: list[str], weights: np.ndarray, url: str = "url",
             source: str = "html") -> DataFrame:
    """``doc`` (the carried columns), ``host``, ``declared``, ``text_language``,
    ``language`` and ``probability`` of every row of ``pages``."""
    host = host_of(F.col(url))
    markup = F.lower(F.regexp_extract(F.coalesce(F.col(source), F.lit("")),
                                      r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    n = len(languages)
    rows = save_shared(pages.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), host.alias("host"), markup.alias("declared"),
        F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        text_posterior(F.col(source), languages, weights).alias("text")), "page-languages")
    if not n:
        return rows.select("doc", "host", "declared", F.lit(None).cast("string").alias("text_language"),
                           F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"))
    every = range(n)

    def mass(*keys: str) -> DataFrame:
        """Expected pages of each language per group."""
        return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("text", F.lit(i))) for i in every]).alias("mass"))

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, x: a + x)

    # tables with a row per host, domain, declaration and suffix; the collection's is one row
    hosts = mass("domain", "host")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.get("mass", F.lit(i))) for i in every]).alias("domain_mass"))
    all_pages = domains.agg(F.array(*[F.sum(F.get("domain_mass", F.lit(i))) for i in every]).alias("all_mass"))
    share = F.transform("all_mass", lambda x: (x + 1.0) / (total(F.col("all_mass")) + n))

    def likelihood(name: str) -> DataFrame:
        """log P(value | language) up to what all languages share, smoothed to the value's overall share."""
        seen = mass(name).crossJoin(F.broadcast(all_pages))
        overall = total(F.col("mass")) / total(F.col("all_mass"))
        return seen.select(name, F.transform(
            F.arrays_zip("mass", "all_mass"), lambda x: F.log(
                (x["mass"] + EVIDENCE_SMOOTHING * overall) / (x["all_mass"] + EVIDENCE_SMOOTHING) + 1e-12)).alias(f"{name}_log"))

    priors = hosts.join(domains, "domain").crossJoin(F.broadcast(all_pages)) \
        .withColumn("domain_share", F.transform(F.arrays_zip("domain_mass", share.alias("share")), lambda x: (
            x["domain_mass"] + DOMAIN_SMOOTHING * x["share"]) / (total(F.col("domain_mass")) + DOMAIN_SMOOTHING))) \
        .select("host", "mass", "domain_share")

    def with_table(left: DataFrame, table: DataFrame, key: str) -> DataFrame:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.join(salted, [key, "salt"])

    joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    for key, table in (("host", priors), ("declared", likelihood("declared")), ("suffix", likelihood("suffix"))):
        joined = with_table(joined, table, key)
    fused = joined.withColumn("fit", F.transform(
        F.arrays_zip("text", "mass", "domain_share", "declared_log", "suffix_log"),
        lambda x: F.log(x["text"] + 1e-300) + x["declared_log"] + x["suffix_log"]
        + F.log(F.greatest(x["mass"] - x["text"], F.lit(0.0)) + HOST_SMOOTHING * x["domain_share"]))) \
        .withColumn("odds", F.transform("fit", lambda x: F.exp(x - F.array_max("fit"))))
    names = F.array(*[F.lit(x) for x in languages])

    def best(of: str) -> Column:
        return F.get(names, (F.array_position(of, F.array_max(of)) - 1).cast("int"))

    return fused.select("doc", "host", "declared", best("text").alias("text_language"), best("odds").alias("language"),
                        (F.array_max("odds") / total(F.col("odds"))).alias("probability"))


def op4_bayesian_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with the text model of all labelled documents."""
    languages, weights = train(read(spark, sf_dir, "documents", "lang", "text"))
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return identify(pages, ["page_id", "url"], languages, weights).select(
        "doc.*", "host", "declared", "text_language", "language", "probability")
