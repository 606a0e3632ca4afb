"""Documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  The stages:

* quality rules: documents that fail a rule go, and lines over the limits are
  taken out of the texts that stay;
* exact dedup: of equal texts the longest stays, then the one of least id;
* near-dedup: of linked texts the one of least id stays;
* mixing: a row for every pass over a document, in training order;
* packing: pieces of sequences, in that order up to a block.

Nulls and empty texts fail the quality rules, so none reach a later stage.  A
null source is a source of its own.  A null id loses every tie and is kept
where its text is.  Repeated rows are copies.  Very long texts stay whole until
packing cuts them.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesdeck.llm.common import save_shared
from salesdeck.llm.exact_dedup import drop_exact
from salesdeck.llm.mixing import training_order
from salesdeck.llm.packing import packed_documents
from salesdeck.llm.quality import drop_poor
from salesdeck.llm.simhash import drop_near


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_poor(docs, length="n_chars")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return training_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs, stored=True)  # as the mixing stage has sorted them


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup),
          ("mixing", mixing), ("packing", packing)]

#: The SimHash stage has no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save_shared(docs, name.replace(" ", "-"))
    return docs
