"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesdeck.llm import (exact_dedup, fim, html_extract, language_id, lm_scoring, mixing, packing, pii, quality, sharding,
                           simhash, spelling, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    sharding.op1_rendezvous_sharding,
    packing.op2_cost_balanced_packing,
    html_extract.op3_site_style_tree,
    language_id.op4_bayesian_language_id,
    pii.op5_bilstm_crf_pii,
    quality.op6_cross_document_lines,
    mixing.op7_time_varying_curriculum,
    simhash.op8_simhash_near_dedup,
    lm_scoring.op9_probabilistic_suffix_tree,
    exact_dedup.op10_exact_dedup,
    spelling.op11_reduced_alphabet,
    toxicity.op12_convolutional_classifier,
    fim.op13_indexable_skip_list,
)}

ORACLE_SQL: dict[str, str] = {
    "op6_cross_document_lines": quality.ORACLE,
    "op7_time_varying_curriculum": mixing.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op13_indexable_skip_list": fim.ORACLE,
}
