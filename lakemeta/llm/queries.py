"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lakemeta.llm.bpe import op4_bpe_roundtrip
from lakemeta.llm.chat_tree import OP9_SQL, op9_chat_tree
from lakemeta.llm.common import importable
from lakemeta.llm.merkle import OP13_SQL, op13_merkle_manifest
from lakemeta.llm.mixing import op3_source_mix
from lakemeta.llm.quality_rules import OP6_SQL, op6_quality_rules
from lakemeta.llm.simhash import op8_simhash_dedup
from lakemeta.llm.spelling import OP11_SQL, op11_spelling_variants
from lakemeta.llm.suffix_dedup import op2_suffix_dedup
from lakemeta.llm.suffix_tree_lm import op12_suffix_tree_lm
from lakemeta.llm.token_counts import op7_token_counts
from lakemeta.llm.topk_search import OP10_SQL, op10_topk_search
from lakemeta.llm.toxicity import op5_toxicity
from lakemeta.llm.window_dedup import op1_window_dedup

QUERIES = [op1_window_dedup, op2_suffix_dedup, op3_source_mix, op4_bpe_roundtrip, op5_toxicity,
           op6_quality_rules, op7_token_counts, op8_simhash_dedup, op9_chat_tree, op10_topk_search,
           op11_spelling_variants, op12_suffix_tree_lm, op13_merkle_manifest]
ORACLES: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op9_chat_tree": OP9_SQL, "op10_topk_search": OP10_SQL,
                           "op11_spelling_variants": OP11_SQL, "op13_merkle_manifest": OP13_SQL}


def _ready(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: _ready(query) for query in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
