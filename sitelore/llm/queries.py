"""The registered queries of this subpackage: name, function of (spark, sf_dir), and oracle SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelore.llm import (chosen_path, decontaminate, fingerprints, hard_negatives, html_text, importance, line_dedup,
                          ngram_join, packing, sharding, suffix_dedup, token_files, toxicity)
from sitelore.llm.common import documents, pages, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": lambda spark, sf_dir: suffix_dedup.op1_suffix_dedup(documents(spark, sf_dir)),
    "op2_decontaminate": lambda spark, sf_dir: decontaminate.op2_decontaminate(
        documents(spark, sf_dir), table(spark, sf_dir, "benchmark")),
    "op3_html_extraction": lambda spark, sf_dir: html_text.op3_html_extraction(pages(spark, sf_dir)),
    "op4_line_dedup": lambda spark, sf_dir: line_dedup.op4_line_dedup(documents(spark, sf_dir)),
    "op5_token_files": lambda spark, sf_dir: token_files.op5_token_files(spark, documents(spark, sf_dir)),
    "op6_sharding": lambda spark, sf_dir: sharding.op6_sharding(documents(spark, sf_dir)),
    "op7_toxicity":
        lambda spark, sf_dir: toxicity.op7_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels")),
    "op8_ngram_join": lambda spark, sf_dir: ngram_join.op8_ngram_join(documents(spark, sf_dir)),
    "op9_document_fingerprints":
        lambda spark, sf_dir: fingerprints.op9_document_fingerprints(documents(spark, sf_dir)),
    "op10_best_fit_packing": lambda spark, sf_dir: packing.op10_best_fit_packing(documents(spark, sf_dir)),
    "op11_hard_negatives": lambda spark, sf_dir: hard_negatives.op11_hard_negatives(table(spark, sf_dir, "embeddings")),
    "op12_importance_resampling": lambda spark, sf_dir: importance.op12_importance_resampling(
        documents(spark, sf_dir), table(spark, sf_dir, "benchmark")),
    "op13_near_dedup": lambda spark, sf_dir: chosen_path.op13_near_dedup(documents(spark, sf_dir)),
}

ORACLES: dict[str, str] = {"op4_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
