"""The queries of this subpackage and their DuckDB counterparts, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_transducer, decontamination, hard_negatives, html_extraction, license_scan, line_dedup, metric_join, ngram_join, periodic_runs, secret_scan, substring_dedup, token_files, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_template_decontamination": decontamination.query,
    "op2_metric_range_join": metric_join.query,
    "op3_recompression_dedup": substring_dedup.query,
    "op4_crf_extraction": html_extraction.query,
    "op5_simple8b_tokens": token_files.query,
    "op6_fuzzy_line_dedup": line_dedup.query,
    "op7_ngram_jaccard_join": ngram_join.query,
    "op8_counterfactual_toxicity": toxicity.query,
    "op9_owned_secrets": secret_scan.query,
    "op10_bpe_transducer": bpe_transducer.query,
    "op11_license_diagonals": license_scan.query,
    "op12_strassen_negatives": hard_negatives.query,
    "op13_periodic_runs": periodic_runs.query,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op2_metric_range_join": metric_join.ORACLE_SQL,
    "op3_recompression_dedup": substring_dedup.ORACLE_SQL,
    "op6_fuzzy_line_dedup": line_dedup.ORACLE_SQL,
    "op7_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op9_owned_secrets": secret_scan.ORACLE_SQL,
    "op11_license_diagonals": license_scan.ORACLE_SQL,
    "op12_strassen_negatives": hard_negatives.ORACLE_SQL,
    "op13_periodic_runs": periodic_runs.ORACLE_SQL,
}
