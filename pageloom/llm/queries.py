"""Queries of this subpackage, their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, fill_middle, fingerprints, html_text, line_dedup, mixing, ngram_join, packing, quality, secret_scan, suffix_dedup, vector_codes


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op1_quality_votes": quality.op1_quality_votes,
    "op2_order_minhash": fingerprints.op2_order_minhash,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_source_mix": mixing.op7_source_mix,
    "op9_html_text": html_text.op9_html_text,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLES = {
    "op4_secret_scan": secret_scan.oracle(),
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_source_mix": mixing.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op12_vector_codes": vector_codes.oracle(),
    "op13_fill_middle": fill_middle.ORACLE,
}
