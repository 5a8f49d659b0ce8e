"""From raw documents to packed token sequences: five stages, each an operator of pageloom.llm.

Each stage takes all rows that the one before it kept, as a table. Documents the classifier rejects go; lines that copy
an earlier line go; of each group of near copies (five-word shingles, similarity 0.8) one document stays; sources are
mixed to their weights, whole epochs as rows of their own; what is left is packed. All stages but the last return the
columns of ``documents``.

Nulls, empties and ties, by stage: a null or empty text has the labelled documents' share of quality, and stays if that reaches the threshold;
it has no lines to lose, no copies, no words to mix (so it isn't in the mix), and would be packed as a separator alone.
A null id sorts last; rows with one are told apart by their texts, and repeated rows lose the lines and the place that
the first one keeps. Of equal lines or near copies the smallest id stays. Columns that aren't those of documents pass
through whatever their names. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import line_dedup, mixing, ngram_join, packing, quality
from pageloom.llm.scratch import read_table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_votes", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: The classifier, MinHash and tokenizer stages have no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
