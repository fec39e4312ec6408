"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written and read again before the next.
All but the last return the columns of ``documents``; the last adds token_ids
and n_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import bpe, common, decontamination, language_id, ngram_jaccard, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.7; null, empty and repeated rows as ``remove_toxic`` says, an empty table stays empty."""
    return toxicity.remove_toxic(docs, common.documents(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told; null, empty and repeated rows as ``keep_known`` says, an empty table stays empty."""
    return language_id.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    return ngram_jaccard.keep_representatives(docs, words=5, num=8, den=10)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a verbatim match of 13 words; odd rows as ``remove_contaminated`` says, an empty table stays empty."""
    return decontamination.remove_contaminated(docs, common.documents(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ids and their number; null and empty texts have none, an empty table stays empty."""
    encoded = bpe.bpe_encode(docs)
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", bpe_stage),
]

#: Learned stages can't be written in SQL; tests/llm holds the function behind each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark)
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return scratch.save(STAGES[-1][1](spark, docs, sf_dir))
