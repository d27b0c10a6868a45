"""A training-data pipeline over documents: five stages of tokenlens.llm, each over all that the one before it kept.

In every stage: an empty table gives an empty one; very long texts are whole; other columns are kept as they are, whatever
their names, but for the last stage, which returns pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenlens.llm import language_id, packing, quality_rules, simhash, suffix_dedup
from tokenlens.llm.common import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) or without a language that fills half of their words.

    Of languages with equal shares that which sorts first counts; repeated rows are judged alike; a null doc_id or lang changes nothing.
    """
    return language_id.filter_documents(docs, language_id.train(docs))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of fewer than 20 words (null and empty ones too), with many repeated windows, or more likely bad than good by the votes of rules.

    Texts with the same votes, and so repeated rows, are judged alike; a posterior of just one half is kept.
    """
    return quality_rules.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of each group of texts linked by five-word shingles, similarity 0.8 or more.

    Null, empty and blank texts are one group; of rows with one doc_id the smallest hash of the text decides; rows without a doc_id
    stay, as none of them has a smallest.
    """
    return simhash.filter_documents(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated 200-byte strings out of the texts; every document stays, with what is left of its text.

    A null text stays null, shorter ones lose nothing; all copies of a string go, so repeated rows of 200 bytes or more become empty.
    """
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences, a row per piece. Null and empty texts are their end id alone; repeated rows are packed each."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: SQL has neither EM-trained verdicts nor these tokenizers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
