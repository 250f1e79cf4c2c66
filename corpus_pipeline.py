"""A corpus pipeline: quality rules, exact and near deduplication, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from tidewright.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go (operator 2). Null, empty and blank texts are rejected; repeated rows share a verdict."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space one stays (operator 1): the longest, then the smallest doc_id, a null one last.

    Null and blank texts are equal to each other; of rows with the same doc_id and text one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest doc_id: five-word shingles, similarity 0.8 or more (operator 4).

    Null and blank texts and rows without a doc_id are linked with nothing and stay; of rows of one doc_id in one group one stays.
    """
    return near_dedup.drop_near_duplicates(docs, width=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken 0, 1 or 2 times, so that the sources' words meet their targets (operator 6).

    A null source is a source of its own, the last; null and blank texts have no words and are never taken; repeated rows are taken alike.
    """
    return mixing.draw_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens and round_trip, whether the ids map back to the text (operator 3).

    A null text has no ids and comes back as the empty text; very long texts are encoded whole; input columns of these names stay, and
    the new ones have underscores before theirs.
    """
    import public_tokenizers

    return byte_bpe.add_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("source_mix", source_mix),
    ("tokens", tokens)
]

#: SQL can't express the stages after the second; see tests/llm/test_pipeline.py for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
