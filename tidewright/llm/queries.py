"""The corpus queries and their SQL. Each takes (spark, sf_dir) and reads the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, divergence, exact_dedup, filter_audit, lm, mixing, near_dedup, oracles, quality, secrets, substring_dedup, suffix_dedup,
    token_count, toxicity
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts are equal to each other; a null doc_id comes last of equals; each input row gives one row."""
    return exact_dedup.exact_groups(_docs(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts have no words and fail; each input row gives one row."""
    return quality.judge_repetition(_docs(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has no ids, with the digests of no bytes; each input row gives one row."""
    import public_tokenizers

    return byte_bpe.token_digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts and rows without a doc_id are linked with nothing; each input row gives one row."""
    return near_dedup.near_groups(_docs(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has no spans, and the digest of the empty string; each input row gives one row."""
    return secrets.digest(secrets.find_secrets(_docs(spark, sf_dir)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null source comes last; null and blank texts have size 0; each input row gives one row."""
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty; rows of equal doc_id and text are one document with equal results."""
    return suffix_dedup.repeat_digests(_docs(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts hold the end alone; a null doc_id counts as empty text; each input row gives one row."""
    return lm.score_documents(_docs(spark, sf_dir))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has no tokens; each input row gives one row."""
    import public_tokenizers

    return token_count.count_tokens(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts get the score of a text without matches; each input row gives one row."""
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty, a null language the empty string; an empty table has no parts."""
    return filter_audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts, languages and sources are empty strings; each row is a document."""
    return divergence.source_divergence(_docs(spark, sf_dir))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has no words; rows without a doc_id lose nothing; each input row gives one row."""
    return substring_dedup.passage_digests(_docs(spark, sf_dir))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of op5, counted."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets of op6."""
    sized = _docs(spark, sf_dir).select("source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.targets(sized).select("source", "source_size", F.round("target", 4).alias("target"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unigram columns of op8."""
    return op8_lm_scoring(spark, sf_dir).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score")
    )


_OPERATORS = (
    op1_exact_dedup, op2_quality_rules, op3_byte_bpe, op4_near_dedup, op5_secrets, op6_mixing, op7_suffix_dedup, op8_lm_scoring, op9_token_count,
    op10_toxicity, op11_filter_audit, op12_source_divergence, op13_substring_dedup
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*_OPERATORS, secret_counts, mix_targets, lm_base)}

#: The other operators' queries are tested against brute force, exact round trips or held-out rows, as SQL can't express them.
ORACLES: dict[str, str] = {
    "op1_exact_dedup": oracles.EXACT, "op2_quality_rules": oracles.QUALITY, "op4_near_dedup": oracles.NEAR, "op7_suffix_dedup": oracles.REPEATS,
    "secret_counts": oracles.SECRET_COUNTS, "mix_targets": oracles.MIX_TARGETS, "lm_base": oracles.LM_BASE,
    "op11_filter_audit": oracles.FILTER_AUDIT, "op12_source_divergence": oracles.DIVERGENCE, "op13_substring_dedup": oracles.PASSAGES,
}
