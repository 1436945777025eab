"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, crosstok, debruijn, htmldiff, langid, linededup, packing, pii, quality, resample, simhash, sql, vectors
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.extract(table(spark, sf_dir, "pages"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.substring_dedup(table(spark, sf_dir, "documents"))


def op12_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return crosstok.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def base6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_quality that SQL can express."""
    return op6_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_pii that SQL can express."""
    return op10_pii(spark, sf_dir).drop("spans", "n_term")


def base8_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_lines that SQL can express: how many words go."""
    return op8_lines(spark, sf_dir).select("doc_id", "n_words", "n_removed_words")


def base11_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_substrings without the number of compacted paths, which SQL cannot express."""
    return op11_substrings(spark, sf_dir).drop("n_passages")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_embeddings, op3_chat, op4_html, op5_language, op6_quality, op7_packing, op8_lines, op9_simhash, op10_pii, op11_substrings, op12_crosstok, op13_resample, base6_rules, base8_words, base10_spans, base11_words)}
#: the links of vectors by all pairs: what is found must be all of them on the tables compared
ORACLE_SQL: dict[str, str] = {"op2_embeddings": sql.VECTORS, "base6_rules": sql.QUALITY, "base8_words": sql.LINES, "base10_spans": sql.PII, "base11_words": sql.SUBSTRINGS, "op13_resample": sql.RESAMPLE}
