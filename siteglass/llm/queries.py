"""Queries of the corpus operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siteglass.llm import byte_bpe, decontaminate, kn_quality, langid, media, ngram_join, pii, token_counts, toxicity, warc_chunks
from siteglass.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document, at a similarity of 0.8 or more of five-word sets. Nulls, empty texts and repeated rows as the operator states."""
    return ngram_join.join(spark, table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of each document. Nulls, empty texts and repeated rows as the operator states."""
    return pii.report(spark, table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document by the sentencepiece model. Nulls, empty texts and repeated rows as the operator states."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by the byte-level ranks, with digests of the ids and of the bytes decoded from them. Nulls, empty texts and repeated rows as the operator states."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document under the model of trusted text, the limits of its language, and whether it is kept. Nulls, empty texts and repeated rows as the operator states."""
    return kn_quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict of each document by the model that the labels train. Nulls, empty texts and repeated rows as the operator states."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.rate(spark, docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and benchmark hits of each document. Nulls, empty texts and repeated rows as the operator states."""
    return decontaminate.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document, by models of labelled documents that are not held out. Nulls, empty texts and repeated rows as the operator states."""
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of each page after it was written to archives and read back. Nulls, empty texts and repeated rows as the operator states."""
    return warc_chunks.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and spectral fingerprint of each document stored as WAV samples. Nulls, empty texts and repeated rows as the operator states."""
    return media.features(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_join, op2_pii, op3_token_counts, op4_byte_bpe, op5_kn_quality, op6_toxicity, op7_decontaminate, op8_langid, op9_warc, op10_media
)}
SQL: dict[str, str] = {"op1_ngram_join": ngram_join.SQL, "op7_decontaminate": decontaminate.SQL, "op9_warc": warc_chunks.SQL}
