"""The registered queries opN_<name>: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, html, licenses, mixing, neardup, quality, repeats, tokens, vectors, warc
from .common import scratch, table, until_exit


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    return tokens.byte_bpe(docs, tokenizer).select(
        "doc_id",
        F.expr("cast(octet_length(ids_le) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the line-first rules for every document."""
    judged = quality.line_first_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum, from the ORC files that its ids were written to."""
    path = scratch(spark, "ids")
    binary.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return binary.checksums(binary.read_ids(spark, until_exit(spark, path)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mixing.water_filling(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page, in the order of the merged capture index."""
    path = scratch(spark, "warc")
    warc.write_archives(warc.with_records(table(spark, sf_dir, "pages")), path)
    merged = warc.merged_index(warc.read_archives(spark, until_exit(spark, path)))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share passages, with the passages' places and their first holders."""
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and group."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document states, if any."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))
