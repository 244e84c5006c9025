"""A corpus pipeline of five stages: clean, drop near copies, cut repeated passages, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the
next. All but the last return the columns of documents, whatever their names: columns that an operator adds
never take the place of one of these. A null text counts as empty. Rows with null or repeated ids are rows
like others, but for what a stage says. Texts are read whole, however long, and an empty table gives an
empty one. Each stage bounds the session's Arrow batches by bytes, whoever read its rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfall.llm import mixing, neardup, quality, queries, repeats
from landfall.llm.common import bounded, scratch, stored, table, until_exit

#: A list of ids is broadcast if it has no more rows than this, and joined by shuffle beyond.
BROADCAST_IDS = 500_000


def _packed(docs: DataFrame, *read: str) -> DataFrame:
    """What an operator reads of docs, with all but the text in one more column, out of the way of the names that it adds."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(others.alias("_row"), *[F.col(f"`{c}`") for c in read])


def _as_documents(df: DataFrame, like: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents from packed ones, n_chars counted anew."""
    fields = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return df.select(*[fields.get(c, F.col("_row").getField(c)).alias(c) for c in like.columns])


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines. Each row is judged alone; one without text goes."""
    bounded(spark)
    judged = quality.line_first_rules(_packed(docs, "text")).filter("kept")
    return _as_documents(judged, docs, "clean_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Rows of one id stay or go together, those without one stay."""
    bounded(spark)
    gone = stored(neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has too; a document of which no word is left goes. Rows without an id stay whole."""
    bounded(spark)
    found = stored(repeats.repeated_passages(docs), "passages")
    cut = repeats.without_passages(docs, found)
    return _as_documents(_packed(cut, "text"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, each source to its target; one without words is never needed for it."""
    bounded(spark)
    mixed = mixing.water_filling(_packed(docs, *{"doc_id", "text", "source"})).filter("copies > 0")
    return _as_documents(mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document of the mix, one row a document taken."""
    bounded(spark)
    return queries.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", clean_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the near-duplicate stages over whole tables in useful time; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(until_exit(spark, path))
    return STAGES[-1][1](spark, docs, sf_dir)
