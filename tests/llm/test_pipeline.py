"""The pipeline against its stages done by hand."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import DOCS, brute_groups, brute_passages, corpus
from tokenizers import Tokenizer

import corpus_pipeline
from landfall.llm import common, neardup, repeats, sql, tokens


def test_run_is_by_hand(spark, tmp_path):
    rows = {r[0]: r for r in corpus() if r[0] is not None}
    docs = spark.createDataFrame(list(rows.values()), DOCS).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()

    def ask(table, query):
        con.register("documents", pa.Table.from_pylist(table, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())])))
        return con.execute(query).fetchall()

    table = [{"doc_id": r[0], "text": r[1], "source": r[3]} for r in rows.values()]
    kept = {r[0] for r in ask(table, sql.op1_quality_rules) if r[-1]}
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.clean_lines(spark, docs, "").collect()}
    assert set(clean) == kept and all(set(clean[d].split("\n")) <= set(rows[d][1].split("\n")) for d in kept)
    table = [r | {"text": clean[r["doc_id"]]} for r in table if r["doc_id"] in kept]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in table])
    table = [r for r in table if groups[r["doc_id"]][1] == r["doc_id"]]
    for doc, (_, cut) in brute_passages([(r["doc_id"], r["text"]) for r in table]).items():
        row = next(r for r in table if r["doc_id"] == doc)
        row["text"] = repeats.cut_words(row["text"].encode(), [(k, k + 1) for k in sorted(cut)]).decode()
    table = [r for r in table if r["text"].split()]
    lib, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    texts = {r["doc_id"]: r["text"] for r in table}
    for doc, size, _, _, taken in ask(table, sql.op9_mixing):
        ids = lib.encode(texts[doc], add_special_tokens=False).ids
        want[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += taken // size if size else 0
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want and len(got) > 10


def test_stages_keep_the_columns(spark):
    """Columns with the names that operators add keep their values, in tables with and without rows."""
    clashing = {"kept": "k", "size": 5, "target": 0.5, "copies": 9, "clean_text": "own", "n_words": -1, "taken": "t", "component_id": 3, "whole": "w", "extra": "e", "_doc": 1, "removed": "r", "lost_percent": "l"}
    rows = {r[0]: r for r in corpus() if r[0] is not None}.values()
    docs = spark.createDataFrame([tuple(r[:5]) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({c: F.lit(v) for c, v in clashing.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.count() > 0 and out.select(*clashing).distinct().count() == 1, name
        assert out.select(*clashing).first().asDict() == clashing, name
        assert out.filter(F.length("text") != F.col("n_chars")).count() == 0 or name == "minhash_near_dedup"
        none = stage(spark, docs.limit(0), "")
        assert none.columns == docs.columns and none.count() == 0, name


def test_hot_rows_and_long_texts(spark):
    """A source, copies and rows of one id that hold most rows, and a text of 300,000 words."""
    rows = [(i, "copy of one text " * 30, "a") for i in range(40)] + [(100, " ".join(f"w{k % 5000}.{k}" for k in range(300_000)) + ".", "b"), (None, None, None), (107, "", "a"), (107, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "").collect()
        assert all(r.doc_id is None or r.text is not None for r in out), name
        if name == "minhash_near_dedup":
            assert sorted(r.doc_id for r in out if r.doc_id is not None) == [0, 100, 107, 107]


def test_stages_bound_their_batches(spark):
    """Rows that a caller read come in bounded batches too."""
    docs = spark.createDataFrame([(1, "one two three", "en", "web", 13)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, "")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == common.BATCH_BYTES


def test_parts_of_a_batch():
    """Texts are encoded in parts of bounded size, all rows in order, a longer text by itself."""
    texts = ["a" * n for n in (3, 3, 0, 9, 2, 2, 2)] + [None, "éé", "x" * 20]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = [p.to_pydict()["text"] for p in common.in_parts(batch, 1, 6)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 6 for p in parts) and ["a" * 9] in parts
    assert not list(common.in_parts(batch.slice(0, 0), 1, 6))
    codec = tokens.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(codec.path)
    words = pa.record_batch([pa.array([0, 1, 2]), pa.array(["the cat  sat", "", "on the mat"])], names=["doc_id", "text"])
    ids = [codec.encode_all(p.column(1))[0].tolist() for p in common.in_parts(words, 1, 1)]
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in ("the cat  sat", "", "on the mat")]


def test_idle_workers_hold_no_texts(spark):
    """What a worker remembers of texts goes with its task, and no task of the near-copy stage takes two workers."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), F.col("id")).alias("text"))
    assert tokens.byte_bpe(docs, path).agg(F.sum(F.length("ids_le"))).first()[0] > 0

    def held(batches):
        for _ in batches:
            codec = tokens.loaded(path)
            yield pa.record_batch([pa.array([len(codec.chunks.known) + len(codec.pieces.known) + len(codec.compatible) + codec.chunks.held + codec.pieces.held])], names=["held"])

    assert {r.held for r in spark.range(0, 64, 1, 64).mapInArrow(held, "held bigint").collect()} == {0}


def test_pairs_are_compared_before_components(spark, monkeypatch):
    """A stage with two steps in Python would take two workers a task."""
    plans = []
    real = neardup.connected_components
    monkeypatch.setattr(neardup, "connected_components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or real(links))
    sets = spark.createDataFrame([(k, np.arange(9, dtype=np.int64).tobytes()) for k in (1, 2, 3)], "node bigint, shingles binary")
    near = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "node bigint, component bigint")
    pairs = spark.createDataFrame([(2, 1), (3, 2)], "x bigint, y bigint")
    assert {tuple(r) for r in neardup._merged(near, pairs, sets, 85).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
