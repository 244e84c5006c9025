"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is its set of distinct five-word shingles. Two permutations of the 32-bit universe give all
signature coordinates: the first scatters the shingles, the second is shifted circularly by one place for
each further coordinate. Documents that agree in a band are candidates; only links confirmed on the whole
sets count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import given_back, gram_hashes, hashed_words, mix64, stored
from .components import connected_components

SHINGLE_WORDS = 5
#: Links from this percentage of shared shingles on.
PERCENT = 85
#: At 85 % a pair shares no band with a probability under one in a million.
BANDS, ROWS = 30, 6
#: Differences that share at least NEAR of their tokens agree in a band of them but for a probability under one in a million.
NEAR, NEAR_BANDS, NEAR_ROWS = 0.65, 72, 4

_CHUNK = 1 << 16


def shingles(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text's word hashes."""
    return np.unique(gram_hashes(words, min(width, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _permuted(x: np.ndarray, buffer: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    np.right_shift(x, 16, out=buffer)
    np.bitwise_xor(x, buffer, out=x)
    np.multiply(x, np.uint32(a), out=x)
    np.right_shift(x, 15, out=buffer)
    np.bitwise_xor(x, buffer, out=x)
    np.multiply(x, np.uint32(b), out=x)
    return x


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash coordinates of a set of 64-bit hashes."""
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    if not len(found):
        return low
    scattered = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    scattered = _permuted(scattered, np.empty_like(scattered), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    step = max(1, _CHUNK // size)
    for at in range(0, len(scattered), step):
        shifted = scattered[None, at : at + step] - shifts
        np.minimum(low, _permuted(shifted, np.empty_like(shifted), 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray, width: int = ROWS) -> np.ndarray:
    """One 64-bit key a band, different for different bands."""
    rows = low.reshape(-1, width).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows.shape[1]):
        key = mix64(key ^ rows[:, k])
    return key.astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, high, low, keys = [], [], [], []
        for found in map(shingles, hashed_words(batch.column(1), lower=True)):
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            sizes.append(len(found))
            high.append(digest >> 64)
            low.append(digest & 0xFFFFFFFFFFFFFFFF)
            keys.append(band_keys(signature(found)) if len(found) else np.zeros(0, np.int64))
        longs = lambda x: pa.array(np.array(x, np.uint64).astype(np.int64))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), longs(high), longs(low), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "high", "low", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([shingles(w).tobytes() for w in hashed_words(batch.column(1), lower=True)], pa.binary())], names=["node", "shingles"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, node, component, a, b): what only one of the two sets holds, with a number for the set a."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        diffs = [np.setxor1d(x, np.frombuffer(y, np.int64)).tobytes() for x, y in zip(sets, batch.column(4).to_pylist())]
        items = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
        yield pa.record_batch([*batch.columns[:3], pa.array(items, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(diffs, pa.binary())], names=["head", "node", "component", "item", "n", "diff"])


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., diff, most): what only one of diff and the list of most tokens (or null) holds."""
    for batch in batches:
        diffs = [np.setxor1d(np.frombuffer(x, np.int64), np.array(y or [], np.int64)) for x, y in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
        yield pa.record_batch([*batch.columns[:5], pa.array([d.tobytes() for d in diffs], pa.binary()), pa.array([len(d) for d in diffs], pa.int64())], names=["head", "node", "component", "item", "n", "diff", "s"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, node, item, tokens) with a row for each token."""
    for batch in batches:
        found = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        times = [len(x) for x in found]
        columns = [*(np.repeat(batch.column(k).to_numpy(), times) for k in range(3)), np.concatenate(found) if found else np.zeros(0, np.int64)]
        for at in range(0, len(columns[3]), 1 << 18):
            yield pa.record_batch([pa.array(x[at : at + (1 << 18)]) for x in columns], names=["head", "node", "item", "token"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., tokens) with the band keys of the tokens."""
    for batch in batches:
        keys = [band_keys(signature(np.array(x, np.int64).view(np.uint64), NEAR_BANDS * NEAR_ROWS), NEAR_ROWS) for x in batch.column(5).to_pylist()]
        yield pa.record_batch([*batch.columns[:5], pa.array(keys, pa.list_(pa.int64()))], names=["head", "node", "component", "u", "v", "keys"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            counts.append((int((both[1:] == both[:-1]).sum()), len(x), len(y)))
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (zip(*counts) if counts else ([], [], [])))], names=["x", "y", "shared", "nx", "ny"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (x, y) with the sizes of both sets and of what they share."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("b"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b").mapInArrow(given_back(_compared), "x bigint, y bigint, shared bigint, nx bigint, ny bigint")


def _merged(near: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (node, component) with the links among pairs (x, y) added.

    Pairs are written when they are compared: in one stage with the components' first step a task would take two workers.
    """
    tested = stored(_verified(pairs, sets), "verified")
    more = tested.filter(f"shared * 100 >= (nx + ny - shared) * {percent}").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return stored(connected_components(near.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")


def _apart(apart: DataFrame, sets: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Components with the links between documents that share a bucket's head (head, node, component).

    The documents of a head often have most in common, so they are told apart by their differences from
    what most of them hold: of two sets x and y with differences d(x) and d(y) from one centre, as many
    shingles stand in one only as tokens stand in one of d(x) and d(y) only. With
    v(x) = |d(x)| - |x| (100 - percent) / (100 + percent) they link if and only if d(x) and d(y) share
    (v(x) + v(y)) / 2 tokens or more. Tokens that one document alone holds cannot be shared. Hence

    * pairs with v(x) + v(y) <= 0 all link, and are in one component with the least v's document,
    * pairs that must share at least NEAR of their tokens agree in a band of MinHash values of these; in
      each such bucket all are compared with one first, then those that are still apart with each other,
    * other pairs share a token among the rarest of each, as many as v leaves, and are found by these.
    """
    if apart.isEmpty():
        return near
    rho = (100 - percent) / (100 + percent)
    several = stored(apart.groupBy("head").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("head"), "heads")
    centre = sets.join(several.select(F.col("head").alias("node")), "node").groupBy(F.col("node").alias("head")).agg(F.min("shingles").alias("b"))  # any set will do
    whole = apart.join(several, "head").join(sets.select("node", F.col("shingles").alias("a")), "node").join(centre, "head").select("head", "node", "component", "a", "b")
    kinds = "head bigint, node bigint, component bigint, item bigint, n bigint, diff binary"
    first = stored(whole.mapInArrow(given_back(_differences), kinds).dropDuplicates(["head", "node", "item"]), "differences")
    exploded = lambda df: df.select("head", "node", "item", "diff").mapInArrow(given_back(_exploded), "head bigint, node bigint, item bigint, token bigint")
    number = first.groupBy("head").agg(F.count("*").alias("nodes"))
    held = exploded(first).groupBy("head", "token").agg(F.count("*").alias("held"))
    most = stored(held.join(number, "head").filter("held * 2 > nodes").groupBy("head").agg(F.collect_list("token").alias("most")), "most")  # no longer than two sets
    centred = stored(first.join(most, "head", "left").select(*first.columns, "most").mapInArrow(given_back(_centred), f"{kinds}, s bigint"), "centred")
    tokens = stored(exploded(centred), "tokens")
    common = stored(tokens.groupBy("head", "token").agg(F.count("*").alias("held")).filter("held > 1"), "common")
    lists = tokens.join(common, ["head", "token"]).groupBy("head", "node", "item").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("t"))
    v = F.col("s") - F.col("n") * rho
    least = centred.groupBy("head").agg(F.min(F.struct(v.alias("v"), "node")).alias("l"))
    t = F.coalesce("t", F.array().cast("array<struct<held:bigint,token:bigint>>"))
    placed = stored(
        centred.join(lists, ["head", "node", "item"], "left").join(least, "head")
        .select("head", "node", "component", "s", F.size(t).cast("double").alias("u"), v.alias("v"), (F.col("n") * rho).alias("reach"), F.col("l.v").alias("v_least"), F.col("l.node").alias("nearest"), t.alias("t")),
        "placed",
    )
    sure = placed.filter("node <> nearest and v + v_least <= 1e-6").select(F.col("node").alias("x"), F.col("nearest").alias("y"))
    banded = placed.filter("u > 0").select("head", "node", "component", "u", "v", F.col("t.token").alias("t")).mapInArrow(given_back(_banded), "head bigint, node bigint, component bigint, u double, v double, keys array<bigint>")
    bucket = Window.partitionBy("head", "key")
    several_in = lambda df: df.withColumns({"a": F.min("component").over(bucket), "b": F.max("component").over(bucket)}).filter("a <> b").drop("a", "b")
    buckets = stored(several_in(banded.select("*", F.explode("keys").alias("key")).drop("keys")).withColumn("top", F.min("node").over(bucket)), "buckets")
    stars = buckets.filter("node <> top").select(F.col("node").alias("x"), F.col("top").alias("y"))
    near = _merged(near, sure.unionByName(stars).distinct(), sets, percent)

    now = near.select("node", F.col("component").alias("now"))
    fresh = lambda df: df.join(now, "node", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
    twin = lambda df, *keys: df.select(*keys, *[F.col(c).alias(f"{c}_x") for c in ("node", "component", "u", "v")])
    need = "(v_x + v) / 2"
    could = f"component_x <> component and v_x + v > 0 and {need} <= least(u_x, u) + 1e-6"
    share = f"{need} * {1 + NEAR}"  # against NEAR * (u_x + u): without a division, which could fail, all of it is part of the join's condition
    rest = stored(several_in(fresh(buckets.drop("top"))), "buckets")
    paired = twin(rest, "head", "key").join(rest, ["head", "key"]).filter(f"node_x < node and {could} and {share} >= {NEAR} * (u_x + u) - 1e-6")
    listed = fresh(placed).select("*", F.posexplode("t").alias("i", "e")).withColumns({"token": F.col("e.token"), "rank": F.col("i") + 1 + F.col("s") - F.col("u")})
    probes = listed.filter("rank <= s - greatest(1, ceil((v + v_least) / 2 - 1e-6)) + 1")
    index = listed.filter("rank <= floor(reach + 1e-6) + 1").select("head", "token", "node", "component", "u", "v")
    found = twin(probes, "head", "token").join(index, ["head", "token"]).filter(f"(v_x > v or v_x = v and node_x > node) and {could} and {share} < {NEAR} * (u_x + u)")
    pairs = paired.select("node_x", "node").unionByName(found.select("node_x", "node"))
    return _merged(near, pairs.select(F.greatest("node_x", "node").alias("x"), F.least("node_x", "node").alias("y")).distinct(), sets, percent)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts of fewer than five words are one shingle; texts without words (or null) have none and no links.
    component_id is the smallest doc_id reachable by links, kept is doc_id = component_id. Rows of one
    doc_id count as one document and are kept or not together; a null doc_id has no links, a null
    component_id and is kept. Other columns of docs are not read.

    Equal sets fall together first, by a digest with partial aggregation, so groups of copies never meet.
    In each band's bucket every member is compared with the one that shares most buckets with others, the
    bucket's head. What is then still apart goes by ``_apart``: every candidate pair is tested, ruled out
    by a bound or already in one component. An empty table gives no rows; texts are read whole.
    """
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = stored(source.mapInArrow(given_back(_signed), "doc_id bigint, n_shingles bigint, high bigint, low bigint, bands array<bigint>"), "signatures")
    classes = stored(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stored(banded.join(buckets, "key"), "buckets")
    reach = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    heads = shared.join(reach, "node").groupBy("key").agg(F.max_by("node", F.struct("reach", -F.col("node"))).alias("head"))
    members = stored(shared.join(heads, "key"), "members")
    stars = members.filter("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y")).distinct()
    wanted = members.select("node").distinct()
    sets = stored(source.join(wanted.hint("merge"), source.doc_id == wanted.node).select("node", "text").mapInArrow(given_back(_sets), "node bigint, shingles binary"), "sets")
    first = stored(_verified(stars, sets), "verified")
    linked = F.expr(f"shared * 100 >= (nx + ny - shared) * {percent}")
    links = first.filter(linked).select(F.col("x").alias("u"), F.col("y").alias("v"))
    near = stored(connected_components(links), "components")

    labelled = members.join(near, "node", "left").select("key", "node", "n", "head", F.coalesce("component", "node").alias("component"))
    split = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    apart = labelled.filter("node <> head").join(split, "key").select("head", "node", "component").distinct()
    final = _apart(stored(apart, "apart"), sets, near, percent)
    placed = classes.select("high", "low", "node").join(final, "node", "left").select("high", "low", F.coalesce("component", "node").alias("component"))
    everyone = signed.select("doc_id", "n_shingles", "high", "low").join(placed, ["high", "low"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("doc_id")))
    return everyone.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
