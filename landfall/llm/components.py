"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, released, stored

MAX_ROUNDS = 60
#: Up to this many links, once tasks have replaced theirs by stars, the driver finds the components at once:
#: a round of steps takes eight stages, however few links there are.
FEW_LINKS = 100_000
#: From this many links on the smallest neighbours are written before they are joined, so that both sides
#: are plain reads and adaptive execution can split a node with very many links over tasks.
SPLIT_LINKS = 5_000_000


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's smallest reachable node, for links that fit into memory."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task, batch after batch, replaced by stars of their own components."""
    for batch in batches:
        tops = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        rows = [(x, t) for x, t in tops.items() if x != t]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (u, v: bigint).

    Nodes without links do not occur. Each round is written to the shared folder, so neither lineage nor a
    lost executor undoes it; no task holds more than one batch of links, nor the driver more than FEW_LINKS.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(edges.mapInArrow(given_back(_contracted), "u bigint, v bigint").distinct(), "links")
    seen = None
    if (n := edges.count()) <= FEW_LINKS:
        few = edges.toArrow()
        released(edges)
        tops = forest(zip(few.column(0).to_pylist(), few.column(1).to_pylist()))
        found = pa.table([pa.array(tops.keys(), pa.int64()), pa.array(tops.values(), pa.int64())], names=["node", "component"])
        return edges.sparkSession.createDataFrame(found, "node bigint, component bigint")
    plain = (lambda df: df) if n < SPLIT_LINKS else (lambda df: stored(df, "lowest"))
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = plain(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = plain(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, stored(small.select("e.*").filter("u <> v").distinct(), "links")
        released(before)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
