"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are rotated to their principal dimensions and put in the order of the grid cells (side epsilon)
that their leading dimensions fall in. Intervals of that order are joined recursively: two intervals whose
boxes lie further apart than epsilon are skipped whole, others are halved until they are small, and small
ones are compared in full. Cosines are taken in double precision on the vectors themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components, forest

COSINE = 0.93
#: Vectors that the principal dimensions are fitted on at most; they only steer the order.
SAMPLE = 4096
#: Leading dimensions with a grid, and with bounds for skipping.
GRID_DIMS, BOX_DIMS = 4, 16
#: Rows of an interval of the order that is joined as one, and of the parts that are compared in full.
INTERVAL, LEAF = 1024, 128

PLACED = "vec_id bigint, label string, high bigint, low bigint, cells array<bigint>, vector binary, place binary"
BLOCK = "block string, label string, cell0 bigint, cell1 bigint, low array<double>, high array<double>, rows int, ids binary, copies binary, vectors binary, places binary"


def unit_rows(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors can link at all, and these at unit length."""
    fine, rows = [], []
    for v in vectors:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
        norm = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.linalg.norm(x))
        fine.append(norm > 0 and np.isfinite(norm))
        if fine[-1]:
            rows.append(x / norm)
    return np.array(fine, bool), rows


def principal(vectors: DataFrame) -> np.ndarray | None:
    """Leading directions of a bounded sample, taken in order of a hash of the ids."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    _, rows = unit_rows([r[0] for r in sample])
    if not rows:
        return None
    width = Counter(map(len, rows)).most_common(1)[0][0]  # vectors of other dimensions are placed at zero
    same = np.array([r for r in rows if len(r) == width])
    _, _, directions = np.linalg.svd(same - same.mean(axis=0), full_matrices=False)
    return directions[:BOX_DIMS].T


def links_between(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float, own: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of two intervals with at least that cosine; own: both are the same interval, each pair once."""
    reach = 2 - 2 * cosine + 1e-9
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def join(i0: int, i1: int, j0: int, j1: int, same: bool) -> None:
        x, y = pa_[i0:i1], pb[j0:j1]
        if not same:
            gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
            if float(gap @ gap) > reach:
                return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            near = a[i0:i1] @ b[j0:j1].T >= cosine
            if same:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                found.append((i + i0, j + j0))
            return
        im, jm = (i0 + i1) // 2, (j0 + j1) // 2
        if same:
            join(i0, im, i0, im, True)
            join(im, i1, im, i1, True)
            join(i0, im, im, i1, False)
            return
        firsts = [(i0, im), (im, i1)] if i1 - i0 > LEAF else [(i0, i1)]
        seconds = [(j0, jm), (jm, j1)] if j1 - j0 > LEAF else [(j0, j1)]
        for i in firsts:
            for j in seconds:
                join(*i, *j, False)

    if len(a) and len(b):
        join(0, len(a), 0, len(b), own)
    return found


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Only vectors of one label (not null) and one dimension are compared; those that are null, empty, zero
    or hold null or non-finite components link with nothing. n_links counts the other vectors linked
    directly, where a vec_id with the same direction and label again is the same vector, so a repeated row
    adds no link. component_id is the smallest vec_id reachable, kept is vec_id = component_id. Rows of one
    vec_id share its component and the sum of its different vectors' links. A null vec_id takes no part and
    is kept; an empty table gives no rows; other columns are not read.

    Equal vectors fall together first, by digests and partial sums, and stand in the join as one with their
    number. A task joins two intervals and hands on counts for each vector and a forest of the links, never
    the pairs, so a group of copies gives rows in proportion to its size.
    """
    source = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").cast("string").alias("label"))
    usable = source.filter("vec_id is not null and label is not null and embedding is not null")
    directions = principal(usable)
    everyone = source.select("vec_id")
    if directions is None:
        return everyone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims, side = directions.shape[0], float(np.sqrt(2 - 2 * cosine))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, rows = unit_rows(batch.column(1).to_pylist())
            ids, labels = batch.column(0).to_numpy()[fine], batch.column(2).filter(pa.array(fine))
            widths = [len(r) for r in rows]
            spots = [r @ directions if len(r) == dims else np.zeros(directions.shape[1]) for r in rows]
            cells = np.floor(np.array(spots)[:, :GRID_DIMS] / side).astype(np.int64) if len(rows) else np.zeros((0, GRID_DIMS), np.int64)
            tags = pa.array([f"{x}/{w}" for x, w in zip(labels.to_pylist(), widths)], pa.string())
            packed = [np.asarray(r + 0.0, "<f8").tobytes() for r in rows]  # no negative zeros
            digests = [xxhash.xxh3_128_intdigest(x) for x in packed]
            longs = lambda x: pa.array(np.array(x, np.uint64).astype(np.int64))
            yield pa.record_batch(
                [pa.array(ids), tags, longs([d >> 64 for d in digests]), longs([d & 0xFFFFFFFFFFFFFFFF for d in digests]), pa.array(list(cells), pa.list_(pa.int64())), pa.array(packed, pa.binary()), pa.array([np.asarray(s, "<f8").tobytes() for s in spots], pa.binary())],
                names=["vec_id", "label", "high", "low", "cells", "vector", "place"],
            )

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive rows of one label, up to INTERVAL and within one first cell, as one row."""
        part, count, held = TaskContext.get().partitionId(), 0, []
        schema = pa.schema([("block", pa.string()), ("label", pa.string()), ("cell0", pa.int64()), ("cell1", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("rows", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("places", pa.binary())])

        def packed() -> pa.RecordBatch:
            spots = np.array([np.frombuffer(r[5], "<f8") for r in held])
            numbers = [np.array([r[k] for r in held], "<i8").tobytes() for k in (0, 3)]
            row = (f"{part:08d}-{count:08d}", held[0][1], held[0][2][0], held[-1][2][0], spots.min(axis=0), spots.max(axis=0), len(held), *numbers, b"".join(r[4] for r in held), b"".join(r[5] for r in held))
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == INTERVAL or held[0][1] != row[1] or held[0][2][0] != row[2][0]):
                    yield packed()
                    count, held = count + 1, []
                held.append(row)
        if held:
            yield packed()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids_a, num_a, vec_a, spot_a, ids_b, num_b, vec_b, spot_b in zip(*(c.to_pylist() for c in batch.columns)):
                load = lambda ids, num, vec, spot: (np.frombuffer(ids, "<i8"), np.frombuffer(num, "<i8"), np.frombuffer(vec, "<f8").reshape(len(ids) // 8, -1), np.frombuffer(spot, "<f8").reshape(len(ids) // 8, -1))
                (ia, na, va, sa), (ib, nb, vb, sb) = load(ids_a, num_a, vec_a, spot_a), load(ids_b, num_b, vec_b, spot_b)
                parts = links_between(va, vb, sa, sb, cosine, own)
                if not parts:
                    continue
                i, j = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                counts = np.bincount(i, nb[j], len(ia)).astype(np.int64), np.bincount(j, na[i], len(ib)).astype(np.int64)
                top = forest(zip(ia[i].tolist(), ib[j].tolist()))
                linked, number = np.concatenate([ia[counts[0] > 0], ib[counts[1] > 0]]), np.concatenate([c[c > 0] for c in counts])
                yield pa.record_batch([pa.array(linked), pa.array([top[x] for x in linked.tolist()], pa.int64()), pa.array(number)], names=["class", "root", "links"])

    placed_rows = stored(usable.mapInArrow(placed, PLACED), "placed")
    members = placed_rows.select("vec_id", "label", "high", "low").distinct()
    sizes = members.groupBy("label", "high", "low").agg(F.count("*").alias("copies"))
    one_each = placed_rows.groupBy("label", "high", "low").agg(F.first("cells").alias("cells"), F.first("vector").alias("vector"), F.first("place").alias("place"))
    classes = stored(one_each.join(sizes, ["label", "high", "low"]).withColumn("class", F.monotonically_increasing_id()), "classes")
    rows = classes.select("class", "label", "cells", "copies", "vector", "place")
    ordered = rows.repartitionByRange("label", "cells", "class").sortWithinPartitions("label", "cells", "class")
    blocks = stored(ordered.mapInArrow(blocked, BLOCK), "blocks")
    # a block lies in one first cell; partners are in the same one or the next
    box = blocks.select("block", "label", F.col("cell0").alias("cell"), "low", "high")
    other = box.select(F.col("block").alias("block_b"), "label", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("cell").alias("own_cell"))
    gap = F.expr(
        "aggregate(transform(sequence(0, size(low) - 1), i -> greatest(0D, low[i] - high_b[i], low_b[i] - high[i])), 0D, (s, x) -> s + x * x)"
    )
    pairs = (
        box.join(other, ["label", "cell"]).filter((F.col("own_cell") > F.col("cell")) | (F.col("block") <= F.col("block_b")))
        .filter(gap <= 2 - 2 * cosine + 1e-9).select("block", "block_b")
    )
    columns = ("ids", "copies", "vectors", "places")
    data = blocks.select("block", *columns)
    data_b = data.select(*[F.col(c).alias(f"{c}_b") for c in ("block", *columns)])
    work = pairs.join(data, "block").join(data_b, "block_b").select((F.col("block") == F.col("block_b")).alias("own"), *columns, *[f"{c}_b" for c in columns])
    found = stored(work.mapInArrow(joined, "class bigint, root bigint, links bigint"), "links")
    # from classes of equal vectors back to ids; the few ids with several vectors tie their classes together
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    own = members.join(classes.select("label", "high", "low", "class", "copies"), ["label", "high", "low"]).join(counts, "class", "left")
    each = stored(own.select("vec_id", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "members")
    by_id = each.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("class").alias("class"), F.max("class").alias("last"))
    several = each.join(by_id.filter("class <> last").select("vec_id", F.col("class").alias("top")), "vec_id").select(F.col("class").alias("u"), F.col("top").alias("v"))
    links = found.select(F.col("class").alias("u"), F.col("root").alias("v")).unionByName(several)
    groups = stored(connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("group")), "groups")
    least = each.join(groups, "class", "left").withColumn("group", F.coalesce("group", "class")).groupBy("group").agg(F.min("vec_id").alias("component"))
    placed_ids = by_id.join(groups, "class", "left").withColumn("group", F.coalesce("group", "class")).join(least, "group").select("vec_id", "n_links", "component")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return (
        everyone.join(placed_ids, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    )
