"""Repeated passages by sparse suffix arrays.

Of all suffixes only those at minimiser positions are kept: the smallest ten-word gram of every 50-word
window. Equal windows choose the same place, so two documents that share a passage share a kept suffix
inside it. Suffixes whose gram occurs in several documents are sorted, neighbours are compared, and the
matches are extended to the left, one word after the other, until all windows around the suffix are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, gram_hashes, hashed_words, mix64, stored, text_bytes

#: Words of the shortest passage that counts.
MIN_WORDS = 50
GRAM_WORDS = 10
#: Grams of one window, and so the words that a match can reach to the left of its suffix, less one.
REACH = MIN_WORDS - GRAM_WORDS + 1
#: A gram with more suffixes than this is not sorted in one task: its windows are grouped by hash instead.
HOT_ROWS = 50_000
#: Documents and spans to cut are broadcast together up to this number, and joined by shuffle beyond.
BROADCAST_SPANS = 500_000
#: Suffixes that one sort takes at once, as far as grams stay whole.
CHUNK_ROWS = 60_000

_NONE = np.iinfo(np.int64).min
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROW = MIN_WORDS + REACH - 1

SUFFIX = "key bigint, doc_id bigint, pos int, context binary, after int, before int, first_window int, windows array<bigint>"
SPAN = "doc_id bigint, start int, stop int, first_doc bigint"


def window_minimisers(grams: np.ndarray) -> np.ndarray:
    """For each window the place of its smallest gram, the leftmost of equal ones."""
    n = len(grams) - REACH + 1
    out, step = [], 1 << 16
    for at in range(0, n, step):
        part = grams[at : min(at + step, n) + REACH - 1]
        out.append(np.lib.stride_tricks.sliding_window_view(part, REACH).argmin(axis=1) + np.arange(at, min(at + step, n)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def window_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of every window, by differences of prefix sums."""
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.uint64)
    powers, undo = np.full(len(words), _BASE), np.full(len(words), np.uint64(pow(int(_BASE), -1, 1 << 64)))
    powers[0] = undo[0] = 1
    powers, undo = np.cumprod(powers), np.cumprod(undo)
    sums = np.zeros(len(words) + 1, np.uint64)
    sums[1:] = np.cumsum(mix64(words) * powers)
    return mix64((sums[MIN_WORDS:] - sums[:-MIN_WORDS]) * undo[: len(words) - MIN_WORDS + 1])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, docs, places = [], [], []
        for doc, words in zip(batch.column(0).to_pylist(), hashed_words(batch.column(1))):
            if doc is not None and len(words) >= MIN_WORDS:
                grams = gram_hashes(words, GRAM_WORDS)
                at = np.unique(window_minimisers(grams))
                keys.append(grams[at].astype(np.int64))
                docs.append(np.full(len(at), doc, np.int64))
                places.append(at.astype(np.int32))
        join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
        yield pa.record_batch([join(keys, np.int64), join(docs, np.int64), join(places, np.int32)], names=["key", "doc_id", "pos"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept suffixes of each document with the words around them, or their windows where the gram is hot."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("context", pa.binary()), ("after", pa.int32()), ("before", pa.int32()), ("first_window", pa.int32()), ("windows", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for doc, words, places, hot in zip(batch.column(0).to_pylist(), hashed_words(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if len(words) < MIN_WORDS:  # another row of this doc_id has the passage
                continue
            grams = gram_hashes(words, GRAM_WORDS)
            short = (words >> np.uint64(32)).astype(">u4")
            padded = np.concatenate([np.zeros(REACH - 1, ">u4"), short, np.zeros(MIN_WORDS, ">u4")])
            chosen = window_minimisers(grams) if any(hot) else None
            hashes = window_hashes(words).astype(np.int64) if any(hot) else None
            for at, is_hot in zip(places, hot):
                if at >= len(grams):
                    continue
                key = int(grams[at].astype(np.int64))
                if is_hot:
                    own = np.flatnonzero(chosen[max(0, at - REACH + 1) : at + 1] == at) + max(0, at - REACH + 1)
                    if len(own):
                        rows.append((key, doc, at, None, 0, 0, int(own[0]), hashes[own]))
                else:
                    left, right = padded[at : at + REACH - 1][::-1], padded[at + REACH - 1 : at + REACH - 1 + MIN_WORDS]
                    rows.append((key, doc, at, right.tobytes() + left.tobytes(), min(MIN_WORDS, len(words) - at), min(REACH - 1, at), None, None))
            if len(rows) >= 8192:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def match_sorted(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, context: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans (doc, start, stop, first doc) of the windows that several documents hold.

    Rows are suffixes sorted by key and by the words from their place on. Two rows share the first t words
    if no pair of neighbours between them shares fewer; with o words to the left equal too and t + o words
    in a window, they hold the same window.
    """
    m = len(keys)
    same = context[1:, :MIN_WORDS] == context[:-1, :MIN_WORDS]
    shared = np.where(same.all(axis=1), MIN_WORDS, same.argmin(axis=1))
    shared[keys[1:] != keys[:-1]] = 0
    first = np.full((m, REACH + 1), _NONE, np.int64)
    left = np.zeros(m, np.uint64)
    for o in range(REACH):
        if o:
            left = mix64(left * _BASE + context[:, MIN_WORDS + o - 1].astype(np.uint64) + np.uint64(1))
        t = MIN_WORDS - o
        run = np.concatenate([[0], np.cumsum(shared < t)]).astype(np.uint64)
        rows = np.flatnonzero((after >= t) & (before >= o))
        if not len(rows):
            continue
        label = mix64(left[rows] ^ (run[rows] * _BASE))
        order = np.argsort(label, kind="stable")
        rows, label = rows[order], label[order]
        starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        low, high = np.minimum.reduceat(docs[rows], starts), np.maximum.reduceat(docs[rows], starts)
        first[rows, o] = np.repeat(np.where(low != high, low, _NONE), np.diff(np.concatenate([starts, [len(rows)]])))
    flat = first.ravel()
    edges = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    ends = np.concatenate([edges[1:], [len(flat)]])
    keep = flat[edges] != _NONE
    edges, ends = edges[keep], ends[keep]
    row, o_low, o_high = edges // (REACH + 1), edges % (REACH + 1), (ends - 1) % (REACH + 1)
    return docs[row], (places[row] - o_high).astype(np.int32), (places[row] - o_low + MIN_WORDS).astype(np.int32), flat[edges]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours compared over the sorted suffixes of a task, in chunks that keep grams whole."""
    held: list[pa.RecordBatch] = []

    def solved(table: pa.Table) -> pa.RecordBatch:
        column = lambda name: table.column(name).to_numpy()
        context = np.frombuffer(b"".join(table.column("context").to_pylist()), ">u4").reshape(-1, _ROW).astype(np.uint32)
        found = match_sorted(column("key"), column("doc_id"), column("pos"), context, column("after"), column("before"))
        return pa.record_batch([pa.array(c) for c in found], names=["doc_id", "start", "stop", "first_doc"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_ROWS:
            whole = pa.Table.from_batches(held)
            keys = whole.column("key").to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield solved(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield solved(pa.Table.from_batches(held))


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        docs = batch.column(0).to_pylist()
        every, cut, firsts = [], [], []
        for doc, spans in zip(docs, batch.column(1).to_pylist()):
            every.append(_union([(s["start"], s["stop"]) for s in spans]))
            cut.append(_union([(s["start"], s["stop"]) for s in spans if s["first_doc"] != doc]))
            firsts.append(sorted({s["first_doc"] for s in spans if s["first_doc"] != doc}))
        shaped = lambda x: pa.array([[{"start": a, "stop": b} for a, b in r] for r in x], kind)
        total = lambda x: pa.array([sum(b - a for a, b in r) for r in x], pa.int64())
        yield pa.record_batch([pa.array(docs, pa.int64()), total(every), total(cut), shaped(every), shaped(cut), pa.array(firsts, pa.list_(pa.int64()))], names=["doc_id", "n_repeated", "n_removed", "spans", "removed", "first_docs"])


def _met(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a stored table of one row (key, n: its number of rows, ...) a key.

    Keys with more than HOT_ROWS rows are at most one in HOT_ROWS as many as rows, so these are broadcast,
    and rows with them stay where they are; the others meet by shuffle, no key with many rows among them.
    """
    many = F.broadcast(table.filter(F.col("n") > HOT_ROWS).drop("n"))
    rest = rows.join(many.select(key), key, "left_anti").join(table.filter(F.col("n") <= HOT_ROWS).drop("n").hint("merge"), key)
    return rows.join(many, key).unionByName(rest)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row a document that shares a passage of at least 50 words with another one.

    spans are all such passages as word ranges (start, stop), removed those that a document with a smaller
    id has too (first_docs), so the first holder keeps its own; n_repeated and n_removed count their
    words. White space between words makes no difference, letter case does. Null or short texts share
    nothing; rows with a null key take no part; rows of one key count as one document; other columns are
    not read. Documents that share nothing give no row, so an empty table gives none. Texts are read whole,
    however long.

    Grams are counted with partial aggregation before any suffix moves, and suffixes carry the words
    around them, so texts move once. What very many places share never meets in one task.
    """
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    anchors = stored(source.mapInArrow(given_back(_anchors), "key bigint, doc_id bigint, pos int"), "anchors")
    shared = anchors.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a <> b").select("key", "n", (F.col("n") > hot_rows).alias("hot"))
    places = _met(anchors, stored(shared, "shared"), "key").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "hot")).alias("p")).select("doc_id", F.col("p.pos").alias("pos"), F.col("p.hot").alias("hot"))
    suffixes = stored(source.join(places.hint("merge"), "doc_id").select("doc_id", "text", "pos", "hot").mapInArrow(given_back(_suffixes), SUFFIX), "suffixes")
    cold = suffixes.filter("context is not null").select("key", "doc_id", "pos", "context", "after", "before")
    spans = cold.repartition("key").sortWithinPartitions("key", "context", "doc_id", "pos").mapInArrow(given_back(_matched), SPAN)
    hot = suffixes.filter("windows is not null").select("doc_id", "first_window", F.posexplode("windows").alias("i", "window"))
    starts = hot.select("doc_id", "window", (F.col("first_window") + F.col("i")).alias("start"))
    held = starts.groupBy("window").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).filter("first_doc <> last_doc").select("window", "first_doc", "n")
    hot_spans = _met(starts, stored(held, "windows"), "window").select("doc_id", "start", (F.col("start") + MIN_WORDS).alias("stop"), "first_doc")
    each = spans.unionByName(hot_spans).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "first_doc")).alias("s"))
    ranges = "array<struct<start:int,stop:int>>"
    return each.mapInArrow(given_back(_merged), f"doc_id bigint, n_repeated bigint, n_removed bigint, spans {ranges}, removed {ranges}, first_docs array<bigint>")


def without_passages(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed passages cut out of their texts; a text of which no word is left goes.

    The words left keep the white space around them. Columns and rows without passages stay as they are.
    """
    cuts = found.filter("n_removed > 0").select(F.col("doc_id").alias("_doc"), F.col("removed").alias("_removed"))
    n, spans = cuts.agg(F.count("*"), F.coalesce(F.sum(F.size("_removed")), F.lit(0))).first()
    cuts = F.broadcast(cuts) if n + spans <= BROADCAST_SPANS else cuts.hint("merge")
    names = [f.name for f in docs.schema]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for raw, removed in zip(text_bytes(batch.column(at)), batch.column(len(names)).to_pylist()):
                if removed is None or raw is None:
                    texts.append(raw)
                    keep.append(True)
                else:
                    texts.append(cut_words(raw, [(r["start"], r["stop"]) for r in removed]))
                    keep.append(bool(texts[-1].split()))
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch(columns, names=names).filter(pa.array(keep))

    joined = docs.join(cuts, docs[key] == cuts["_doc"], "left").select(*[docs[c] for c in names], "_removed")
    return joined.mapInArrow(given_back(run), docs.schema)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans."""
    space = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \t\n\v\f\r", np.uint8))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    bounds = np.append(starts, len(text))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : bounds[min(a, len(starts))]])
        at = bounds[min(b, len(starts))]
    return b"".join([*out, text[at:]])
