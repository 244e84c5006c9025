"""Shared pieces: tables, the shared scratch folder, caches of bounded size and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Collection, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..shared import released, scratch, stored, until_exit  # noqa: F401

#: Bytes of one Arrow batch at most, but for a single longer text.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of the session are bounded by bytes from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, read in bounded batches."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in order, in parts with at most so many bytes in a string column, or of one longer row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, stop - at)
        at = stop


def mapped(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df with ``rows`` applied to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch)

    return df.mapInArrow(given_back(run), schema)


def given_back(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, after which a worker gives the memory that it no longer uses back: idle workers live on beside the next stages' ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
            trim(0)

    return run


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


class Kept:
    """What ``make`` gives for keys, remembered in about ``limit`` bytes, however long the keys are.

    ``make`` takes a list of different keys and returns the list of their values, which have a length.
    When half of the room is used up, what was not asked for since the last time goes: keys that come
    again and again stay, however many others come once.
    """

    def __init__(self, make: Callable[[list], list], limit: int):
        self.make, self.limit = make, limit
        self.forget()

    def of(self, keys: list) -> list:
        """The values of different keys."""
        found = list(map(self.known.get, keys))
        absent = [i for i, v in enumerate(found) if v is None]
        if not absent:
            return found
        fresh, missing = {}, []
        for i in absent:
            if (v := self.older.get(k := keys[i])) is None:
                missing.append(i)
            else:
                fresh[k] = found[i] = v
        if missing:
            for i, v in zip(missing, self.make([keys[i] for i in missing])):
                fresh[keys[i]] = found[i] = v
        size = self._bytes(fresh.keys(), fresh.values())
        if self.held + size > self.limit // 2:
            self.known, self.older, self.held = {}, self.known, 0
        if size <= self.limit // 2:
            self.known.update(fresh)
            self.held += size
        return found

    def forget(self) -> None:
        self.known: dict[Hashable, Any] = {}
        self.older: dict[Hashable, Any] = {}
        self.held = 0

    @staticmethod
    def _bytes(keys: Collection, values: Collection) -> int:
        return sum(map(len, keys)) + sum(map(len, values)) + 150 * len(keys)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's words begin and end, a number for each word, and the distinct words by number.

    Words are what ASCII white space parts; a null text has none. With ``lower`` A-Z count as a-z.
    """
    plain = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain) if lower else plain)
    coded = lists.values.dictionary_encode()
    offsets, codes, words = np.asarray(lists.offsets), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # white space at either end of a text
        real = codes != empty
        offsets, codes = np.concatenate([[0], np.cumsum(real)])[offsets], codes[real]
    return offsets, codes, words


def hashed_words(texts: pa.Array, lower: bool = False) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words in order; every distinct word of the batch is hashed once."""
    offsets, codes, words = split_words(texts, lower)
    distinct = words.cast(pa.binary()).to_pylist()
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def gathered(values: list[bytes], codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all codes one after the other as numbers of that kind, and where each one ends."""
    width = np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
    return gather(np.frombuffer(b"".join(values), kind), np.cumsum(sizes) - sizes, sizes, codes)


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands in ``pool`` at the places of all codes, one after the other, and where each one ends."""
    n = sizes[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    index = np.repeat((starts[codes] - (ends - n)).astype(kind), n)
    index += np.arange(total, dtype=kind)
    return pool[index], ends


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the hashes of single words; order counts."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mix64((out ^ words[k : k + count]) + _ODD)
    return out
