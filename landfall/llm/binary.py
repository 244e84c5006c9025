"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are ranged by id over files, so each file holds one interval of ids in ascending order. Readers
can take stripes side by side, and a look-up by id skips stripes and row groups by their statistics and
Bloom filters.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, gathered, split_words, stored
from .tokens import byte_symbols

#: Settings of the ORC writer.
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}
#: Bytes of words whose ids a worker remembers.
WORD_BYTES = 192 << 20
#: The files' first places are broadcast up to this number of files, and joined by shuffle beyond.
BROADCAST_FILES = 200_000
#: The normalizer and splitter that the short ways below are right for, as tokenizer files state them.
LOWER_CASE = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: WORD_PIECES with its letter, number and space classes written out for Latin-1.
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0A-Za-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Which Latin-1 characters are no letter, number or space.
_SIGNS = np.array([LATIN_PIECES.fullmatch(chr(c) * 2) is not None and not chr(c).isalpha() for c in range(256)])

_tokenizers: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Ids of texts, with those of words remembered.

    The short way is taken only if the file's normalizer and splitter are the ones it is made for: they
    never join what white space parts, so each distinct word is encoded once. On Latin-1 words that
    normalizer only lower-cases and the splitter is LATIN_PIECES, so their pieces go straight to the
    library's merge model. With any other file whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.known = (
            spec["normalizer"] == LOWER_CASE
            and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": WORD_PIECES}, "Removed", True)
            and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
            and spec["model"]["type"] == "BPE"
            and all(not re.search(r"\s", t["content"]) and t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        )
        self.symbols = byte_symbols()
        self.words = Kept(self._encoded, WORD_BYTES)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        merged, symbols, out = self.model.tokenize, self.symbols, []
        for word in words:
            if word.isascii() and word.isalpha():
                out.append(array("I", [t.id for t in merged(word.lower())]).tobytes())
            elif "<|" in word or not (word.isascii() or max(word) <= "\xff"):
                out.append(self._whole(word))
            else:
                pieces = ["".join(map(symbols.__getitem__, x.encode())) for x in LATIN_PIECES.findall(word.lower())]
                out.append(array("I", [t.id for x in pieces for t in merged(x)]).tobytes())
        return out

    def _spaced(self, text: str) -> str:
        """Fewer different words with the same pieces: a Latin-1 text in lower case and, if no two signs stand side by side, with spaces around full stops and commas."""
        try:
            signs = _SIGNS[np.frombuffer(text.encode("latin-1"), np.uint8)]
        except UnicodeEncodeError:
            return text
        if "<|" in text:
            return text
        return text.lower() if (signs[1:] & signs[:-1]).any() else text.lower().replace(".", " . ").replace(",", " , ")

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's with ``end`` after them, and where each text's stop."""
        if self.known:
            offsets, codes, words = split_words(pa.array([self._spaced(t or "") for t in texts], pa.string()))
            values = self.words.of(words.to_pylist())
        else:
            offsets, codes, values = np.arange(len(texts) + 1), np.arange(len(texts)), [self._whole(t or "") for t in texts]
        if end is not None:
            codes, offsets = np.insert(codes, offsets[1:], len(values)), offsets + np.arange(len(offsets))
            values.append(np.uint32(end).tobytes())
        ids, ends = gathered(values, codes, "u4")
        return ids, np.concatenate([[0], ends])[offsets[1:]]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, each with end_id after it, in ascending order of key.

    Columns of the files: doc_id, ids (array of int), n_tokens, part and offset (the ids before the
    document within its file). A null or empty text has the end id alone. Rows with equal keys stay next
    to each other in order of their texts; null keys come first; other columns of docs are not read.
    Texts are encoded whole, however long. An empty table gives files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = PieceEncoder(tokenizer)
        encoder = _tokenizers[tokenizer]
        part, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            flat, ends = encoder.encode(batch.column(1).to_pylist(), end_id)
            sizes = np.diff(ends, prepend=0)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
            yield pa.record_batch(
                [batch.column(0), ids, pa.array(sizes), pa.array(np.full(len(sizes), part, np.int32)), pa.array(offset + ends - sizes)],
                names=["doc_id", "ids", "n_tokens", "part", "offset"],
            )
            offset += int(ends[-1]) if len(ends) else 0

    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ranged = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = ranged.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>, n_tokens bigint, part int, offset bigint")
    coded.write.options(**ORC_OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with start, the ids of all documents before."""
    rows = spark.read.orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sums.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "bases")  # one row a file
    few = bases.count() <= BROADCAST_FILES
    return rows.join(F.broadcast(bases) if few else bases, "part").select("doc_id", "ids", (F.col("base") + F.col("offset")).alias("start"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all counted on the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            at, flat = np.asarray(column.offsets), np.asarray(column.values).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids", "start").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
