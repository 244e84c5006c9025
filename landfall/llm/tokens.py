"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last one of its encoding. An automaton over
the vocabulary lists the tokens that end at each byte; the one that is compatible with the unique last
token of the prefix before it is stored, and following these back-pointers from the end gives the ids.
Two tokens are compatible if the merge rules, applied to their joined bytes, give back just these two.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Kept, bounded, gather, gathered, given_back, in_parts

#: The pattern that splits a text into pieces before byte-level merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_SINGLE_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Ids that are decoded at once, or one text's.
_BLOCK = 1 << 18
#: Bytes of texts that are encoded and decoded at once, or one longer text's.
PART_BYTES = 2 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    shown = set(plain)
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class PrefixEncoder:
    """The vocabulary and merge rules of one tokenizer file.

    Tokens are kept as strings whose characters are symbols; ``end`` is the mark that the last symbol of
    a piece carries (empty if the file has none).
    """

    #: Pairs of tokens, and bytes of pieces and of chunks, that a worker remembers.
    PAIRS, PIECE_BYTES, CHUNK_BYTES = 300_000, 16 << 20, 48 << 20

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or spec["normalizer"] or not self.end and (spec["pre_tokenizer"] or {}).items() < {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items():
            raise ValueError(f"{path} is no byte-level tokenizer without normalizer")
        self.symbols = byte_symbols()
        self.compatible: dict[int, bool] = {}
        self.pieces = Kept(self._encoded, self.PIECE_BYTES)
        self.chunks = Kept(lambda chunks: self._joined([" " + c for c in chunks]), self.CHUNK_BYTES)
        self.names = {i: t for t, i in self.vocab.items()}

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self.compatible.clear()
        self.pieces.forget()
        self.chunks.forget()

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Tokens by their spelling; a token with the end mark is spelled with one closing symbol."""
        found = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            spelled, closing = self._spelling(token)
            found.add_word(spelled, (i, len(spelled) - closing))
        found.make_automaton()
        return found

    def _spelling(self, token: str) -> tuple[str, int]:
        if self.end and token.endswith(self.end):
            return token[: -len(self.end)] + "\n", 1
        return token, 0

    @cached_property
    def parts(self) -> dict[str, tuple[str, str, int]]:
        """Each merged token's two halves and its rank."""
        return {a + b: (a, b, rank) for (a, b), rank in sorted(self.ranks.items(), key=lambda x: -x[1])}

    def _edge(self, token: int, side: int) -> list[tuple[str, float]]:
        """The token, its last (side 1) or first (side 0) half, the half of that and so on, each with the rank of the merge that takes it up."""
        found, name, until = [], self.names[token], float("inf")
        while True:
            found.append((name, until))
            if name not in self.parts:
                return found
            halves = self.parts[name]
            name, until = halves[side], halves[2]

    def _fits(self, left: int, right: int) -> bool:
        """Whether no merge across the border of the two tokens comes before the merges that build them.

        A node at the border of one token is there until the merge that takes it up; two nodes that a
        rule joins before either is taken up are merged across the border. Of equal ranks the one
        further left goes first.
        """
        if len(self.compatible) >= self.PAIRS:
            self.compatible.clear()
        firsts = self._edge(right, 0)
        known = not any(
            (rank := self.ranks.get((a, b))) is not None and rank < a_until and rank <= b_until
            for a, a_until in self._edge(left, 1)
            for b, b_until in firsts
        )
        self.compatible[left << 20 | right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if not piece:
            return []
        spelled = "".join(map(self.symbols.__getitem__, piece))
        n = len(spelled)
        if not self.end and (single := self.vocab.get(spelled)) is not None:
            return [single]
        whole = spelled + "\n" if self.end else spelled
        last: list[int] = [-1] * (n + 1)
        back = [0] * (n + 1)
        fits, known = self._fits, self.compatible
        for at, (token, length) in self.automaton.iter(whole):
            stop = at + 1
            if stop > n:  # the closing symbol stands for no byte
                stop = n
            elif self.end and stop == n:
                continue  # the last symbol carries the end mark
            if last[stop] < 0:
                start = stop - length
                if start:
                    left = last[start]
                    if left < 0:
                        continue
                    ok = known.get(left << 20 | token)
                    if not (fits(left, token) if ok is None else ok):
                        continue
                last[stop], back[stop] = token, start
        if last[n] < 0:
            raise ValueError(f"no encoding for a piece of {n} bytes")
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        ids.reverse()
        return ids

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [array("I", self.encode_piece(x.encode())).tobytes() for x in pieces]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of short texts, each distinct piece encoded once."""
        parts = [self.split(x) for x in texts]
        distinct = list(dict.fromkeys([p for ps in parts for p in ps]))
        ids = dict(zip(distinct, self.pieces.of(distinct)))
        return [b"".join(map(ids.__getitem__, ps)) for ps in parts]

    @cached_property
    def split(self):
        return regex.compile(BYTE_LEVEL).findall

    @cached_property
    def markers(self):
        return regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers; the strings of added tokens give their ids."""
        parts, at = [], 0
        for m in self.markers.finditer(text) if self.markers else ():
            parts += [self._plain(text[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        """A single space between two other characters always starts a piece, so texts fall into chunks there."""
        if not text:
            return b""
        head, *rest = _SINGLE_GAP.split(text)
        distinct = list(dict.fromkeys(rest))
        ids = dict(zip(distinct, self.chunks.of(distinct)))
        return b"".join([*self._joined([head]), *map(ids.__getitem__, rest)])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (not null) one after the other, and where each text's stop.

        Where all spaces of a text are single ones, its chunks lie between them; each distinct chunk of the
        batch is looked up once. Other texts, and those with strings of added tokens, go one by one.
        """
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lists = pc.split_pattern(texts, " ")
        coded = lists.values.dictionary_encode()
        starts, codes = np.asarray(lists.offsets)[:-1], coded.indices.to_numpy(zero_copy_only=False).copy()
        distinct = coded.dictionary.to_pylist()
        odd = np.array([not c or c[0].isspace() or c[-1].isspace() for c in distinct])
        for marker in self.added:
            odd |= pc.match_substring(coded.dictionary, marker).to_numpy(zero_copy_only=False)
        lone = np.logical_or.reduceat(odd[codes], starts)
        chunks = iter(self.chunks.of([c for c, is_odd in zip(distinct, odd) if not is_odd]))
        values = [b"" if is_odd else next(chunks) for is_odd in odd]
        heads = iter(self._joined([distinct[c] for c in codes[starts[~lone]]]))
        values += [self.encode(texts[k].as_py()) if is_lone else next(heads) for k, is_lone in enumerate(lone)]
        keep = ~np.repeat(lone, np.diff(starts, append=len(codes)))
        keep[starts] = True
        codes[starts] = len(distinct) + np.arange(len(texts))
        ids, ends = gathered(values, codes[keep], "<u4")
        return ids, ends[np.append(np.cumsum(keep)[starts][1:] - 1, keep.sum()) - 1]

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        value = {s: b for b, s in enumerate(self.symbols)}
        out = [b""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for token, i in self.vocab.items():
            out[i] = bytes(value[c] for c in token)
        for token, i in self.added.items():
            out[i] = token.encode()
        return out

    @cached_property
    def _pool(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array(list(map(len, self.token_bytes)), np.int64)
        return np.frombuffer(b"".join(self.token_bytes), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8; bytes that are not UTF-8 become U+FFFD."""
        out: list[bytes] = []
        first = at = 0
        while first < len(ends):  # runs of about _BLOCK ids, or one long one
            last = max(first + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
            joined, stops = gather(*self._pool, ids[at : ends[last - 1]])
            bounds = np.concatenate([[0], stops])[np.concatenate([[at], ends[first:last]]) - at].tolist()
            raw = joined.tobytes()
            out += [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(bounds, bounds[1:])]
            first, at = last, int(ends[last - 1])
        return out


_loaded: dict[tuple[type, str], PrefixEncoder] = {}


def loaded(path: str, kind: type[PrefixEncoder] = PrefixEncoder) -> PrefixEncoder:
    """One encoder for each worker process and file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def byte_bpe(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text with a byte-level tokenizer file.

    Returns key, ids_le (the ids as little-endian unsigned 32-bit integers, binary) and decoded (string,
    made from the ids alone). A null or empty text has no ids and decodes to the empty text; rows with
    equal or null keys each give a row; other columns of docs are not read. Texts are encoded whole,
    however long; an empty table gives no rows. What a worker remembers of texts goes with its task. Use ``ids_array`` for ids as an array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(tokenizer)
        for batch in (part for whole in batches for part in in_parts(whole, 1, PART_BYTES)):
            flat, ends = codec.encode_all(batch.column(1).fill_null(""))
            texts = pa.array(codec.decode_all(flat, ends), pa.binary()).cast(pa.string())
            yield pa.record_batch([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)], pa.binary()), texts], names=[key, "ids_le", "decoded"])
            del flat, ends, texts
        codec.forget()

    bounded(docs.sparkSession)
    source = docs.select(key, text)
    return source.mapInArrow(given_back(run), f"`{key}` {source.schema[0].dataType.simpleString()}, ids_le binary, decoded string")


def ids_array(encoded: DataFrame) -> DataFrame:
    """encoded with a column ids (array of int) made from ids_le."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4").astype(np.int32) for x in batch.column("ids_le").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, ids array<int>")
