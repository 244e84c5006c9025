"""WARC archives and their merged capture index.

Archives are written by Spark's own text writer, whose line separator is the end mark of a WARC record, so
they go to any file system that Spark can write to. Spark's text reader streams them back in pieces between
such marks, which are put together again by Content-Length, so a task holds one record at a time. The
index of each archive is a run sorted by URL key and timestamp; runs are cut at the bounds of ranges of
bounded size, and a loser tree merges the pieces of a range, which gives the capture histories in one
global order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, stored

#: Fixed values of the format.
VERSION = "WARC/1.1"
LINE = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Records in one archive at most.
RECORDS_A_FILE = 2000
#: Seconds since 1970 of the capture with id 0, for tables without a capture time, and seconds after which
#: times start again, so that the year has four digits for every id.
FIRST_CAPTURE, CAPTURE_SPAN = 1_577_836_800, 250_000_000_000
#: Payloads that others repeat are broadcast, as digest and page_id, up to this number, and joined by shuffle beyond.
BROADCAST_HEADS = 300_000
#: Rows of the index that one task merges, as far as a sample can tell.
ROWS_A_RANGE = 250_000
#: Rows sampled for each bound between the ranges of the index.
SAMPLE_A_RANGE = 20

RECORD_FIELDS = "page_id bigint, url string, captured string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, archive string, offset bigint"


def url_key(url: Column) -> Column:
    """Host parts in reverse, joined by commas, then a bracket and the path: captures of a site sort together."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(www\.)?", ""))
    host = F.regexp_replace(F.regexp_extract(plain, r"^([^/?#]*)", 1), r":\d+$", "")
    rest = F.regexp_replace(F.regexp_extract(plain, r"^[^/?#]*([^#]*)", 1), r"^$", "/")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def with_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, captured, payload (string), payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least REVISIT_BYTES the one with the largest page_id is the response, the
    others revisit it; rows that repeat that page_id are responses too. A null html is an empty payload, a
    null page_id never is one that others refer to unless all are null. Repeated rows are records of their
    own, an empty table gives none, other columns are not read. captured is the second with the
    number of the page_id (0 for null) after FIRST_CAPTURE, counted anew after CAPTURE_SPAN.

    Only digests, sizes and ids are grouped, with partial sums. Payloads stay where they are read; if there
    are too many repeated ones to broadcast, those that are long enough move once, by digest, and adaptive
    execution can split a digest that many pages share. Short and empty ones never move.
    """
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("payload"))
    sized = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    long = F.col("payload_bytes") >= REVISIT_BYTES
    heads = stored(
        sized.filter(long).groupBy(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).agg(F.max("page_id").alias("_first"), F.count("*").alias("_c")).filter("_c > 1").select("_d", "_n", "_first"),
        "heads",
    )
    same = (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_n"))
    if heads.count() <= BROADCAST_HEADS:
        joined = sized.join(F.broadcast(heads), same, "left")
    else:
        joined = sized.filter(long).join(heads.hint("merge"), same, "left").unionByName(sized.filter(~long), allowMissingColumns=True)
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    second = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CAPTURE_SPAN)) + FIRST_CAPTURE
    return joined.select(
        "page_id", "url", F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), "payload",
        "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _header_safe(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def write_archives(records: DataFrame, path: str) -> None:
    """Write records to gzip archives, in order of URL key and time within each.

    A header line holds what a reader needs of a revisit, whose payload is stored with its response.
    """
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    header = F.concat_ws(
        LINE,
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _header_safe(F.col("url")))),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.upper(F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    lines = records.withColumn("_k", url_key(F.col("url"))).sortWithinPartitions("_k", "captured", "page_id").select(F.concat(header, F.lit(RECORD_END), body).alias("value"))
    lines.write.options(lineSep=RECORD_END, compression="gzip", maxRecordsPerFile=RECORDS_A_FILE).text(path)


def parse(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes, int]]:
    """Archive, header fields (lower case), payload and offset of each record, from what stands between end marks.

    ``pieces`` are (archive, bytes) in order. A payload may hold the end mark itself, or part of one at its
    end, so pieces are joined until Content-Length and the mark after it are reached.
    """
    mark = RECORD_END.encode()
    name, at = None, 0
    for name_, piece in pieces:
        if name_ != name:
            name, at = name_, 0
        data = piece + mark
        while data and data != mark:  # the mark alone was added to the end of the archive
            stop = data.index(mark)
            first, *lines = data[:stop].decode().split(LINE)
            if first != VERSION:
                raise ValueError(f"{name}: no record at {at}")
            fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
            begin, size = stop + len(mark), int(fields["content-length"])
            parts, held = [data[begin:]], len(data) - begin
            while held < size + len(mark):
                name_, piece = next(pieces, (None, b""))
                if name_ != name:
                    raise ValueError(f"{name}: the record at {at} is cut off")
                parts.append(piece + mark)
                held += len(parts[-1])
            data = b"".join(parts)
            if data[size : size + len(mark)] != mark:
                raise ValueError(f"{name}: the record at {at} has no end mark")
            yield name, fields, data[:size], at
            at += begin + size + len(mark)
            data = data[size + len(mark) :]


def _number(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record with RECORD_FIELDS; digests of responses are checked against their payloads."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())])
        rows, held = [], 0
        for name, f, payload, at in parse(pieces(batches)):
            digest = f["warc-payload-digest"].removeprefix("sha1:").lower()
            size = int(f["x-payload-length"])
            if f["warc-type"] == "response":
                size, found = len(payload), hashlib.sha1(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"{name}: the payload at {at} does not have its digest")
            rows.append((_number(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-date"], f["warc-type"], _number(f.get("warc-refers-to")), size, digest, payload, name, at))
            held += len(payload)
            if len(rows) == 1024 or held >= BATCH_BYTES:
                yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    lines = spark.read.option("lineSep", RECORD_END).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.mapInArrow(run, RECORD_FIELDS)


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, so an item costs one path."""

    def __init__(self, runs: Sequence[Iterator], order: Callable):
        self.runs, self.order = [iter(r) for r in runs], order
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * max(k, 1)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.champion = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self.order(x), a) < (self.order(y), b)

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k and (item := self.heads[self.champion]) is not None:
            yield item
            run = self.champion
            self.heads[run] = next(self.runs[run], None)
            node = (run + k) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.champion = run


def _place(row: Sequence) -> tuple:
    """URL key, time and page, comparable with a null page first."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def merged_index(records: DataFrame) -> DataFrame:
    """The records' index in global order of URL key, time and page, with each capture's place in its history.

    An archive is a sorted run. The runs are cut at the bounds of ranges (a large URL key is cut by time
    and page too), more of them the more rows there are, so that a task holds about ROWS_A_RANGE rows, in
    columns; there a loser tree merges the runs' pieces. ``previous`` is the page captured before under the
    same key. The bounds of the ranges are fixed first, so that a task knows the last capture before its
    own from a table with one row a range. Only index fields move, never payloads.
    """
    index = stored(records.select(url_key(F.col("url")).alias("url_key"), "captured", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "archive", "offset"), "index")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    rows = max(index.count(), 1)
    usual = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(usual, -(-rows // ROWS_A_RANGE))
    sampled = sorted(map(_place, index.select("url_key", "captured", "page_id").sample(min(1.0, ranges * SAMPLE_A_RANGE / rows), 1).collect()))
    bounds = sorted({sampled[len(sampled) * k // ranges] for k in range(1, ranges)}) if sampled else []

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bisect_right(bounds, _place(row)) for row in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            yield batch.append_column("part", pa.array(parts, pa.int32()))

    parted = index.mapInArrow(dealt, f"{fields}, part int")
    last = sorted((r.part, r.last.url_key, r.last.page_id) for r in parted.groupBy("part").agg(F.max(F.struct("url_key", "captured", "page_id")).alias("last")).collect())
    ends = [part for part, _, _ in last]
    ranged = (parted.repartitionByRange(ranges, "part") if ranges > usual else parted.repartitionByRange("part")).sortWithinPartitions("archive", "url_key", "captured", "page_id", "offset")

    def rows_of(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in part.slice(at, 256).columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs stay in columns; only the rows under their cursors are taken out."""
        runs: dict[str, list[pa.RecordBatch]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            names = pc.run_end_encode(batch.column("archive"))
            at = 0
            for name, stop in zip(names.values.to_pylist(), names.run_ends.to_pylist()):
                runs.setdefault(name, []).append(batch.slice(at, stop - at))
                at = stop
        if schema is None:
            return
        out, before = [], None
        schema = schema.remove(schema.get_field_index("part")).append(pa.field("previous", pa.int64()))

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for row in LoserTree([rows_of(r) for r in runs.values()], lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[8])):
            if before is None and (k := bisect_left(ends, row[-1])):
                before = (last[k - 1][1], None, last[k - 1][2])
            out.append((*row[:-1], before[2] if before and before[0] == row[0] else None))
            before = row
            if len(out) == 8192:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return ranged.mapInArrow(run, f"{fields}, previous bigint")
