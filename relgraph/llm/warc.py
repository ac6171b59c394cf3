"""WARC archives, and an index of capture histories by external merging.

Writing: payload digests are grouped, so the smallest id of each becomes the response and the others revisit it; digests, not
payloads, meet in that shuffle. Which rows revisit is broadcast where that is at most `SMALL` rows, so no payload is shuffled;
beyond that, rows and their payloads meet the revisits in a join. Records are then built row by row and written by Spark's text writer, whose line
separator is the blank line that ends a record (CRLF CRLF), so files are plain WARC 1.1 wherever Spark can write, and a
lost task is written anew. Reading splits at the start of the next record. A payload that holds that very mark is sent in
chunks (HTTP transfer coding) which break it, so every record is read back whole; `Content-Length` is verified.

Index: captures are read from the archives, keyed by URL in sort-friendly form (SURT), and each task sorts its own ones: a run.
The runs are written to the shared folder. Captures are dealt to ranges of (key, timestamp, id) of about `RANGE` captures at
most, so that one URL with a third of all captures is spread as well and a task's memory has a bound; each range gets its
slices of the k runs one after another, as Spark sorts them (on disk, if need be), and merges them with a tournament tree of
losers, one comparison per level, reading ahead `AHEAD` rows of each slice.

Edge cases: null payloads are empty; an empty payload is one like others; equal ids with equal payloads are responses both; null
URLs have an empty key and no target header, null ids no page header and come last; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, pairwise
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, kept, kept_with, mapped, prepare, scratch, slices, utf8

END = "\r\n\r\n"
START = "WARC/1.1\r\n"
MARK = (END + START).encode()
DATE = "2024-01-01T00:00:00Z"
#: Rows of revisits (ids and digests) that are broadcast, captures in a range, and rows of a slice that become objects at once.
SMALL, RANGE, AHEAD = 100_000, 200_000, 256


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def surt(url: str | None) -> str:
    """A URL's key: host labels in reverse, without scheme, `www`, default port and fragment; query kept."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) if host else ""
    if port and port not in (80, 443):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "") if host or parts.path else ""


def _body(payload: bytes) -> bytes:
    """HTTP response of a payload; in chunks if it holds the mark between records."""
    if MARK not in payload:
        return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    out, at = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"], 0
    while at < len(payload):
        found = payload.find(MARK, at)
        upto = len(payload) if found < 0 else found + len(END) + 4  # inside of the mark's word
        part = payload[at:upto]
        out.append(b"%x\r\n%s\r\n" % (len(part), part))
        at = upto
    return b"".join(out) + b"0\r\n\r\n"


def _payload(http: bytes) -> bytes:
    head, _, body = http.partition(b"\r\n\r\n")
    if b"\r\ntransfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        upto = body.index(b"\r\n", at)
        n = int(body[at:upto], 16)
        if not n:
            return b"".join(out)
        out.append(body[upto + 2 : upto + 2 + n])
        at = upto + 4 + n


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> str:
    """A record without the CRLF CRLF at its end."""
    name = lambda x: f"<urn:page:{x}>"
    block = b"" if refers_to is not None else _body(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)), ("X-Payload-Length", str(len(payload)))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return START + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + block.decode("utf-8", "surrogateescape")


def parse(raw: bytes) -> dict:
    """Fields of a record as the reader splits them: without its first line or its end, or with them."""
    raw = raw.removeprefix(START.encode())
    head, _, block = raw.partition(b"\r\n\r\n")
    h = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
    length = int(h["content-length"])
    if len(block) < length:
        raise ValueError(f"record {h.get('warc-record-id')} is cut: {len(block)} of {length} bytes")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    revisit = h["warc-type"] == "revisit"
    payload = None if revisit else _payload(block[:length])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and sha1_base32(payload) != digest:
        raise ValueError(f"record {h.get('warc-record-id')} doesn't match its digest")
    return {
        "page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "date": h["warc-date"], "record_type": h["warc-type"], "payload_digest": digest,
        "payload_bytes": int(h["x-payload-length"]) if revisit else len(payload), "refers_to": number(h.get("warc-refers-to")), "payload": payload,
    }


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> None:
    """Writes a record per row to `path`. Payloads under `least` bytes are always responses."""
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    date = F.coalesce(F.date_format(date_col, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DATE)) if date_col else F.lit(DATE)
    rows = pages.select(F.coalesce(id_col, F.lit(NO_ID)).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), date.alias("date"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    digests = kept(rows.where(F.octet_length("payload") >= least).select("id", "sha"))
    first = digests.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeats, found = kept_with(digests.join(first, "sha").where("id <> first").select("id", "sha", F.col("first").alias("refers_to")).distinct(), F.lit(1))
    repeats = F.broadcast(repeats) if found <= SMALL else repeats
    out = rows.join(repeats, ["id", "sha"], "left").select("id", "url", "payload", "date", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload"):
                made = []
                for page, url, body, day, ref in zip(batch["id"].to_pylist(), batch["url"].to_pylist(), utf8(batch["payload"]), batch["date"].to_pylist(), batch["refers_to"].to_pylist(), strict=True):
                    made.append(record(None if page == NO_ID else page, url, body, sha1_base32(body), ref, day))
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    mapped(out, run, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", END + START).text(path).select("value", F.col("_metadata.file_name").alias("archive"))


READ = "page_id long, url string, date string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of archives under `path`, `archive` being the file's name; with `payloads`, a `payload` column (null for revisits)."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    types = [kinds[x.split()[1]] for x in READ.split(", ")] + [pa.binary()] * payloads
    names += ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "value"):
                found = [parse(x) | {"archive": name} for x, name in zip(utf8(batch["value"]), batch["archive"].to_pylist(), strict=True) if x.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True)], names=names)

    return mapped(_records(spark, path), run, READ + ", payload binary" * payloads)


class LoserTree:
    """Merges sorted sequences: inner nodes hold the losers, so the next smallest costs one path of comparisons."""

    def __init__(self, runs: Iterable[Iterable], key: Callable):
        self.sources = [iter(r) for r in runs]
        self.key = key
        self.k = len(self.sources)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k  # None: the run has ended
        for i in range(self.k):
            self._advance(i)
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k else -1

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.sources[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y or x == y and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.keys[self.winner] is not None:
            yield self.heads[self.winner]
            i = self.winner
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


INDEX = "url_key string, " + READ


def _order(row: dict) -> tuple:
    return row["url_key"], row["date"], row["page_id"] is None, row["page_id"] or 0


def index(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """Captures in order of (url_key, date, page_id) over all partitions; runs come from the tasks that read them."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch["url"].to_pylist()], pa.string()), *(batch[n] for n in names[1:])], names=names)

    order = [F.col("url_key"), F.col("date"), F.coalesce("page_id", F.lit(NO_ID))]
    keyed = mapped(records.select(*names[1:]), key, INDEX).withColumn("run", F.spark_partition_id())
    runs, n = kept_with(keyed.sortWithinPartitions(*order), F.lit(1))
    parts = ranges or max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    dealt = runs.repartitionByRange(parts, *order).sortWithinPartitions("run", *order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        run = rows["run"].to_numpy()
        starts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]

        def slice_(a: int, b: int) -> Iterator[tuple]:
            for i in range(a, b, AHEAD):
                part = rows.slice(i, min(AHEAD, b - i)).select(["url_key", "date", "page_id"]).to_pylist()
                for j, row in enumerate(part, i):
                    yield _order(row), j

        tree = LoserTree([slice_(a, b) for a, b in pairwise(starts)], lambda x: x[0])
        rows = rows.select(names)
        merged_ = (at for _, at in tree)
        while part := list(islice(merged_, 10_000)):
            yield from rows.take(pa.array(part)).combine_chunks().to_batches()

    return mapped(dealt, merge, INDEX)


def digest(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of op9's contract: archives are written, read back, verified and indexed.

    The table has no time of capture, so ids stand in for seconds of a year; captures of one URL are ordered by them.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    dated = pages.select("page_id", "url", "html", F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("page_id", F.lit(31_536_000))).alias("captured"))
    write(dated, path, date_col="captured")
    return index(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def merged(runs: list[list], key: Callable) -> list:
    """What a merge gives, for tests."""
    return list(heapq.merge(*runs, key=key))
