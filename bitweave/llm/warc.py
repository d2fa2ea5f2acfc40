"""Web archives (WARC 1.1) and their capture index, merged from sorted runs.

Every task writes gzip records, one member each, and sorts the captures of its
own files by URL key, timestamp and record: a run. The runs are merged like an
external sort: splitters taken from the runs cut the key space into ranges, a
task gets its range's piece of every run, in order as it is, and a loser tree
merges the pieces. Ranges follow each other, so the index files hold the
globally ordered history.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm.common import FileWriter, bounded_batches, lean, open_fs, put_file, scratch, stored, tasks_of

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:bitweave:capture:"
#: Captures without a time of their own are dated so, plus their id in seconds.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: An archive file is closed once it is larger.
ROLL = 1 << 30
#: Captures of a range and splitters sampled for each, about; captures of a piece that are read at a time.
RANGE, SAMPLE, BATCH = 500_000, 20, 1000
CAPTURE = "urlkey string, time string, id long, file string, offset long, length long, type string"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The host's labels from the right, then path and query, in lower case: a key that sorts by site."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/")
    return (key + ("?" + parts.query if parts.query else "")).lower()


def record(id_: int | None, url: str, time: datetime, payload: bytes, refers_to: int | None) -> bytes:
    """One response record, or a revisit without the payload if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{'' if id_ is None else id_}>", f"WARC-Target-URI: {quote(url, safe="!#$%&'()*+,/:;=?@[]~")}", f"WARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Read one record back; a payload that disagrees with its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    name = lambda key: fields[key].strip("<>").removeprefix(NAME)
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    out = {"id": int(name("warc-record-id")) if name("warc-record-id") else None, "type": fields["warc-type"], "digest": stated, "bytes": size, "refers_to": None}
    if out["type"] == "revisit":
        out["refers_to"] = int(name("warc-refers-to"))
    elif digest(payload) != stated or len(payload) != size:
        raise ValueError(f"record {out['id']}: the payload disagrees with its digest")
    return out


class LoserTree:
    """Merge k sorted runs: each inner node holds the loser of its match, the winner goes on."""

    def __init__(self, runs: Iterable[Iterable]) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * max(k, 1)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = (winners[1] if k > 1 else 0) if k else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x < y or x == y and a < b)

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + k) // 2
            while node:
                if self._before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _originals(pages: DataFrame, least: int) -> DataFrame:
    """(id, digest, refers_to) of the pages that repeat the payload of a page with a smaller id."""
    light = pages.select("id", "digest").where((F.col("bytes") >= least) & F.col("id").isNotNull())
    first = light.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("digest", "first")
    return light.join(first, "digest").where("id > first").select("id", "digest", F.col("first").alias("refers_to")).distinct()


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, path: str | None = None) -> dict:
    """Write a record for each page, and the index of all captures.

    Of the pages with equal payloads of at least `least_bytes`, the one with
    the smallest id is a response and the others revisit it; rows that repeat
    that id and payload are responses as well. Null html is empty and a null
    url is about:blank. A page with a null id is a response that none refers to.
    Extra columns are not read. An empty table gives no files.

    Returns the path and the index, a DataFrame of captures in ranges of the
    global order (columns of CAPTURE with range and place).
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    path = path or scratch(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")).alias("url"), html.alias("html"))
    pages = pages.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    joined = pages.join(_originals(pages, least_bytes), ["id", "digest"], "left").select("id", "url", "html", "refers_to")

    def write(batches):
        task, captures = TaskContext.get().partitionId(), []
        source = ((i, u, h, r) for b in batches for i, u, h, r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row, number = next(source, None), 0
        while row is not None:
            name = f"captures-{task:06d}-{number:03d}.warc.gz"

            def members():
                nonlocal row
                at = 0
                while row is not None and at < ROLL:
                    i, url, page, refers_to = row
                    time = EPOCH + timedelta(seconds=(i or 0) % (1 << 31))
                    whole = gzip.compress(record(i, url, time, page.encode("utf-8", "surrogatepass"), refers_to), 1, mtime=0)
                    captures.append((url_key(url), time.strftime("%Y%m%d%H%M%S"), -1 if i is None else i, name, at, len(whole), "response" if refers_to is None else "revisit"))
                    at += len(whole)
                    yield whole
                    row = next(source, None)

            put_file(f"{path}/{name}", members())
            number += 1
        captures.sort()
        for k in range(0, len(captures), 20_000):
            part = captures[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(part), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), _TYPES, strict=True))], names=["run", *_NAMES])

    runs = stored(joined.mapInArrow(lean(write), f"run long, {CAPTURE}"), "runs")
    return {"path": path, "index": merge_runs(runs, path)}


_NAMES = [x.split(" ")[0] for x in CAPTURE.split(", ")]
_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in CAPTURE.split(", ")]


def merge_runs(runs: DataFrame, path: str) -> DataFrame:
    """Merge sorted runs of captures into one global order, and write its index files.

    runs: run and the columns of CAPTURE, each run in order. Splitters taken
    from the runs cut the keys into ranges of about RANGE captures. Every run
    is cut at them, a piece goes to its range whole and compressed, and a range
    merges its pieces as streams, so it holds no more than its compressed
    pieces and a batch of each. A range that holds one URL's many captures is
    cut by time and id like any other.
    """
    spark = runs.sparkSession
    total = runs.count()
    ranges = max(tasks_of(spark), -(-total // RANGE))
    stride = max(1, total // (ranges * SAMPLE))
    some = runs.where(F.pmod(F.xxhash64("file", "offset"), F.lit(stride)) == 0).select("urlkey", "time", "id")
    keys = sorted(tuple(r) for r in some.collect())  # about SAMPLE for each range
    splits = [keys[len(keys) * r // ranges] for r in range(1, ranges)] if keys else []

    def deal(batches):
        run, held = None, []

        def pieces():
            """The run's pieces: it is in order, so a piece is a stretch of it."""
            table = pa.Table.from_batches(held)
            key = list(zip(*(table.column(c).to_pylist() for c in _NAMES[:3]), strict=True))
            at, out = 0, []
            while at < len(key):
                where = bisect_right(splits, key[at])
                stop = bisect_left(key, splits[where], at) if where < len(splits) else len(key)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(table.slice(at, stop - at), BATCH)
                out.append((where, sink.getvalue().to_pybytes()))
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["range", "piece"])

        for batch in batches:
            numbers, at = batch.column(0).to_numpy(), 0
            while at < len(numbers):
                if numbers[at] != run:
                    if held:
                        yield from pieces()
                    run, held = numbers[at], []
                stop = at + int((numbers[at:] != run).argmax()) if (numbers[at:] != run).any() else len(numbers)
                held.append(batch.slice(at, stop - at).drop_columns(["run"]))
                at = stop
        if held:
            yield from pieces()

    def stream(piece: bytes):
        with pa.ipc.open_stream(piece) as reader:
            for batch in reader:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def merge(batches):
        def merged(current: int, own: list[bytes]):
            out, part, k = FileWriter(f"{path}/index-{current:06d}.cdx"), [], 0

            def rows():
                return pa.RecordBatch.from_arrays([pa.array([current] * len(part), pa.int32()), pa.array(range(k, k + len(part)), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), _TYPES, strict=True))], names=["range", "place", *_NAMES])

            for capture in LoserTree(map(stream, own)):
                out.write((" ".join(map(str, capture)) + "\n").encode("utf-8", "surrogatepass"))
                part.append(capture)
                if len(part) == 10_000:
                    yield rows()
                    part, k = [], k + len(part)
            out.close()
            if part:
                yield rows()

        current, own = None, []
        for batch in batches:
            for where, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if where != current:
                    if own:
                        yield from merged(current, own)
                    current, own = where, []
                own.append(piece)
        if own:
            yield from merged(current, own)

    pieces = runs.select("run", *_NAMES).mapInArrow(lean(deal), "range int, piece binary")
    return stored(pieces.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(lean(merge), f"range int, place long, {CAPTURE}"), "cdx")


def read_archive(archive: dict) -> DataFrame:
    """Read every capture of the index from its archive, forwards through each file.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to,
    urlkey, time, and the record's file and offset.
    """
    path, index = archive["path"], archive["index"]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "time", "file", "offset"]

    def run(batches):
        name, f = None, None
        for batch in batches:
            out = []
            for urlkey, time, _, file, offset, length, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    files, at = open_fs(f"{path}/{file}")
                    f, name = files.open_input_file(at), file
                f.seek(offset)
                r = parse(zlib.decompress(f.read(length), 31))
                out.append((r["id"], r["bytes"], r["digest"], r["type"], r["refers_to"], urlkey, time, file, offset))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=names)

    dealt = index.select(*_NAMES).repartition(tasks_of(index.sparkSession), "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(lean(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, time string, file string, offset long")


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex,
         min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p
), b AS (
  SELECT *, list_aggregate([right('000' || bin(strpos('0123456789abcdef', c) - 1), 4) FOR c IN string_split(hex, '')], 'string_agg', '') AS bits FROM h
)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[i] AS INT) + 8 * CAST(bits[i + 1] AS INT) + 4 * CAST(bits[i + 2] AS INT) + 2 * CAST(bits[i + 3] AS INT) + CAST(bits[i + 4] AS INT), 1) FOR i IN range(1, 161, 5)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
