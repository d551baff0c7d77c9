"""WARC archives: written with an index first, read by coalesced byte ranges.

``plan_records`` decides which records are responses and which revisit an earlier equal payload. ``write_archives``
streams each partition into one archive of gzip members, one for each record, and returns the index: file, offset,
length, URL and digest of every record. ``read_records`` takes any selection of index rows, sorts them by file and
offset, joins neighbours into one ranged read, and parses only the selected records.

Archives are reached through pyarrow's file systems by URI, so any shared store will do. A retried task writes a file of
its own; only the files that the committed index names are ever read.

Defined results: a null html is an empty payload, always a response; rows that repeat the smallest page_id of their
payload are responses too; a null page_id is never referred to while another id has the payload; a null url is written
as an empty one; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import map_batches, written

MIN_SHARED_BYTES = 100
#: A payload's copies are dealt over so many keys, as one payload may hold a third of all rows.
SALTS = 64
#: Classes of digests; those with a payload that occurs twice are sent to all tasks, a table of at most so many numbers.
CLASSES = 1 << 18
#: Bytes of archives that a task reads.
RANGE_BYTES = 64 << 20
#: Ranges closer than this are read in one go, up to the size of a block.
GAP_BYTES, BLOCK_BYTES = 64 << 10, 8 << 20
#: An archive is closed, and its index rows are sent on, when it passes this size.
ARCHIVE_BYTES = 128 << 20
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string, refers_to long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def plan_records(pages: DataFrame, min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """(page_id, url, html, payload_digest, record_type, refers_to) of each page.

    The smallest page_id of each payload is found by a grouping that is summed before the shuffle. Digests fall into
    ``CLASSES`` classes; pages in a class without a payload that occurs twice are responses where they are read, and only
    the others' html is shuffled, joined over salted keys.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    large = F.octet_length("html") >= min_bytes
    shared = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("payload_digest", "first_id"), "warc-shared")
    of = F.pmod(F.xxhash64("payload_digest"), F.lit(CLASSES))
    classes = F.broadcast(written(shared.select(of.alias("class")).distinct(), "warc-classes", CLASSES))
    placed = rows.withColumn("class", of)
    alone = placed.join(classes, "class", "left_anti").withColumn("first_id", F.lit(None).cast("long"))
    salts = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = placed.join(classes, "class", "left_semi").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salts, ["payload_digest", "salt"], "left")
    names = ["page_id", "url", "html", "payload_digest", "first_id"]
    revisit = large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        alone.select(*names)
        .union(met.select(*names))
        .select(
            "page_id",
            "url",
            "html",
            "payload_digest",
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            F.when(revisit, F.col("first_id")).alias("refers_to"),
        )
    )


def _record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. Its block is an HTTP message; a revisit has the headers only, with the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _writer(folder: str, level: int, archive_bytes: int):
    names = ["page_id", "file", "offset", "length", "url", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        rows = (r for b in batches for r in b.to_pylist())
        r = next(rows, None)
        while r is not None:
            file, index, at = f"pages-{uuid.uuid4().hex}.warc.gz", [], 0
            with store.open_output_stream(f"{root}/{file}", compression=None) as out:
                while r is not None and at < archive_bytes:
                    raw = _record(r["page_id"], _one_line(r["url"]), r["html"].encode(), r["payload_digest"], r["record_type"], r["refers_to"])
                    member = gzip.compress(raw, level, mtime=0)
                    out.write(member)
                    index.append((r["page_id"], file, at, len(member), r["url"], r["payload_digest"], r["record_type"], r["refers_to"]))
                    at += len(member)
                    r = next(rows, None)
            yield _batch(index, names, kinds)  # only when the archive is closed, so the index never names a missing byte

    return run


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def write_archives(planned: DataFrame, folder: str, level: int = 4, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what plan_records returns under folder and return the index, stored beside the archives."""
    map_batches(planned, _writer(f"{folder}/archives", level, archive_bytes), INDEX).write.parquet(f"{folder}/index")
    return read_index(planned.sparkSession, folder)


def read_index(spark, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers of a record, the full length of its payload, and the payload as far as the record has it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, length, payload


def _reader(folder: str, with_payload: bool):
    def blocks(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Runs of neighbouring ranges of a file."""
        file, run = None, []
        for f, offset, length in rows:
            if run and (f != file or offset - sum(run[-1]) > GAP_BYTES or offset + length - run[0][0] > BLOCK_BYTES):
                yield file, run
                run = []
            file = f
            run.append((offset, length))
        if run:
            yield file, run

    def number(x: str) -> int | None:
        return int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
        file, source = None, None
        for f, ranges in blocks(rows):
            if f != file:
                file, source = f, store.open_input_file(f"{root}/{f}")
            first = ranges[0][0]
            source.seek(first)
            data = source.read(sum(ranges[-1]) - first)
            out = []
            for offset, length in ranges:
                headers, size, payload = parse_record(zlib.decompress(data[offset - first : offset - first + length], 31))
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{f} at {offset}: the payload does not have the digest {digest}")
                refers = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                kept = payload if with_payload and kind == "response" else None
                out.append((number(headers["WARC-Record-ID"]), size, digest, kind, refers, headers["WARC-Target-URI"], kept))
            yield _batch(out, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()])

    return run


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, read from the archives in sorted, joined byte ranges.

    Rows are dealt by range of (file, offset), as many ranges as their bytes ask for, so a large archive is shared by
    tasks. A revisit's payload is null; its length and digest are those of the full payload.
    """
    size = selected.agg(F.sum("length")).first()[0] or 0
    n = max(selected.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    ranges = selected.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return map_batches(ranges, _reader(f"{folder}/archives", with_payload), RECORDS)


def without_payload(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def has_url(prefix: str) -> Column:
    """A selection of index rows."""
    return F.startswith("url", F.lit(prefix))
