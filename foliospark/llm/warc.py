"""WARC archives with a two-level capture index.

Archives are written by Spark's own writer, so its commit protocol covers lost
executors and any file system works: every record is a gzip member of its own, and the
blank lines that end a record are the line separator, a gzip member too.  The files
decompress to plain WARC and any record can be read alone from its offset.

The index sorts captures by reversed-host URL key into compressed blocks (gzip members
again) and keeps one directory row per block.  A lookup searches the directory by
bisection, reads one block by range, and then the record by range.  Many lookups do this in
tasks, in the order of the keys and then of the records; no file is ever read whole into memory,
nor is any part of one shuffled.

Tasks open index and archives themselves, through Arrow's file systems, so these lie in a store
that Arrow knows (shared folders, HDFS, S3, GCS, ABFS).
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, shuffle_width

#: Payloads shorter than this are always stored, never revisited.
MIN_REVISIT_BYTES = 100
#: Records per archive file at most, and payload bytes if all pages were of average size.
RECORDS_PER_FILE, BYTES_PER_FILE = 10_000, 128_000_000
#: Captures of an index file, and most files of an index, whose first keys every task holds; more captures make longer files.
FILE_CAPTURES, INDEX_FILES = 8192, 4096
#: Bytes read at once from a file that is scanned.
READ_BYTES = 1 << 20
#: Captures per compressed index block.
BLOCK_ROWS = 512
#: Revisits up to this many rows (of three short columns) are broadcast; beyond it the join shuffles.
BROADCAST_REVISITS = 100_000

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


RECORD_END = gzip_member(b"\r\n\r\n")
BLOCK_END = gzip_member(b"")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, content)`` of each gzip member of a file; holds one member and a buffer."""
    at, left = 0, b""
    while True:
        d, out, size = zlib.decompressobj(31), [], 0
        while not d.eof:
            chunk = left or stream.read(READ_BYTES)
            if not chunk:
                if size:
                    raise ValueError("truncated gzip member")
                return
            out.append(d.decompress(chunk))
            size += len(chunk) - len(d.unused_data)
            left = d.unused_data
        yield at, size, b"".join(out)
        at += size


def open_file(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, for reading in a task by range or in order."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    try:
        store, name = fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise RuntimeError(f"tasks cannot open {path}: set spark.checkpoint.dir to a store that Arrow can open") from e
    return store.open_input_file(name)


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.example.com:80/x?y`` is ``com,example,a)/x?y``.

    Host in lower case, without ``www.``, user, default port or fragment; spaces and control
    characters as percent signs, as records have them; an unparsable URL keeps its text.
    """
    if not url:
        return ""
    url = _clean(url.strip())
    try:
        p = urlsplit(url)
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return url
    if not host:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split(".")))
    if port and (p.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){p.path or '/'}" + (f"?{p.query}" if p.query else "")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str = _DATE) -> bytes:
    """One WARC record without its closing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def parse(data: bytes) -> dict:
    """Fields of one record; the block must be as long as declared, and a stored payload
    must match its digest."""
    top, _, block = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if len(block) != int(head["content-length"]):
        raise ValueError("record length differs from its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"content-length:\s*(\d+)", http, re.I)[1])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    return {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "date": head["warc-date"], "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(head.get("warc-refers-to"))}


def digests(pages: DataFrame) -> DataFrame:
    """``page_id, url, digest, n`` of every page's payload."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))


def revisits(seen: DataFrame) -> DataFrame:
    """``page_id, refers_to, refers_url`` of the pages whose payload an earlier page holds.

    The smallest page_id of a payload of at least ``MIN_REVISIT_BYTES`` is its response.
    Minima are taken map-side, so a hot payload costs a row a task; its rows then meet
    that one row in a join, which is split where it is skewed.
    """
    seen = seen.where(f"n >= {MIN_REVISIT_BYTES} AND page_id IS NOT NULL").drop("n")
    first = seen.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    found = seen.join(first, "digest").where(F.col("page_id") > F.col("f.page_id"))
    return found.select("page_id", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("refers_url")).groupBy("page_id").agg(F.min(F.struct("refers_to", "refers_url")).alias("r")).select("page_id", "r.*")


def write(pages: DataFrame, scratch: Scratch, name: str = "archives", date: str = _DATE) -> str:
    """Write one record per page and return the folder of archives.

    A null html is an empty payload, always stored.  Of pages with equal payloads, that
    with the smallest id is stored; rows that repeat its id are stored again.  An empty table gives an empty
    folder; pages are stored whole; other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    seen = scratch.save(digests(pages), "digests")
    size = seen.agg(F.avg("n").alias("a")).first()["a"] or 0
    again = scratch.save(revisits(seen), "revisits")
    side = again.select(F.col("page_id").alias("__p"), "refers_to", "refers_url")
    if again.count() <= BROADCAST_REVISITS:
        side = F.broadcast(side)
    # a page repeated with another payload may carry a revisited id: the payload decides again below
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body")).join(side, F.col("page_id") == F.col("__p"), "left").select("page_id", "url", "body", "refers_to", "refers_url")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, body, to, to_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(body) < MIN_REVISIT_BYTES:
                    to = None
                out.append(gzip_member(record(page_id, url, body, hashlib.sha256(body).hexdigest(), to, to_url, date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    path = scratch.path(name)
    stored = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    stored.write.mode("overwrite").option("lineSep", RECORD_END.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, int(BYTES_PER_FILE / (size + 600))))).text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The paths of a folder's data files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)


_CAPTURE = ["key", "date", "page_id", "url", "archive", "offset", "length"]
_CAPTURE_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``key, date, page_id, url, archive, offset, length`` of every record in the archives."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = []
                with open_file(archive) as f:
                    for at, size, data in members(f):
                        if data == b"\r\n\r\n":
                            continue
                        top = data.partition(b"\r\n\r\n")[0].decode()
                        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in top.split("\r\n")[1:])}
                        m = re.fullmatch(r"<urn:page:(-?\d+)>", head["warc-record-id"])
                        url = head.get("warc-target-uri")
                        rows.append((url_key(url), head["warc-date"], int(m[1]) if m else None, url, archive, at, size))
                        if len(rows) >= 5000:
                            yield _columns(rows, _CAPTURE, _CAPTURE_KINDS)
                            rows = []
                yield _columns(rows, _CAPTURE, _CAPTURE_KINDS)

    return _files(spark, path).mapInArrow(run, "key string, date string, page_id long, url string, archive string, offset long, length long")


def build_index(spark: SparkSession, archives: str, scratch: Scratch, name: str = "index", block_rows: int = BLOCK_ROWS, file_captures: int = FILE_CAPTURES) -> str:
    """Write sorted compressed blocks and their sparse directory; return the folder.

    Captures are range-partitioned on (key, date, page_id), so a hot host, or even one URL
    captured very often, spreads over files.  ``<folder>/blocks`` holds gzip members of
    JSON lines, ``<folder>/directory`` one row a block: its first capture, last key, file, offset, length.
    """
    entries = scratch.save(scan(spark, archives), f"{name}-entries")
    order = ["key", "date", "page_id", "archive", "offset"]
    total = entries.count()
    files = max(1, min(-(-total // file_captures), INDEX_FILES))
    ordered = entries.repartitionByRange(files, *order).sortWithinPartitions(*order)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(json.dumps(row, ensure_ascii=False))
                if len(lines) == block_rows:
                    out.append(gzip_member("\n".join(lines).encode()))
                    lines = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([gzip_member("\n".join(lines).encode())], pa.binary())], ["block"])

    path = scratch.path(name)
    ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.mode("overwrite").option("lineSep", BLOCK_END.decode("latin-1")).option("encoding", "ISO-8859-1").text(f"{path}/blocks")

    names = ["file", "first_key", "first_date", "first_page", "last_key", "offset", "length", "captures"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    @lean
    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                with open_file(file) as f:
                    for at, size, data in members(f):
                        if data:
                            lines = data.split(b"\n")
                            rows.append((file, *json.loads(lines[0])[:3], json.loads(lines[-1])[0], at, size, len(lines)))
                yield _columns(rows, names, kinds)

    _files(spark, f"{path}/blocks").mapInArrow(directory, "file string, first_key string, first_date string, first_page long, last_key string, offset long, length long, captures long").write.mode("overwrite").parquet(f"{path}/directory")
    scratch.drop(f"{name}-entries")
    return path


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """Bytes of a file in any store that Spark can open."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


class CaptureIndex:
    """Point lookups by URL.

    The driver holds one key pair per block file; the directory rows of a file are read
    when a key falls into it.  Both are searched by bisection.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.directory = spark.read.parquet(f"{path}/directory")
        rows = self.directory.groupBy("file").agg(F.min("first_key").alias("a"), F.max("last_key").alias("z")).collect()
        self.files = sorted((r["a"], r["z"], r["file"]) for r in rows)

    def captures(self, url: str) -> list[dict]:
        """All captures of a URL (by its key), oldest first."""
        key, found = url_key(url), []
        lo = bisect_left(sorted(z for _, z, _ in self.files), key)
        hi = bisect_right([a for a, _, _ in self.files], key)
        for _, _, file in self.files[lo:hi]:
            rows = sorted((r["offset"], r["first_key"], r["last_key"], r["length"]) for r in self.directory.where(F.col("file") == file).collect())
            first = bisect_left([r[2] for r in rows], key)
            last = bisect_right([r[1] for r in rows], key)
            for at, _, _, size in rows[first:last]:
                lines = zlib.decompress(read_range(self.spark, file, at, size), 31).decode().split("\n")
                found += [dict(zip(("key", "date", "page_id", "url", "archive", "offset", "length"), x, strict=True)) for x in map(json.loads, lines) if x[0] == key]
        return found

    def fetch(self, capture: dict) -> dict:
        """The record of a capture, by one range read; a revisit has no payload of its own."""
        return parse(zlib.decompress(read_range(self.spark, capture["archive"], capture["offset"], capture["length"]), 31))


def _place(key: str, date: str | None, page_id: int | None) -> tuple:
    """Where a capture stands in the index: nulls come first."""
    return key, date or "", page_id is not None, page_id or 0


def find(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """``archive, offset, length`` of all captures of ``wanted(url, page_id, date)``, each wanted one once.

    The first keys of the index files (at most ``INDEX_FILES``) tell the file of each wanted capture
    by bisection.  Wanted captures meet the directory rows of their file in a shuffle; a
    task then bisects the directory for each and reads the block found by range, the next capture
    mostly being in the same block."""
    directory = spark.read.parquet(f"{index}/directory")
    first = F.min(F.struct("first_key", "first_date", "first_page"))
    files = sorted((_place(*r["a"]), r["file"]) for r in directory.groupBy("file").agg(first.alias("a")).collect())
    sent = spark.sparkContext.broadcast(files)
    names = ["file", "kind", "key", "date", "page_id", "offset", "length"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = "file string, kind int, key string, date string, page_id long, `offset` long, length long"

    @lean
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [p for p, _ in sent.value]
        for b in batches:
            rows = []
            for url, page_id, date in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = url_key(_clean(url) if url is not None else None)
                # equal captures can begin before the file that starts with them
                last = bisect_right(places, _place(key, date, page_id)) - 1
                k = max(bisect_left(places, _place(key, date, page_id)) - 1, 0)
                rows += [(sent.value[i][1], 1, key, date, page_id, None, None) for i in range(k, max(last, k) + 1)] if places else []
            yield _columns(rows, names, kinds)

    asked = wanted.select("url", F.col("page_id").cast("long").alias("page_id"), "date").distinct().mapInArrow(assign, schema)
    blocks = directory.select("file", F.lit(0).alias("kind"), F.col("first_key").alias("key"), F.col("first_date").alias("date"), F.col("first_page").alias("page_id"), "offset", "length")
    order = ["file", "kind", "key", "date", "page_id", "offset"]
    met = blocks.union(asked).repartition(shuffle_width(spark), "file").sortWithinPartitions(*order)

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream, places, ranges = None, None, [], []
        number, block = -1, []
        asked = None
        for b in batches:
            out = []
            for name, kind, key, date, page_id, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != file:
                    if stream is not None:
                        stream.close()
                    file, stream, places, ranges, number, asked = name, open_file(name), [], [], -1, None
                here = _place(key, date, page_id)
                if kind == 0:
                    places.append(here)
                    ranges.append((at, size))
                    continue
                if here == asked:  # urls that differ in what the key leaves out
                    continue
                asked = here
                k = max(bisect_left(places, here) - 1, 0)
                while k < len(places) and places[k] <= here:
                    if k != number:
                        stream.seek(ranges[k][0])
                        block = [json.loads(x) for x in zlib.decompress(stream.read(ranges[k][1]), 31).decode().split("\n")]
                        block, number = [(_place(*x[:3]), x) for x in block], k
                    i = bisect_left(block, here, key=lambda x: x[0])
                    while i < len(block) and block[i][0] == here:
                        out.append(tuple(block[i][1][4:7]))
                        i += 1
                    k += 1
            if out:
                yield _columns(out, ["archive", "offset", "length"], [pa.string(), pa.int64(), pa.int64()])
        if stream is not None:
            stream.close()

    return met.mapInArrow(search, "archive string, offset long, length long")


def read_records(found: DataFrame) -> DataFrame:
    """The records at ``archive, offset, length``, read by range in the order they lie in, and checked.

    Columns: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, stream = None, None
        for b in batches:
            rows = []
            for name, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != archive:
                    if stream is not None:
                        stream.close()
                    archive, stream = name, open_file(name)
                stream.seek(at)
                r = parse(zlib.decompress(stream.read(size), 31))
                rows.append((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
            yield _columns(rows, ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()])
        if stream is not None:
            stream.close()

    dealt = found.repartition(shuffle_width(found.sparkSession), "archive").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_back(spark: SparkSession, pages: DataFrame, index: str, date: str = _DATE) -> DataFrame:
    """The record of every page, looked up in the index by its URL key and page id, and read by range.

    Pages without a URL are under the empty key; a page that is repeated is looked up once, which finds
    all its records.  An empty table gives no rows."""
    return read_records(find(spark, index, pages.select("url", "page_id", F.lit(date).alias("date"))))
