"""WARC archives with a two-level capture index.

Each page becomes a WARC/1.1 record, a gzip member of its own.  Of records with
equal payloads of at least ``least`` bytes that with the largest page id is a
response and the others are revisits that refer to it; smaller payloads are all
responses.  The index lists captures sorted by reversed-host URL key in blocks of
``BLOCK`` lines, compressed one by one; beside each index file lies its sparse
directory, a line a block: its first key, offset, length and captures.  A lookup
bisects the first keys of the index files (a row a task), then the directory of the
file that it leads to, and then reads just the block's and the record's bytes: so no
process holds more than one row a file and a few files' directories.

Every file's name has its task attempt in it: a retried or speculative attempt writes
files of its own, and the rows of the attempt that counts name its files.

Defined results: a null html is an empty payload, a null or odd url the key it
gives (empty for null); repeated rows of the largest page id of a payload are all
responses; null page ids never are a response that others refer to unless all of
a payload's are null; no rows give no archive, an empty index and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

#: Captures of an index block.
BLOCK = 300
_DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
_CAPTURES = "urlkey string, page_id long, file string, offset long, length long, record_type string"


def url_key(url: str | None) -> str:
    """Reversed host, port, then path and query: ``com,example,www)/a?b=c``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url.lower())
    host = re.sub(r"^www\d*\.", "", host)
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return re.sub(r"\s", "%20", f"{at}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else ""))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, compressed."""
    kind = "revisit" if revisit else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP head, payload) of a compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    if fields["WARC-Block-Digest"] != "sha1:" + payload_digest(http + b"\r\n\r\n" + payload):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, http, payload


def _own(context) -> str:
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def _write_records(folder: str):
    schema = pa.schema([("urlkey", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, rows, at = f"{folder}/archive-{_own(TaskContext.get())}.warc.gz", [], 0

        def members():
            nonlocal at
            for page_id, url, html, refers_to, revisit in S.rows_of(found):
                member = record(page_id, url, (html or "").encode("utf-8", "replace"), refers_to, revisit)
                rows.append((url_key(url), page_id, file, at, len(member), "revisit" if revisit else "response"))
                at += len(member)
                yield member

        stream = members()
        first = next(stream, None)
        if first is not None:
            S.put_file(file, (x for part in ((first,), stream) for x in part))
        yield from S.batches(rows, schema)

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the archives; returns the captures: urlkey, page_id, file, offset,
    length, record_type.  Pages are dealt out once, by payload digest, with the
    digest's response id joined on (a skewed join that Spark can split)."""
    held = S.columns(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    held = held.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    keeper = held.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"))
    dealt = held.join(keeper.hint("merge"), "digest", "left")
    revisit = F.octet_length("html").__ge__(least) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = dealt.select("page_id", "url", "html", F.when(revisit, F.col("keeper")).alias("refers_to"), revisit.alias("revisit"))
    return S.saved(rows.mapInArrow(_write_records(folder), _CAPTURES), f"{folder}/_captures")


def _write_index(folder: str, block: int):
    schema = pa.schema([("part", pa.int32()), ("first", pa.string()), ("file", pa.string()), ("directory", pa.string()), ("blocks", pa.int64()), ("captures", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/index-{_own(TaskContext.get())}"
        sparse, at = [], 0

        def blocks():
            nonlocal at
            held: list[str] = []
            first = None

            def ended():
                nonlocal at
                body = gzip.compress("\n".join(held).encode(), 6, mtime=0)
                sparse.append((first, at, len(body), len(held)))
                at += len(body)
                return body

            for key, page_id, *rest in S.rows_of(found):
                first = key if not held else first
                held.append(f"{key} " + json.dumps([page_id, *rest]))
                if len(held) == block:
                    yield ended()
                    held = []
            if held:
                yield ended()

        stream = blocks()
        first_block = next(stream, None)
        if first_block is not None:
            S.put_file(f"{name}.cdx.gz", (x for p in ((first_block,), stream) for x in p))
            S.put_file(f"{name}.dir.gz", [gzip.compress("\n".join(f"{key} {json.dumps(rest)}" for key, *rest in sparse).encode(), 6, mtime=0)])
            yield from S.batches([(TaskContext.get().partitionId(), sparse[0][0], f"{name}.cdx.gz", f"{name}.dir.gz", len(sparse), sum(x[3] for x in sparse))], schema)

    return run


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Writes the sorted, compressed blocks and their directories; returns a row an index file."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.repartitionByRange(n, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id", "file", "offset")
    return S.saved(dealt.mapInArrow(_write_index(folder, block), "part int, first string, file string, directory string, blocks long, captures long"), f"{folder}/_files")


def read_range(file: str, offset: int, length: int) -> bytes:
    store, path = S.filesystem(file)
    with store.open_input_file(path) as source:
        return source.read_at(length, offset)


def read_block(file: str, offset: int, length: int) -> list[tuple]:
    """Captures of an index block: (urlkey, page_id, file, offset, length, type)."""
    lines = gzip.decompress(read_range(file, offset, length)).decode().split("\n")
    return [(key, *json.loads(rest)) for key, _, rest in (x.partition(" ") for x in lines)]


class Directory:
    """Finds the blocks that may hold a URL key, by bisection of files and then of blocks."""

    def __init__(self, files: list[tuple[str, str, str]]):
        self.files, self.firsts = files, [f[0] for f in files]
        self.sparse = lru_cache(maxsize=4)(self._sparse)

    @classmethod
    def load(cls, index: DataFrame) -> Directory:
        """From the rows of write_index(): as many as there were tasks."""
        return cls([(r.first, r.file, r.directory) for r in sorted(index.collect(), key=lambda r: r.part)])

    @staticmethod
    def _sparse(directory: str) -> tuple[list[str], list[tuple[int, int]]]:
        """(first keys, (offset, length)) of a file's blocks."""
        store, path = S.filesystem(directory)
        with store.open_input_stream(path, compression=None) as source:
            lines = gzip.decompress(source.read()).decode().split("\n")
        rows = [(key, json.loads(rest)) for key, _, rest in (x.partition(" ") for x in lines)]
        return [key for key, _ in rows], [(r[0], r[1]) for _, r in rows]

    @staticmethod
    def _within(firsts: list[str], key: str) -> range:
        """Places whose keys may reach ``key``: from the last that begins before it."""
        return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        for i in self._within(self.firsts, key):
            _, file, directory = self.files[i]
            firsts, at = self.sparse(directory)
            for j in self._within(firsts, key):
                yield file, *at[j]

    def lookup(self, url: str | None) -> list[tuple]:
        """Captures of a URL."""
        key = url_key(url)
        return [c for block in self.blocks(key) for c in read_block(*block) if c[0] == key]


def look_up(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(urlkey, file, offset, length): the blocks that may hold each key of ``urls`` (url)."""
    directory = Directory.load(index).files
    key_schema = pa.schema([("urlkey", pa.string())])
    schema = pa.schema([("urlkey", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def keys(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from S.batches(((url_key(url),) for (url,) in S.rows_of(found)), key_schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Directory(directory)
        yield from S.batches(((key, *block) for (key,) in S.rows_of(found) for block in held.blocks(key)), schema)

    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = S.columns(urls, url="string").mapInArrow(keys, "urlkey string").distinct()
    return asked.repartitionByRange(n, "urlkey").sortWithinPartitions("urlkey").mapInArrow(run, "urlkey string, file string, offset long, length long")


def read_archives(blocks: DataFrame) -> DataFrame:
    """Reads the captures that were looked up: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null for a revisit).

    A block goes to one task with the keys that led to it: the block's bytes are read
    once, then those of the records, file by file in order."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(uri: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(found[1]) if found else None

    def records(block: tuple, keys: set[str]) -> Iterator[tuple]:
        captures = sorted((c for c in read_block(*block) if c[0] in keys), key=lambda c: (c[2], c[3]))
        at = source = None
        for _, _, file, offset, length, _ in captures:
            if file != at:
                store, path = S.filesystem(file)
                at, source = file, store.open_input_file(path)
            fields, http, payload = parse(source.read_at(length, offset))
            kind = fields["WARC-Type"]
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            if kind == "response" and (size != len(payload) or fields["WARC-Payload-Digest"] != "sha1:" + payload_digest(payload)):
                raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
            yield number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, keys = None, set()
            for key, *block in S.rows_of(found):
                if block != at:
                    if at:
                        yield from records(at, keys)
                    at, keys = block, set()
                keys.add(key)
            if at:
                yield from records(at, keys)

        yield from S.batches(rows(), schema)

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("urlkey", "file", "offset", "length").repartition(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every page, looked up by its URL in the index and read back."""
    folder, pages = S.scratch(spark, "warc"), S.table(spark, sf_dir, "pages")
    index = write_index(write_archives(pages, folder), folder)
    return read_archives(look_up(pages, index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = m.keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = m.keeper THEN NULL ELSE m.keeper END AS refers_to
FROM p JOIN m USING (html)
"""
