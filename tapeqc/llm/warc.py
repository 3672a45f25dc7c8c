"""WARC archives with a two-level capture index.

Archives hold a gzip member for each record. Records with equal payloads of at least `min_bytes` bytes are kept once: the one with the largest
page_id is a response, the others revisit it. The index has a line for each record, sorted by its URL's key, in which the host's labels stand
in reverse order; lines are packed into compressed blocks, each index file ends with a sparse directory of its blocks' first lines, and the files'
own first lines tell files apart. A lookup searches files, directory and block by bisection, then reads the record's range alone.

Tasks write under names of their own; only files that the committed tables of records and index files name count, so that tasks that run twice or
are lost do no harm. Defined results: a null html is an empty payload; a null url has the key `-`; null page_ids come after all others in
choosing the response, and rows that share the largest page_id of a payload are all responses; an empty table gives empty tables.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, spread_join, written

#: Lines in a block of the index.
BLOCK_LINES = 2000
_ENTRY = pa.schema({"key": pa.string(), "page_id": pa.int64(), "line": pa.string()})
_RECORD = pa.schema({"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()})


def url_key(url: str = "url") -> Column:
    """The sort key of a URL: the host's labels in reverse order, `)`, then path and query; `-` for null. White space is escaped."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]+)?(?s)(.*)$"
    host, rest = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    key = F.when(F.col(url).rlike(parts), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(F.col(url))
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20"), F.lit("-"))


def _line_key(key: Column, page_id: Column) -> Column:
    """One string that sorts by key, then by page_id, null first."""
    return F.concat(key, F.lit(" "), F.coalesce(F.lpad((page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), F.lit("-")))


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) to archives; returns the committed index lines: key, page_id, line.

    Payloads are compared by SHA-1. Groups are found by an aggregation over digests alone and joined back; each page's html is
    moved once, and payloads that very many pages share are joined where the pages are.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.select("*", F.sha1("payload").alias("sha"), url_key().alias("key")).withColumn("line_key", _line_key(F.col("key"), F.col("page_id")))
    groups = own.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("response"), F.max_by("url", "page_id").alias("response_url")).where("n > 1")
    roles = spread_join(own, written(groups, "warc-groups"), "sha", "n").select("page_id", "url", "payload", "line_key", F.when(F.length("payload") >= min_bytes, F.col("response")).alias("response"), "response_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path, out, at = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                entries = []
                for row in (r for k in range(0, b.num_rows, 100) for r in b.slice(k, 100).to_pylist()):
                    if out is None:
                        out = fs.open_output_stream(path, compression=None)
                    payload, url, response = row["payload"], _clean(row["url"]), row["response"]
                    revisit = response is not None and row["page_id"] != response
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(row["page_id"], url)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", row["page_id"])]
                    if revisit:
                        first = _clean(row["response_url"])
                        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(response, first)), ("WARC-Refers-To-Target-URI", first), ("X-Refers-To-Page-Id", response)]
                    member = _member(headers, http if revisit else http + payload)
                    out.write(member)
                    entries.append((row["line_key"], row["page_id"], f"{row['line_key']} {json.dumps({'url': url, 'digest': digest, 'offset': at, 'length': len(member), 'filename': path.rpartition('/')[2]})}"))
                    at += len(member)
                if entries:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*entries, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)
        finally:
            if out is not None:
                out.close()

    lines = written(roles.mapInArrow(write, "key string, page_id long, line string"), "warc-lines")
    return lines.withColumn("folder", F.lit(folder))


def write_index(lines: DataFrame) -> DataFrame:
    """Writes the capture index of `write_archives`' lines; returns a row for each index file: part (files stand in its order), first_key, path, folder (the archives')."""
    folder = shared_dir(lines.sparkSession, "cdx")
    dealt = lines.repartitionByRange("key", "line").sortWithinPartitions("key", "line").withColumn("part", F.spark_partition_id())
    schema = pa.schema({"part": pa.int32(), "first_key": pa.string(), "path": pa.string(), "folder": pa.string()})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path, out, at, block, directory, archives, part = f"{root}/{uuid.uuid4().hex}.cdx", None, 0, [], [], None, 0

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(line for _, line in block).encode())
            directory.append((block[0][0], at, len(data)))
            out.write(data)
            at += len(data)
            block.clear()

        for b in batches:
            part = b["part"][0].as_py() if b.num_rows else part
            for key, line, where in zip(b["key"].to_pylist(), b["line"].to_pylist(), b["folder"].to_pylist(), strict=True):
                if out is None:
                    out, archives = fs.open_output_stream(path, compression=None), where
                block.append((key, line))
                if len(block) == BLOCK_LINES:
                    flush()
        if out is not None:
            if block:
                flush()
            foot = zlib.compress(json.dumps(directory).encode())
            out.write(foot + len(foot).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "first_key": [directory[0][0]], "path": [path], "folder": [archives]}, schema)

    return written(dealt.mapInArrow(write, "part int, first_key string, path string, folder string"), "cdx-files")


class CaptureIndex:
    """Reads one index file and the archives that it names, by ranges."""

    def __init__(self, path: str, folder: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.firsts = [d[0] for d in self.directory]
        self.block = lru_cache(4)(self._block)
        self.archive = lru_cache(16)(self._archive)

    def _block(self, k: int) -> list[str]:
        _, at, n = self.directory[k]
        return zlib.decompress(self.file.read_at(n, at)).decode().split("\n")

    def _archive(self, name: str) -> pa.NativeFile:
        return self.fs.open_input_file(f"{self.root}/{name}")

    def captures(self, low: str, high: str) -> Iterator[dict]:
        """The index entries whose lines are at least `low`, a key and a blank, and below `high`.

        The directory holds bare keys: the search starts before the first block that begins with the key, whose copies may fill many.
        """
        for k in range(max(0, bisect_left(self.firsts, low.removesuffix(" ")) - 1), len(self.firsts)):
            if self.firsts[k] >= high:
                break
            lines = self.block(k)
            for line in lines[bisect_left(lines, low) :]:
                if line >= high:
                    return
                yield json.loads(line.split(" ", 2)[2])

    def record(self, entry: dict) -> dict:
        """The record that an entry names, from its range of its archive."""
        data = zlib.decompress(self.archive(entry["filename"]).read_at(entry["length"], entry["offset"]), 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its headers say")
        number = lambda k: int(fields[k]) if k in fields else None
        return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if fields["WARC-Type"] == "response" else None}


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of `wanted` (url, and page_id or no such column: all of the url's captures): page_id, url, record_type, payload_digest,
    payload_bytes, refers_to, payload (null for revisits).

    The index files' first keys, one for each file, go to every task; each search goes to its file's task.
    """
    # In the order of the parts: a key whose lines fill several files begins more than one of them, and only the last goes on beyond it.
    table = [(r.first_key, r.path, r.folder) for r in sorted(files.collect(), key=lambda r: r.part)]
    firsts = [t[0] for t in table]
    exact = "page_id" in wanted.columns
    key = url_key()
    low = _line_key(key, F.col("page_id").cast("long")) if exact else key
    own = wanted.select(low.alias("low")).distinct().withColumn("high", F.concat("low", F.lit("!")))
    low_list, spark = firsts, wanted.sparkSession
    if not table:
        return spark.createDataFrame([], _TYPES)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lo, hi in zip(b["low"].to_pylist(), b["high"].to_pylist(), strict=True):
                a, z = max(0, bisect_left(low_list, lo) - 1), bisect_right(low_list, hi)
                rows += [(f, lo, hi) for f in range(a, max(z, a + 1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["file", "low", "high"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for b in batches:
            rows = []
            for f, lo, hi in zip(*(b[c].to_pylist() for c in ("file", "low", "high")), strict=True):
                if f != now:
                    now, index = f, CaptureIndex(*table[f][1:])
                rows += [index.record(e) for e in index.captures(lo + " ", hi)]
                if len(rows) >= 200:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _RECORD)

    found = own.mapInArrow(places, "file int, low string, high string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # keys are small, the records that they name are not
    return found.repartitionByRange(tasks, "file", "low").sortWithinPartitions("file", "low").mapInArrow(read, _TYPES)


_TYPES = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
