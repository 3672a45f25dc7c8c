"""Frame reports in XML, gzipped or not, read by several tasks each, and written from frames.

A Python data source cuts a report into ranges of its decompressed bytes. A task seeks its range in a plain report; a gzipped one it decompresses from
the start, which is some twenty times as fast as parsing, and parses from the first frame that begins in its range up to the first that begins after
it. Elements are streamed: a task holds a chunk of text and a batch of frames, however long the report.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator
from xml.etree.ElementTree import XMLPullParser
from xml.sax.saxutils import quoteattr

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..tables import shared_dir, written

#: Decompressed bytes of a range, and ranges that a gzipped report has at most, as each decompresses all before it.
PART_BYTES, GZIP_PARTS = 32 << 20, 16
#: A gzipped report's text is taken for so many times its size where the file doesn't say.
_RATIO = 12
_CHUNK, _FRAMES = 1 << 20, 2000
_OPENS = re.compile(rb"<frame[\s>/]")
_TAGS = pa.list_(pa.struct([("_key", pa.string()), ("_value", pa.string())]))
FRAME_SCHEMA = pa.schema({"asset_id": pa.string(), "_media_type": pa.string(), "_pkt_pts_time": pa.float64(), "_pkt_dts_time": pa.float64(), "_n": pa.int64(), "tag": _TAGS})


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def report_files(paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of each report: files as they are named, of folders all reports in them."""
    out = []
    for path in paths:
        fs, at = _open(path)
        info = fs.get_file_info(at)
        scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
        if info.type == pyarrow.fs.FileType.Directory:
            found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
            out += sorted((scheme + f.path, f.size) for f in found if f.is_file and f.path.endswith((".xml", ".xml.gz")))
        elif info.type == pyarrow.fs.FileType.File:
            out.append((path, info.size))
        else:
            raise FileNotFoundError(path)
    return out


def _text_size(path: str, size: int) -> int:
    """About how many bytes a report's text has: what a gzipped one says at its end, if that can be."""
    if not path.endswith(".gz") or size < 18:
        return size
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        f.seek(size - 4)
        said = int.from_bytes(f.read(4), "little")
    return said if said >= size else _RATIO * size


class ReportRange(InputPartition):
    """The frames of a report that begin in a range of its text; end None: to its end."""

    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def report_ranges(path: str, size: int, part_bytes: int) -> list[ReportRange]:
    """The ranges that a report of `size` bytes is cut into."""
    whole = _text_size(path, size)
    parts = max(1, -(-whole // part_bytes))
    if path.endswith(".gz"):
        parts = min(parts, GZIP_PARTS)
    step = -(-whole // parts)
    return [ReportRange(path, k * step, (k + 1) * step if k + 1 < parts else None) for k in range(parts)]


def frame_blocks(path: str, start: int, end: int | None) -> Iterator[bytes]:
    """Whole frames' text, some at a time: of those whose first byte lies in the range."""
    fs, at = _open(path)
    with fs.open_input_file(at) as raw:
        text = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        text.seek(start)
        held, place, inside = b"", start, False
        while chunk := text.read(_CHUNK):
            held += chunk
            if not inside:
                first = _OPENS.search(held)
                if first is None or end is not None and place + first.start() >= end:
                    if first is not None or end is not None and place + len(held) - 8 >= end:
                        return
                    place, held = place + max(0, len(held) - 8), held[-8:]
                    continue
                place, held, inside = place + first.start(), held[first.start() :], True
            cut = 0
            for m in _OPENS.finditer(held, 1):
                if end is not None and place + m.start() >= end:
                    yield held[: m.start()]
                    return
                cut = m.start()
            if cut:
                yield held[:cut]
                place, held = place + cut, held[cut:]
        if inside:
            stop = held.find(b"</frames")
            yield held if stop < 0 else held[:stop]


def parsed_frames(blocks: Iterator[bytes], asset_id: str) -> Iterator[pa.RecordBatch]:
    """Frames as batches of FRAME_SCHEMA. Bytes that are not UTF-8 are replaced."""
    parser = XMLPullParser(events=("start", "end"))
    parser.feed("<frames>")
    rows: list[tuple] = []
    root = None
    number = lambda x: float(x) if x else None

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FRAME_SCHEMA.types, strict=True)], schema=FRAME_SCHEMA)
        rows.clear()
        return out

    for block in blocks:
        parser.feed(block.decode("utf-8", "replace"))
        for event, x in parser.read_events():
            if event == "start":
                root = x if root is None else root
            elif x.tag == "frame":
                n = x.get("n")
                tags = [{"_key": t.get("key"), "_value": t.get("value")} for t in x.iter("tag")]
                rows.append((asset_id, x.get("media_type"), number(x.get("pkt_pts_time")), number(x.get("pkt_dts_time")), int(n) if n and n.lstrip("-").isdigit() else None, tags))
                root.clear()
                if len(rows) >= _FRAMES:
                    yield batch()
    if rows:
        yield batch()


def asset_of(path: str) -> str:
    """The file's name up to its first dot."""
    return path.rsplit("/", 1)[-1].partition(".")[0]


class FrameReports(DataSource):
    """Format frame_report. Options: paths (a JSON list of files and folders; or load's path), part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "frame_report"

    SCHEMA = "asset_id string, _media_type string, _pkt_pts_time double, _pkt_dts_time double, _n long, tag array<struct<_key: string, _value: string>>"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("paths", "[]")) or [self.options["path"]], int(self.options.get("part_bytes", PART_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], part_bytes: int):
        self.paths, self.part_bytes = paths, part_bytes

    def partitions(self) -> list[ReportRange]:
        return [r for path, size in report_files(self.paths) for r in report_ranges(path, size, self.part_bytes)] or [ReportRange("", 0, 0)]

    def read(self, part: ReportRange) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from parsed_frames(frame_blocks(part.path, part.start, part.end), asset_of(part.path))


def _listed_frames(files: DataFrame, part_bytes: int) -> DataFrame:
    """The frames of the reports that a table lists (path). Tasks cut reports into ranges, and each reads as many as make up PART_BYTES, however small."""
    spark = files.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for path, size in report_files(b["path"].to_pylist()) for r in report_ranges(path, size, part_bytes)]
            size = [min(part_bytes, r.end - r.start if r.end else _text_size(*report_files([r.path])[0]) - r.start) for r in found]
            columns = {"path": [r.path for r in found], "begin": [r.start for r in found], "end": [r.end for r in found], "size": size}
            yield pa.RecordBatch.from_pydict(columns, pa.schema({"path": pa.string(), "begin": pa.int64(), "end": pa.int64(), "size": pa.int64()}))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from parsed_frames(frame_blocks(r["path"], r["begin"], r["end"]), asset_of(r["path"]))

    tasks = spark.sparkContext.defaultParallelism
    ranges = written(files.select("path").repartition(tasks).mapInArrow(cut, "path string, begin long, end long, size long"), "report-ranges")
    tasks = max(tasks, -(-(ranges.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    return ranges.repartition(tasks).mapInArrow(read, FrameReports.SCHEMA)


def report_frames(spark: SparkSession, paths: str | list[str] | DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """asset_id, _media_type, _pkt_pts_time, _pkt_dts_time, _n, tag: a row for each frame of the reports, a large one by several tasks.

    Very many reports are listed by a table (path), which is read where it is; a list's paths and ranges pass through the driver.
    """
    if isinstance(paths, DataFrame):
        return _listed_frames(paths, part_bytes)
    spark.dataSource.register(FrameReports)
    return spark.read.format("frame_report").option("paths", json.dumps([paths] if isinstance(paths, str) else paths)).option("part_bytes", part_bytes).load()


def write_frame_reports(frames: DataFrame, keys: dict[str, str], gz: Column, media_type: str = "video") -> DataFrame:
    """Writes a report for each asset of frames (asset_id, frame_idx, pts, dts and the columns that `keys` gives tag keys) and returns asset_id, path, frames.

    gz: whether an asset's report is gzipped. A null pts, dts or metric is left out. Assets are sorted and streamed; files have a name of their own for
    each attempt in a new folder that driver and executors share, and only those that the table names count.
    """
    folder = shared_dir(frames.sparkSession, "reports")
    own = frames.select(F.col("asset_id").cast("string").alias("asset_id"), "frame_idx", "pts", "dts", gz.alias("_gz"), *keys).repartition("asset_id").sortWithinPartitions("asset_id", "frame_idx")
    tags = {c: f"<tag key={quoteattr(k)} value=" for c, k in keys.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now, raw, out, path, n = None, None, None, "", 0

        def close() -> pa.RecordBatch:
            out.write(b"</frames></ffprobe:ffprobe>\n")
            out.close()
            if raw is not out:
                raw.close()
            return pa.RecordBatch.from_pydict({"asset_id": [now], "path": [path], "frames": [n]})

        for b in batches:
            columns = {c: b[c].to_pylist() for c in b.schema.names}
            for k, asset_id in enumerate(columns["asset_id"]):
                if out is None or asset_id != now:
                    if out is not None:
                        yield close()
                    now, n, zipped = asset_id, 0, columns["_gz"][k]
                    name = f"{asset_id}.{uuid.uuid4().hex}.qctools.xml{'.gz' if zipped else ''}"
                    path, raw = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1) if zipped else raw
                    out.write(b'<?xml version="1.0" encoding="UTF-8"?>\n<ffprobe:ffprobe xmlns:ffprobe="http://www.ffmpeg.org/schema/ffprobe"><frames>\n')
                times = "".join(f' {name}="{columns[c][k]!r}"' for c, name in (("pts", "pkt_pts_time"), ("dts", "pkt_dts_time")) if columns[c][k] is not None)
                values = "".join(f"{head}{quoteattr(repr(columns[c][k]))}/>" for c, head in tags.items() if columns[c][k] is not None)
                out.write(f'<frame media_type="{media_type}" n="{columns["frame_idx"][k]}"{times}>{values}</frame>\n'.encode())
                n += 1
        if out is not None:
            yield close()

    return written(own.mapInArrow(run, "asset_id string, path string, frames long"), "report-files")
