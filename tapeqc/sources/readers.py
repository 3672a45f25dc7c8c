"""Readers of reports, sidecars, specifications and listings, and the writer of findings. One row source each; nothing is collected."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from xml.etree.ElementTree import Element, ParseError, fromstring

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import hms_to_seconds, metric_name, parse_duration_tag
from ..tables import discard, shared_dir, written
from .reports import PART_BYTES, report_frames

def _asset() -> Column:
    """The file's name up to its first dot."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/]*$", 1)


def read_frame_reports(spark: SparkSession, paths: str | list[str] | DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """tags_long(asset_id, media_type, frame_idx, t, key, value) of frame reports in XML, gzipped or not; a large report is read by several tasks, each once. Paths may be a table (path)."""
    raw = written(report_frames(spark, paths, part_bytes), "report-frames")  # its times are chosen by all frames of an asset
    own = select_timestamp(raw)
    w = Window.partitionBy("asset_id", "_media_type").orderBy("t", "_n")
    own = own.withColumn("frame_idx", F.row_number().over(w) - 1)
    tags = own.select("asset_id", F.col("_media_type").alias("media_type"), "frame_idx", "t", F.explode("tag").alias("x"))
    return tags.select("asset_id", "media_type", "frame_idx", "t", F.col("x._key").alias("key"), F.col("x._value").try_cast("double").alias("value"))


def select_timestamp(frames: DataFrame) -> DataFrame:
    """frames with t: the attribute that an asset's first video frame has, decoding time before presentation time; frames without it leave."""
    video = F.col("_media_type") == "video"
    has = frames.groupBy("asset_id").agg(F.min_by(F.col("_pkt_dts_time").isNotNull(), F.when(video, F.coalesce("_n", "_pkt_dts_time", "_pkt_pts_time"))).alias("dts"))
    own = frames.join(has, "asset_id", "left")
    return own.withColumn("t", F.when(F.col("dts"), F.col("_pkt_dts_time")).otherwise(F.col("_pkt_pts_time"))).where("t is not null").drop("dts")


def pivot_metrics(tags: DataFrame, metrics: list[str]) -> DataFrame:
    """asset_id, frame_idx, t and a column for each named metric: wide frames, without a discovery pass."""
    own = tags.withColumn("metric", metric_name("key"))
    return own.groupBy("asset_id", "frame_idx", "t").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def pivot_audio(tags: DataFrame, metrics: list[str]) -> DataFrame:
    """asset_id, ch, frame_idx, t and a column for each metric of keys `...<channel>.<metric>`."""
    own = tags.select("*", F.regexp_extract("key", r"\.(\d+)\.(\w+)$", 1).try_cast("int").alias("ch"), F.regexp_extract("key", r"\.(\d+)\.(\w+)$", 2).alias("metric")).where("ch is not null")
    return own.groupBy("asset_id", "ch", "frame_idx", "t").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m.lower()) for m in metrics])


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are that, else Latin-1."""
    return F.when(F.is_valid_utf8(F.decode(content, "ISO-8859-1").cast("binary").cast("string")) & F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def _texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.regexp_extract("path", r"([^/]+?)\.[^/]*$", 1).alias("asset_id"), "path", decode_text(F.col("content")).alias("text"))


def _long(rows: DataFrame, tool: str) -> DataFrame:
    return rows.select("asset_id", F.lit(tool).alias("tool"), "section", "field", "value").where("value is not null")


def read_mediainfo(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_metadata rows of MediaInfo JSON: a section for each track type; `extra` members are fields of their track."""
    tracks = F.from_json(F.get_json_object("text", "$.media.track"), "array<map<string, string>>")
    own = _texts(spark, paths).select("asset_id", F.explode(tracks).alias("track")).withColumn("section", F.col("track")["@type"])
    extra = F.coalesce(F.from_json(F.col("track")["extra"], "map<string, string>"), F.create_map().cast("map<string, string>"))
    fields = F.map_concat(F.map_filter("track", lambda k, v: ~k.isin("@type", "extra")), F.map_filter(extra, lambda k, v: ~F.map_contains_key("track", k)))
    return _long(own.select("asset_id", "section", F.explode(fields).alias("field", "value")), "mediainfo")


def read_exiftool(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_metadata rows of ExifTool output: a JSON object, the first of an array, or `Key : value` lines."""
    own = _texts(spark, paths)
    trimmed = F.trim("text")
    first = F.when(trimmed.startswith("["), F.get_json_object(trimmed, "$[0]")).when(trimmed.startswith("{"), trimmed)
    pairs = F.transform(F.filter(F.split("text", r"\r?\n"), lambda x: x.contains(":")), lambda x: F.struct(F.regexp_replace(F.split(x, ":", 2).getItem(0), r"\s", ""), F.trim(F.split(x, ":", 2).getItem(1))))
    fields = F.coalesce(F.from_json(first, "map<string, string>"), F.map_from_entries(pairs))
    return _long(own.select("asset_id", F.lit("General").alias("section"), F.explode(fields).alias("field", "value")), "exiftool")


def read_ffprobe(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_metadata rows of ffprobe JSON: video (first stream), audio (second), format and format.tags."""
    get = lambda p: F.from_json(F.get_json_object("text", p), "map<string, string>")
    parts = F.array(*[F.struct(F.lit(n).alias("section"), get(p).alias("fields")) for n, p in (("video", "$.streams[0]"), ("audio", "$.streams[1]"), ("format", "$.format"), ("tags", "$.format.tags"))])
    own = _texts(spark, paths).select("asset_id", F.explode(parts).alias("x")).select("asset_id", "x.section", F.explode("x.fields").alias("field", "value"))
    return _long(own, "ffprobe")


def _parsed(files: DataFrame, schema: str, found: Callable[[Element], Iterable[tuple]]) -> DataFrame:
    """asset_id and the columns of schema: what `found` gives of each file's XML tree, names without their namespaces. A file that is not XML gives nothing."""
    whole = StructType.fromDDL(f"asset_id string, {schema}")
    kinds = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for asset_id, text in zip(b["asset_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                try:
                    root = fromstring(text.encode())
                except ParseError:
                    continue
                for x in root.iter():
                    x.tag = x.tag.rpartition("}")[2] if isinstance(x.tag, str) else ""
                rows += [(asset_id, *row) for row in found(root)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return files.select("asset_id", "text").mapInArrow(run, whole)


def _own(block: Element, name: str, inner: str) -> Iterator[Element]:
    """The blocks of a name in a block, at any depth, but not in a block of the name `inner` inside it."""
    for x in block:
        if x.get("name") == name:
            yield x
        elif x.get("name") != inner:
            yield from _own(x, name, inner)


def read_mediatrace_tags(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_metadata rows of MediaTrace XML: each tag name with the string of the first SimpleTag block that gives it one, blocks standing at any depth."""

    def found(root: Element) -> Iterator[tuple]:
        first: dict[str, str] = {}
        for block in root.iter("block"):
            if block.get("name") == "SimpleTag":
                name, value = ([d.text for x in _own(block, n, "SimpleTag") for d in x.iter("data") if d.text] for n in ("TagName", "TagString"))
                if name and value:
                    first.setdefault(name[0], value[0])
        yield from first.items()

    return _long(_parsed(_texts(spark, paths), "field string, value string", found).withColumn("section", F.lit("tags")), "mediatrace")


# Elements of a tag's targets that name one part of the file.
TARGET_UIDS = ("TrackUID", "EditionUID", "ChapterUID", "AttachmentUID")


def read_matroska_tags(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_id, tag_no, scope, name, value of Matroska tag XML: scope is global where a tag's targets name no part of the file, else targeted. Simple elements in others count."""

    def found(root: Element) -> Iterator[tuple]:
        for number, tag in enumerate(root.iter("Tag")):
            scope = "targeted" if any(t.find(uid) is not None for t in tag.iter("Targets") for uid in TARGET_UIDS) else "global"
            for simple in tag.iter("Simple"):
                yield number, scope, simple.findtext("Name") or "", simple.findtext("String") or ""

    return _parsed(_texts(spark, paths), "tag_no int, scope string, name string, value string", found)


def read_policy_tree(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """policy (the file's), node_id, parent_id, depth, op, name, tracktype, field, occurrence, operator, value: every group (op and/or) and rule (op null) of policy XML, of any depth, in the order of the file."""

    def found(root: Element) -> Iterator[tuple]:
        count = iter(range(1 << 31))

        def walk(x: Element, parent: int | None, depth: int) -> Iterator[tuple]:
            own = next(count)
            if x.tag == "rule":
                yield own, parent, depth, None, x.get("name"), x.get("tracktype"), x.get("value"), x.get("occurrence"), x.get("operator"), x.text
            else:
                yield own, parent, depth, "or" if x.get("type") == "or" else "and", x.get("name"), None, None, None, None, None
                for part in x:
                    if part.tag in ("policy", "rule"):
                        yield from walk(part, own, depth + 1)

        if root.tag == "policy":
            yield from walk(root, None, 0)

    own = _parsed(_texts(spark, paths), "node_id int, parent_id int, depth int, op string, name string, tracktype string, field string, occurrence string, operator string, value string", found)
    return own.withColumnRenamed("asset_id", "policy")


def av_durations(streams: DataFrame) -> DataFrame:
    """asset_id, video_s, audio_s, sample_rate: of the first video and audio stream that state them.

    streams: asset_id, index, codec_type, duration, tag_duration, sample_rate (strings, null where absent). A stream's own duration goes before its
    tag's; the sample rate is 0 where no audio stream has one.
    """
    own = streams.withColumn("_s", parse_duration_tag("duration", F.coalesce("tag_duration", F.lit(None).cast("string")))).withColumn("_rate", F.col("sample_rate").try_cast("int"))
    first = lambda kind, x: F.min_by(x, F.when((F.col("codec_type") == kind) & F.col(x).isNotNull(), F.col("index")))
    rate = F.min_by("_rate", F.when((F.col("codec_type") == "audio") & (F.col("_rate") != 0), F.col("index")))
    return own.groupBy("asset_id").agg(first("video", "_s").alias("video_s"), first("audio", "_s").alias("audio_s"), F.coalesce(rate, F.lit(0)).alias("sample_rate"))


def read_stream_hash_tags(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_id, stream, algorithm, hash of the stream hash tags in Matroska tag XML."""
    pick = lambda s: F.xpath_string("text", F.lit(f'//Simple[Name="{s.upper()}_STREAM_HASH"]/String'))
    own = _texts(spark, paths).select("asset_id", F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), pick(s).alias("raw")) for s in ("video", "audio")])).alias("x")).select("asset_id", "x.*")
    value = F.element_at(F.split("raw", "="), -1)
    return own.where("raw != ''").select("asset_id", "stream", F.when(F.length(value) == 32, "md5").when(F.length(value) == 64, "sha256").alias("algorithm"), value.alias("hash"))


def read_policy_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_id, rule, outcome of two-line CSV results; the shorter line decides."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    own = _texts(spark, paths).select("asset_id", F.split(lines.getItem(0), ",").alias("a"), F.split(lines.getItem(1), ",").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    return own.select("asset_id", F.explode(F.arrays_zip(F.slice("a", F.lit(1), n).alias("rule"), F.slice("b", F.lit(1), n).alias("outcome"))).alias("x")).select("asset_id", F.trim("x.rule").alias("rule"), F.trim("x.outcome").alias("outcome"))


def read_validator_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_id, line_no, line of validator logs, progress dots stripped."""
    own = _texts(spark, paths).select("asset_id", F.posexplode(F.split("text", r"\r?\n|\r")).alias("line_no", "line"))
    return own.select("asset_id", "line_no", F.regexp_replace("line", r"^\.+", "").alias("line")).where("line != ''")


def read_checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset_id, path, file_date, algorithm, checksum of checksum sidecars: the date at the name's end, the first token of 32 or 64 hex digits."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    day = F.regexp_extract(name, r"(\d{4}_\d{2}_\d{2})(?:_\d{2}_\d{2})?(?:_[A-Za-z0-9]+)?\.[^.]+$", 1)
    token = F.try_element_at(F.filter(F.split("text", r"[\s,;*]+"), lambda x: x.rlike("^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{64})$")), F.lit(1))
    own = _texts(spark, paths).select(F.regexp_extract(name, r"^(.*?)_\d{4}_\d{2}_\d{2}", 1).alias("asset_id"), "path", F.try_to_date(day, "yyyy_MM_dd").alias("file_date"), token.alias("checksum"))
    return own.where("checksum is not null").withColumn("algorithm", F.when(F.length("checksum") == 32, "md5").otherwise("sha256"))


def read_policy(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """policy, group_id, group_op, rule, tracktype, field, operator, value: the rules of policy XML with the group that each stands in."""
    nodes = read_policy_tree(spark, paths)
    groups = nodes.where("op IS NOT NULL").select("policy", F.col("node_id").alias("group_id"), F.col("op").alias("group_op"))
    rules = nodes.where("op IS NULL").select("policy", F.col("parent_id").alias("group_id"), F.col("name").alias("rule"), "tracktype", "field", "operator", "value")
    return rules.join(groups, ["policy", "group_id"]).select("policy", "group_id", "group_op", "rule", "tracktype", "field", "operator", "value")


def read_region_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """regions(asset_id, label, start_s, end_s) of duration files: label,start,end or start,end; a line without times is skipped."""
    lines = spark.read.text(paths).select(_asset().alias("asset_id"), F.split("value", ",").alias("p"))
    three = F.size("p") >= 3
    own = lines.where(F.size("p") >= 2).select("asset_id", F.when(three, F.trim(F.col("p").getItem(0))).otherwise("head").alias("label"), *[hms_to_seconds(F.when(three, F.get("p", F.lit(k + 1))).otherwise(F.get("p", F.lit(k)))).alias(n) for k, n in enumerate(("start_s", "end_s"))])
    return own.where("start_s is not null and end_s is not null")


def read_spec(spark: SparkSession, paths: str | list[str], profile: str | None = "default") -> DataFrame:
    """spec(profile, tool, section, field, accepted) of JSON {tool: {section: {field: value or list}}}; without a profile's name, each file is one by its own."""
    raw = _texts(spark, paths).select(F.col("asset_id").alias("_file"), F.explode(F.from_json("text", "map<string, map<string, map<string, string>>>")).alias("tool", "sections"))
    own = raw.select("_file", "tool", F.explode("sections").alias("section", "fields")).select("_file", "tool", "section", F.explode("fields").alias("field", "value"))
    accepted = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return own.select((F.col("_file") if profile is None else F.lit(profile)).alias("profile"), "tool", "section", "field", accepted.alias("accepted"))


def read_checks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """checks(profile, tag, threshold) of JSON {profile: {tag: threshold}}: thresholds of frame metrics; null or unreadable ones are not checked."""
    raw = _texts(spark, paths).select(F.explode(F.from_json("text", "map<string, map<string, string>>")).alias("profile", "tags"))
    return raw.select("profile", F.explode("tags").alias("tag", "value")).select("profile", "tag", F.col("value").try_cast("double").alias("threshold")).where("threshold IS NOT NULL")


#: Endings of frame reports, best first.
REPORTS = ("_qc_metadata.qctools.xml.gz", "_qc_metadata.qctools.mkv", "_vrecord_metadata.qctools.xml.gz", "_vrecord_metadata.qctools.mkv", ".qctools.xml.gz", ".qctools.mkv")


def asset_inventory(listing: DataFrame, video: tuple[str, ...] = (".mkv", ".mov", ".mp4")) -> DataFrame:
    """asset_id (the folder), video, report of a listing (path): the first video whose name does not hold `qctools`, and the best report."""
    own = listing.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("asset_id"), "path", F.lower(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"))
    is_video = F.col("name").rlike("(?:" + "|".join(v.replace(".", r"\.") for v in video) + ")$") & ~F.col("name").contains("qctools")
    rank = F.coalesce(*[F.when(F.col("name").endswith(e), F.lit(k)) for k, e in enumerate(REPORTS)])
    return own.groupBy("asset_id").agg(F.min(F.when(is_video, F.col("path"))).alias("video"), F.min_by("path", F.struct(F.coalesce(rank, F.lit(len(REPORTS))), "path")).alias("_r"), F.min(rank).alias("_k")).select("asset_id", "video", F.when(F.col("_k").isNotNull(), F.col("_r")).alias("report"))


def write_findings(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Findings as Parquet in `buckets` folders by the asset's hash, sorted by asset: no folder for each asset, and readers prune by asset.

    The findings of the assets in df replace theirs of earlier runs, so that writing twice leaves one copy; other assets' stay. Folders that hold none of
    df's assets are not touched; the others are written anew as wholes and exchanged when all are written.
    """
    spark = df.sparkSession
    new = written(df.withColumn("bucket", F.pmod(F.xxhash64("asset_id"), F.lit(buckets)).cast("int")), "findings")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        old = spark.read.schema(new.schema).parquet(path)
        touched = old.join(new.select("bucket").distinct(), "bucket", "left_semi")
        kept = touched.join(new.select("asset_id").distinct(), "asset_id", "left_anti").select(new.columns)
        whole = written(kept.unionByName(new), "findings")
        discard(new)
        new = whole
    dealt = new.repartition("bucket").sortWithinPartitions("bucket", "asset_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(new)


def write_sidecars(files: DataFrame) -> DataFrame:
    """Writes a small file for each row of files (name, content: binary) and returns path: a new folder that driver and executors share, with a folder inside for each attempt."""
    folder = shared_dir(files.sparkSession, "sidecars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        own = uuid.uuid4().hex
        for b in batches:
            paths = []
            for name, content in zip(b["name"].to_pylist(), b["content"].to_pylist(), strict=True):
                fs.create_dir(f"{root}/{own}", recursive=True)
                with fs.open_output_stream(f"{root}/{own}/{name}", compression=None) as f:
                    f.write(content)
                paths.append(f"{folder}/{own}/{name}")
            yield pa.RecordBatch.from_pydict({"path": paths}, pa.schema({"path": pa.string()}))

    own = files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    return written(own.mapInArrow(run, "path string"), "sidecar-files")
