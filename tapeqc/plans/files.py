"""Queries of the sources and sinks: sidecars, reports and findings written from the driver's tables and read back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio as A
from ..operators import brng as B
from ..operators import metadata as M
from ..operators import video as V
from ..sources import readers as R
from ..sources import reports
from ..tables import shared_dir
from .frames import FRAMES, frames, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _sidecars(spark: SparkSession, d: str, ending: str, text: str | Column, name: str = "concat('sup', s_suppkey)") -> list[str]:
    """A file for each supplier; the paths are listed as any reader's are."""
    own = table(spark, d, "supplier").select(F.concat(F.expr(name), F.lit(ending)).alias("name"), (F.expr(text) if isinstance(text, str) else text).cast("binary").alias("content"))
    return [r.path for r in R.write_sidecars(own).collect()]


# --- Frame reports -------------------------------------------------------------------------------------------------------------------

_METRICS = {m: f"lavfi.signalstats.{m}" for m in ("YMIN", "YMAX", "SATMAX", "BRNG")}


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of all assets, every other one gzipped, a third each with pts alone, dts alone, and both, dts half a second later; read back in small ranges."""
    k = F.col("asset_id") % 3
    own = frames(spark, d).select("asset_id", "frame_idx", F.when(k != 1, F.col("t")).alias("pts"), F.when(k == 1, F.col("t")).when(k == 2, F.col("t") + 0.5).alias("dts"), *_METRICS)
    files = reports.write_frame_reports(own, _METRICS, F.col("asset_id") % 2 == 0)
    return R.read_frame_reports(spark, files, part_bytes=1 << 17)


@_query("S1_frame_reports", f"WITH {FRAMES} SELECT asset_id, frame_idx, t + CASE WHEN asset_id % 3 = 2 THEN 0.5 ELSE 0 END AS t, {', '.join(_METRICS)} FROM frames")
def _(spark, d):
    return R.pivot_metrics(_reports(spark, d), list(_METRICS)).withColumn("asset_id", F.col("asset_id").cast("long"))


@_query("S2_select_timestamp", f"WITH {FRAMES} SELECT asset_id, CASE WHEN asset_id % 3 = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS first_t, max(t) + CASE WHEN asset_id % 3 = 2 THEN 0.5 ELSE 0 END AS last_t, count(*) AS frames FROM frames GROUP BY asset_id")
def _(spark, d):
    tags = _reports(spark, d).where(F.col("key") == _METRICS["YMAX"])
    return tags.groupBy(F.col("asset_id").cast("long").alias("asset_id")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("frames"))


# --- Sidecars ------------------------------------------------------------------------------------------------------------------------

@_query("S3_decode_text", "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def _(spark, d):
    text = F.coalesce("text", F.lit(""))
    latin = (F.col("doc_id") % 2 == 1) & ~text.rlike("[^\\x00-\\xFF]")
    own = table(spark, d, "documents").select("doc_id", F.when(latin, F.encode(F.when(latin, text), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("content"))
    return own.select("doc_id", F.md5(R.decode_text(F.col("content"))).alias("digest"))


_SUP = "concat('sup', s_suppkey)"
_SPECIFIED = [("mediainfo", "General", "Format"), ("mediainfo", "General", "ErrorDetectionType"), ("mediainfo", "Video", "Width")]


@_query("S4_mediainfo", f"SELECT {_SUP} AS asset_id, 'mediainfo' AS tool, s.section, s.field, s.value FROM supplier, unnest([{{'section': 'General', 'field': 'Format', 'value': s_name}}, {{'section': 'General', 'field': 'ErrorDetectionType', 'value': concat('per \"slice\" ', s_nationkey)}}, {{'section': 'Video', 'field': 'Width', 'value': (700 + s_nationkey)::VARCHAR}}]) AS u(s)")
def _(spark, d):
    member = lambda **x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k.replace("at_", "@")), v)])
    general = member(at_type=F.lit("General"), Format=F.col("s_name"), Other=F.lit("x"))
    video = member(at_type=F.lit("Video"), Format=F.lit("FFV1"), Width=(700 + F.col("s_nationkey")).cast("string"))
    extra = F.to_json(F.struct(F.concat(F.lit('per "slice" '), F.col("s_nationkey")).alias("ErrorDetectionType"), F.lit("24").alias("MaxSlicesCount")))
    first = F.concat(F.regexp_replace(F.to_json(general), r"\}$", ""), F.lit(',"extra":'), extra, F.lit("}"))
    paths = _sidecars(spark, d, ".mediainfo.json", F.concat(F.lit('{"media":{"@ref":"x","track":['), first, F.lit(","), F.to_json(video), F.lit("]}}")))
    return M.only_specified(R.read_mediainfo(spark, paths), spark.createDataFrame(_SPECIFIED, "tool string, section string, field string"))


@_query("S5_exiftool", f"SELECT {_SUP} AS asset_id, s.field, s.value FROM supplier, unnest([{{'field': 'FileType', 'value': s_name}}, {{'field': 'Duration', 'value': concat('0:00:', s_nationkey)}}]) AS u(s)")
def _(spark, d):
    text = "CASE WHEN s_suppkey % 2 = 0 THEN concat('[', to_json(map('FileType', s_name, 'Duration', concat('0:00:', s_nationkey))), ',{\"FileType\":\"second\"}]') ELSE concat('File Type   : ', s_name, '\\r\\nno pair here\\nDuration: 0:00:', s_nationkey, '\\n') END"
    return R.read_exiftool(spark, _sidecars(spark, d, ".exiftool.txt", text)).select("asset_id", "field", "value")


@_query("S6_ffprobe", f"SELECT {_SUP} AS asset_id, s.section, s.field, s.value FROM supplier, unnest([{{'section': 'video', 'field': 'codec_name', 'value': 'ffv1'}}, {{'section': 'video', 'field': 'width', 'value': (700 + s_nationkey)::VARCHAR}}, {{'section': 'audio', 'field': 'codec_name', 'value': 'flac'}}, {{'section': 'format', 'field': 'format_name', 'value': 'matroska,webm'}}, {{'section': 'tags', 'field': 'TITLE', 'value': s_name}}]) AS u(s) WHERE s_suppkey % 3 > 0 OR s.section <> 'audio'")
def _(spark, d):
    text = "concat('{\"streams\":[{\"codec_name\":\"ffv1\",\"width\":', 700 + s_nationkey, '}', CASE WHEN s_suppkey % 3 > 0 THEN ',{\"codec_name\":\"flac\"}' ELSE '' END, '],\"format\":{\"format_name\":\"matroska,webm\",\"tags\":', to_json(map('TITLE', s_name)), '}}')"
    found = R.read_ffprobe(spark, _sidecars(spark, d, ".ffprobe.json", text)).select("asset_id", "section", "field", "value")
    return found.where("field != 'tags'")


@_query("S7_mediatrace_tags", f"SELECT {_SUP} AS asset_id, s.field, s.value FROM supplier, unnest([{{'field': 'TITLE', 'value': concat(s_name, ' <&> é')}}, {{'field': 'INNER', 'value': s_nationkey::VARCHAR}}]) AS u(s)")
def _(spark, d):
    block = lambda name, *inner: f"""'<block offset="7" name="{name}" size="3">', {", ".join(inner)}, '</block>'"""
    data = lambda x: f"'<data offset=\"9\" name=\"Data\">', {x}, '</data>'"
    escaped = "replace(replace(replace(concat(s_name, ' <&> é'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    inner = block("SimpleTag", block("TagString", data("CAST(s_nationkey AS STRING)")), block("Deep", block("TagName", data("'INNER'"))))
    cdata = f"CASE WHEN s_suppkey % 2 = 0 THEN concat('<![CDATA[', s_name, ' <&> é]]>') ELSE {escaped} END"
    title = block("SimpleTag", block("TagName", data("'TITLE'")), inner, block("TagString", data(cdata)))
    again = block("SimpleTag", block("TagName", data("'TITLE'")), block("TagString", data("'later'")))
    text = f"concat('<?xml version=\"1.0\"?><MediaTrace xmlns=\"https://mediaarea.net/mediatrace\">', {block('Tags', block('Tag', title, again))}, '</MediaTrace>')"
    return R.read_mediatrace_tags(spark, _sidecars(spark, d, ".mediatrace.xml", text)).select("asset_id", "field", "value")


_MKV_TAGS = "concat('<Tags><Tag><Targets>', CASE WHEN s_suppkey % 3 = 0 THEN '<TrackUID>5</TrackUID>' ELSE '<TargetTypeValue>50</TargetTypeValue>' END, '</Targets><Simple><Name>NAME</Name><String>', replace(s_name, '#', '&#35;'), '</String></Simple></Tag><Tag><Simple><Name>VIDEO_STREAM_HASH</Name><String>', md5(s_name), '</String></Simple><Simple><Name>AUDIO_STREAM_HASH</Name><String>', sha2(s_name, 256), '</String></Simple></Tag></Tags>')"


@_query("S8_matroska_tags", f"SELECT {_SUP} AS asset_id, s.tag_no, s.scope, s.name, s.value FROM supplier, unnest([{{'tag_no': 0, 'scope': CASE WHEN s_suppkey % 3 = 0 THEN 'targeted' ELSE 'global' END, 'name': 'NAME', 'value': s_name}}, {{'tag_no': 1, 'scope': 'global', 'name': 'VIDEO_STREAM_HASH', 'value': md5(s_name)}}, {{'tag_no': 1, 'scope': 'global', 'name': 'AUDIO_STREAM_HASH', 'value': sha256(s_name)}}]) AS u(s)")
def _(spark, d):
    return R.read_matroska_tags(spark, _sidecars(spark, d, ".tags.xml", _MKV_TAGS))


@_query("S8_stream_hash_tags", f"SELECT {_SUP} AS asset_id, s.stream, s.algorithm, s.hash FROM supplier, unnest([{{'stream': 'video', 'algorithm': 'md5', 'hash': md5(s_name)}}, {{'stream': 'audio', 'algorithm': 'sha256', 'hash': sha256(s_name)}}]) AS u(s)")
def _(spark, d):
    return R.read_stream_hash_tags(spark, _sidecars(spark, d, ".tags.xml", _MKV_TAGS))


@_query("S9_policy_results", f"SELECT {_SUP} AS asset_id, s.rule, s.outcome FROM supplier, unnest([{{'rule': 'codec', 'outcome': CASE WHEN s_nationkey % 2 = 0 THEN 'pass' ELSE 'fail' END}}, {{'rule': 'width', 'outcome': 'pass'}}]) AS u(s)")
def _(spark, d):
    return R.read_policy_results(spark, _sidecars(spark, d, ".policy.csv", "concat('codec, width,unanswered\\n', if(s_nationkey % 2 = 0, 'pass', 'fail'), ',pass\\n')"))


@_query("S10_validator_log", f"SELECT {_SUP} AS asset_id, s_nationkey % 4 AS errors, s_suppkey % 3 AS clusters FROM supplier")
def _(spark, d):
    text = "concat('....', repeat('ERR201: bad\\n', s_nationkey % 4), repeat('..WRN0C2: odd Cluster at 12\\r\\n', CAST(s_suppkey % 3 AS INT)), 'done\\n')"
    lines = R.read_validator_log(spark, _sidecars(spark, d, ".log", text))
    return M.validator_summary(lines).select("asset_id", "errors", "clusters")


@_query("S11_checksums", f"SELECT {_SUP} AS asset_id, CAST(make_date(2024, 1 + s_nationkey % 12, 1 + s_nationkey) AS VARCHAR) AS file_date, CASE WHEN s_suppkey % 2 = 0 THEN 'md5' ELSE 'sha256' END AS algorithm, CASE WHEN s_suppkey % 2 = 0 THEN md5(s_name) ELSE sha256(s_name) END AS checksum FROM supplier")
def _(spark, d):
    name = f"concat({_SUP}, '_', date_format(make_date(2024, 1 + s_nationkey % 12, 1 + s_nationkey), 'yyyy_MM_dd'), if(s_suppkey % 3 = 0, '_12_30', ''), '_fixity')"
    paths = _sidecars(spark, d, ".txt", "concat('# tape.mkv abc ', if(s_suppkey % 2 = 0, md5(s_name), sha2(s_name, 256)), ' *tape.mkv\\n')", name)
    return R.read_checksums(spark, paths).select("asset_id", F.col("file_date").cast("string").alias("file_date"), "algorithm", "checksum")


@_query("S13_region_csv", f"SELECT {_SUP} AS asset_id, s.label, s.start_s, s.end_s FROM supplier, unnest([{{'label': CASE WHEN s_suppkey % 2 = 0 THEN 'primary' ELSE 'head' END, 'start_s': s_nationkey + 0.5, 'end_s': 60.0 + s_nationkey}}]) AS u(s)")
def _(spark, d):
    text = "concat(if(s_suppkey % 2 = 0, 'label,start,end\\nprimary,', 'start,end\\n'), '00:00:', lpad(s_nationkey, 2, '0'), '.5,00:01:', lpad(s_nationkey, 2, '0'), '\\n')"
    return R.read_region_csv(spark, _sidecars(spark, d, ".csv", text))


@_query("S15_asset_inventory", f"SELECT concat('/archive/', {_SUP}) AS asset_id, CASE WHEN s_nationkey % 3 > 0 THEN concat('/archive/', {_SUP}, '/tape.MKV') END AS video, CASE WHEN s_nationkey % 2 = 0 THEN concat('/archive/', {_SUP}, '/t_qc_metadata.qctools.mkv') ELSE concat('/archive/', {_SUP}, '/t_vrecord_metadata.qctools.xml.gz') END AS report FROM supplier")
def _(spark, d):
    names = F.array_compact(F.array(F.when(F.col("s_nationkey") % 3 > 0, "tape.MKV"), F.lit("t_vrecord_metadata.qctools.xml.gz"), F.when(F.col("s_nationkey") % 2 == 0, "t_qc_metadata.qctools.mkv"), F.lit("notes.txt")))
    own = table(spark, d, "supplier").select("s_suppkey", F.explode(names).alias("name"))
    return R.asset_inventory(own.select(F.concat(F.lit("/archive/sup"), "s_suppkey", F.lit("/"), "name").alias("path")))


# --- Specifications, profiles, policies ----------------------------------------------------------------------------------------------


@_query("S14_read_spec", f"SELECT {_SUP} AS profile, 'mediainfo' AS tool, s.section, s.field, s.accepted FROM supplier, unnest([{{'section': 'Video', 'field': 'Width', 'accepted': (700 + s_nationkey)::VARCHAR}}, {{'section': 'Video', 'field': 'Standard', 'accepted': concat('NTSC|', s_name)}}]) AS u(s)")
def _(spark, d):
    text = "concat('{\"mediainfo\":{\"Video\":{\"Width\":\"', 700 + s_nationkey, '\",\"Standard\":', to_json(array('NTSC', s_name)), '}}}')"
    paths = _sidecars(spark, d, ".spec.json", text)
    # One specification a file: each is a profile of its own, named by its file.
    return R.read_spec(spark, paths, profile=None).select("profile", "tool", "section", "field", F.array_join("accepted", "|").alias("accepted"))


_PROFILES = {"strict": {"YMIN": 12.0, "YMAX": 900.0, "SATMAX": 500.0}, "loose": {"YMAX": 960.0, "BRNG": 0.03, "UMIN": None}, "none": {}}
_PROFILE = "CASE WHEN asset_id % 4 = 0 THEN 'strict' WHEN asset_id % 4 = 1 THEN 'loose' WHEN asset_id % 4 = 2 THEN 'none' END"
_LIMITS = [(p, k, x) for p, tags in _PROFILES.items() for k, x in tags.items() if x is not None]
_FAILS = {(p, k): f"coalesce({_PROFILE} = '{p}' AND {k} {'<' if 'MIN' in k else '>'} {x}, false)" for p, k, x in _LIMITS}


def _limits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = frames(spark, d)
    paths = [r.path for r in R.write_sidecars(spark.createDataFrame([("checks.json", json.dumps(_PROFILES).encode())], "name string, content binary")).collect()]
    assets = own.select("asset_id").distinct().withColumn("profile", F.expr(_PROFILE))
    return own, V.thresholds_by_asset(assets, R.read_checks(spark, paths))


@_query("S14_read_checks", f"WITH {FRAMES} " + " UNION ALL ".join(f"SELECT asset_id, frame_idx, t, '{k}' AS tag, {k} AS value, CAST({x} AS DOUBLE) AS threshold FROM frames WHERE {_FAILS[p, k]}" for p, k, x in _LIMITS))
def _(spark, d):
    return V.profile_violations(*_limits(spark, d))


@_query("A1_profile_summary", f"WITH {FRAMES}, one AS (SELECT asset_id, count(*) AS total, count(*) FILTER (WHERE {' OR '.join(_FAILS.values())}) AS any_failed, {', '.join(f'count(*) FILTER (WHERE {c}) AS f_{p}_{k}' for (p, k), c in _FAILS.items())} FROM frames GROUP BY asset_id) " + " UNION ALL ".join(f"SELECT asset_id, '{k}' AS tag, f_{p}_{k} AS failed, round(100.0 * f_{p}_{k} / total, 6)::DOUBLE AS pct, any_failed, total FROM one WHERE {_PROFILE} = '{p}'" for p, k, _ in _LIMITS))
def _(spark, d):
    return V.profile_summary(*_limits(spark, d))


_POLICY_XML = """<?xml version="1.0"?><policy type="and" name="tape">
<rule name="brand" value="Brand" tracktype="General" occurrence="*" operator="=">Brand#13</rule>
<policy type="or" name="a or b"><rule name="small" value="Size" tracktype="Video" operator="&lt;">20</rule>
  <policy type="and" name="both"><rule name="large" value="Size" tracktype="Video" operator="&gt;=">40</rule>
    <policy type="or" name="deep"><rule name="tin" value="Type" tracktype="General" operator="=">ECONOMY TIN</rule><rule name="none" value="Missing" tracktype="General" operator="must not exist"/></policy></policy></policy>
<rule name="every track" value="Rate" tracktype="Audio" occurrence="all" operator="=">48</rule><rule name="second track" value="Rate" tracktype="Audio" occurrence="1" operator="=">44</rule>
<policy type="or" name="empty"/></policy>"""
_TREE = """p AS (SELECT p_partkey AS asset_id, p_brand = 'Brand#13' AS n1, p_size < 20 AS n3, p_size >= 40 AS n5, p_type = 'ECONOMY TIN' AS n7, p_partkey % 5 <> 0 AS n8, p_partkey % 2 = 0 AS n9, p_partkey % 2 <> 0 AS n10, true AS n11 FROM part),
q AS (SELECT *, n7 OR n8 AS n6 FROM p), r AS (SELECT *, n5 AND n6 AS n4 FROM q), s AS (SELECT *, n3 OR n4 AS n2 FROM r), tree AS (SELECT *, n1 AND n2 AND n9 AND n10 AND n11 AS n0 FROM s)"""
_PARENT = {0: None, 1: 0, 2: 0, 3: 2, 4: 2, 5: 4, 6: 4, 7: 6, 8: 6, 9: 0, 10: 0, 11: 0}


@_query("J5_policy_tree", f"WITH {_TREE} " + " UNION ALL ".join(f"SELECT asset_id, 'tape' AS policy, {k} AS node_id, {'NULL' if p is None else p}::INT AS parent_id, n{k} AS passed FROM tree" for k, p in _PARENT.items()))
def _(spark, d):
    part = table(spark, d, "part")
    tracks = lambda section, field, value, no=0: F.struct(F.lit(section).alias("section"), F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(no).alias("track_no"))
    even = F.col("p_partkey") % 2 == 0
    rows = F.array_compact(F.array(tracks("General", "Brand", F.col("p_brand")), tracks("General", "Type", F.col("p_type")), tracks("Video", "Size", F.col("p_size")), F.when(F.col("p_partkey") % 5 == 0, tracks("General", "Missing", F.lit("x"))), tracks("Audio", "Rate", F.lit(48)), tracks("Audio", "Rate", F.when(even, 48).otherwise(44), 1)))
    metadata = part.select(F.col("p_partkey").alias("asset_id"), F.explode(rows).alias("x")).select("asset_id", "x.*")
    paths = [r.path for r in R.write_sidecars(spark.createDataFrame([("tape.policy.xml", _POLICY_XML.encode())], "name string, content binary")).collect()]
    return M.check_policy_tree(metadata, part.select(F.col("p_partkey").alias("asset_id")), R.read_policy_tree(spark, paths))


_STEPS = [(1, "fixity", True, ["video"], [], "checksum"), (2, "report", True, ["video", "tools"], ["audio"], "frames"), (3, "bars", True, ["frames"], ["checksum", "clams"], None), (4, "off", False, ["nothing"], [], "x"), (5, "summary", True, ["frames", "x"], [], None)]
_READY = """i AS (SELECT s_suppkey AS asset_id, s_acctbal > 0 AS tools, s_nationkey % 2 = 0 AS audio, s_nationkey % 3 = 0 AS clams, s_suppkey % 4 = 0 AS frames FROM supplier),
k AS (SELECT *, frames OR tools AS has FROM i)"""


@_query("F12_step_readiness", f"""WITH {_READY}
SELECT asset_id, 'fixity' AS step, 'will_run' AS status, 'Ready to run' AS reason, '' AS missing, '' AS warnings FROM k
UNION ALL SELECT asset_id, 'report', CASE WHEN NOT tools THEN 'precondition_not_met' WHEN frames THEN 'already_exists' ELSE 'will_run' END, CASE WHEN NOT tools THEN 'Precondition not met: tools' WHEN frames THEN 'Output already exists' ELSE 'Ready to run' END, CASE WHEN tools THEN '' ELSE 'tools' END, CASE WHEN tools AND NOT frames AND NOT audio THEN 'audio' ELSE '' END FROM k
UNION ALL SELECT asset_id, 'bars', CASE WHEN has THEN 'will_run' ELSE 'precondition_not_met' END, CASE WHEN has THEN 'Ready to run' ELSE 'Precondition not met: frames' END, CASE WHEN has THEN '' ELSE 'frames' END, CASE WHEN has AND NOT clams THEN 'clams' ELSE '' END FROM k
UNION ALL SELECT asset_id, 'off', 'disabled', 'Disabled in configuration', '', '' FROM k
UNION ALL SELECT asset_id, 'summary', 'precondition_not_met', concat('Precondition not met: ', CASE WHEN has THEN 'x' ELSE 'frames, x' END), CASE WHEN has THEN 'x' ELSE 'frames, x' END, '' FROM k""")
def _(spark, d):
    have = lambda c, name: F.when(F.expr(c), name)
    items = F.array_compact(F.array(F.lit("video"), have("s_acctbal > 0", "tools"), have("s_nationkey % 2 = 0", "audio"), have("s_nationkey % 3 = 0", "clams"), have("s_suppkey % 4 = 0", "frames")))
    steps = spark.createDataFrame(_STEPS, "step_no int, step string, enabled boolean, needs array<string>, wants array<string>, makes string")
    return M.step_readiness(table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), items.alias("items")), steps)


@_query("P17_migrate_settings", """SELECT p_partkey AS asset_id, s.path, s.value FROM part, unnest([{'path': 'tools.qc.run', 'value': CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END}, {'path': 'tools.qc.size', 'value': p_size::VARCHAR}, {'path': 'fixity.check', 'value': CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'true' END}, {'path': 'toolsets.a', 'value': 'yes'}]) AS u(s)""")
def _(spark, d):
    pair = lambda path, value: F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"))
    rows = F.array_compact(F.array(pair("tools.qctools.run_tool", F.when(F.col("p_partkey") % 2 == 0, "yes").otherwise("No")), pair("tools.qctools.size", F.col("p_size")), pair("outputs.check_fixity", F.lit("Yes")), F.when(F.col("p_partkey") % 3 == 0, pair("fixity.check", F.col("p_brand"))), pair("toolsets.a", F.lit("yes"))))
    settings = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.explode(rows).alias("x")).select("asset_id", "x.*")
    renames = spark.createDataFrame([("tools.qctools", "tools.qc"), ("tools.qctools.run_tool", "tools.qc.run"), ("outputs.check_fixity", "fixity.check")], "old string, new string")
    return M.migrate_settings(settings, renames)


# --- Findings ------------------------------------------------------------------------------------------------------------------------


@_query("K1_write_findings", "SELECT p_partkey AS asset_id, s.finding, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS run FROM part, unnest(CASE WHEN p_partkey % 3 = 0 THEN [{'finding': p_type}] ELSE [{'finding': p_brand}, {'finding': p_size::VARCHAR}] END) AS u(s)")
def _(spark, d):
    part, path = table(spark, d, "part").withColumn("asset_id", F.col("p_partkey")), shared_dir(spark, "all-findings")
    first = part.select("asset_id", F.explode(F.array("p_brand", F.col("p_size").cast("string"))).alias("finding"), F.lit(1).alias("run"))
    second = part.where("p_partkey % 3 = 0").select("asset_id", F.col("p_type").alias("finding"), F.lit(2).alias("run"))
    for findings in (first, second, second):  # a run again leaves one copy
        R.write_findings(findings, path, buckets=16)
    return spark.read.schema("asset_id long, finding string, run int").parquet(path).select("asset_id", "finding", "run")


_DIFFERENCES = {"exiftool": ("FileType", "'MKV'", "p_brand", "p_size % 5 = 0"), "mediainfo": ("Width", "'720'", "p_size::VARCHAR", "p_size <> 20"), "mediatrace": ("TITLE", "'t'", "p_type", "p_partkey % 7 = 1")}


@_query("K2_difference_report", " UNION ALL ".join(f"SELECT p_partkey AS asset_id, {k} AS tool_rank, '{tool}' AS tool, '{field}' AS field, {expected} AS expected, {actual} AS actual FROM part WHERE {where}" for k, (tool, (field, expected, actual, where)) in enumerate(_DIFFERENCES.items())))
def _(spark, d):
    part = table(spark, d, "part")
    one = lambda field, expected, actual, where: part.where(where).select(F.col("p_partkey").alias("asset_id"), F.lit(field).alias("field"), F.expr(expected).alias("expected"), F.expr(actual.replace("p_size::VARCHAR", "CAST(p_size AS STRING)")).alias("actual"))
    return M.metadata_difference_report({tool: one(*x) for tool, x in _DIFFERENCES.items()})


# --- Unions, bars, borders, periods --------------------------------------------------------------------------------------------------

_PASS = {("bars", "primary"): (0, 3.0, "true"), ("bars", "second-pass"): (1, 1.5, "p_partkey % 2 = 0"), ("tone", "primary"): (2, 2.0, "p_size > 10"), ("tone", "second-pass"): (3, 0.5, "p_partkey % 5 = 0")}


@_query("U1_union_passes", "WITH u AS (" + " UNION ALL ".join(f"SELECT p_size AS asset_id, '{kind}' AS kind, '{label}' AS label, {k} AS k, {by} * (p_partkey % 40) AS start_s, {by} * (p_partkey % 40) + p_partkey / 8.0 AS end_s FROM part WHERE {where}" for (kind, label), (k, by, where) in _PASS.items()) + ") SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY start_s, k, end_s) AS place, kind, label, start_s, end_s FROM u")
def _(spark, d):
    part = table(spark, d, "part")
    own = lambda by, where: part.where(where).select(F.col("p_size").alias("asset_id"), (by * (F.col("p_partkey") % 40)).alias("start_s"), (by * (F.col("p_partkey") % 40) + F.col("p_partkey") / 8.0).alias("end_s"))
    return V.union_passes({name: own(by, where) for name, (_, by, where) in _PASS.items()})


@_query("U2_union_detections", "WITH u AS (SELECT p_size AS asset_id, 'r128' AS method, 0 AS k, 'R128-A' AS criterion, 'mix' AS channel, (p_partkey % 50)::DOUBLE AS start_s, p_partkey % 50 + 30.0 + p_partkey / 64.0 AS end_s, 'high' AS confidence FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_size, 'astats', 1, p_brand, 'Ch1', (p_partkey % 30)::DOUBLE, p_partkey % 30 + 30.0 + p_partkey / 64.0, 'medium' FROM part) SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY start_s, k, end_s, criterion, channel) AS place, method, criterion, channel, start_s, end_s, confidence FROM u")
def _(spark, d):
    part = table(spark, d, "part")
    own = lambda n, criterion, channel, confidence: (F.col("p_size").alias("asset_id"), criterion.alias("criterion"), F.lit(channel).alias("channel"), (F.col("p_partkey") % n).cast("double").alias("start_s"), (F.col("p_partkey") % n + 30.0 + F.col("p_partkey") / 64.0).alias("end_s"), F.lit(confidence).alias("confidence"))
    return A.union_detections({"r128": part.where("p_partkey % 2 = 0").select(*own(50, F.lit("R128-A"), "mix", "high")), "astats": part.select(*own(30, F.col("p_brand"), "Ch1", "medium"))})


@_query("J15_bars_agreement_none", "SELECT s_suppkey AS asset_id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN CASE WHEN s_nationkey <= 10 THEN 'agree' ELSE 'differ' END WHEN s_suppkey % 3 = 0 THEN 'first only' WHEN s_suppkey % 2 = 0 THEN 'second only' ELSE 'none' END AS verdict FROM supplier")
def _(spark, d):
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), (F.col("s_nationkey") / 10.0).alias("late"))
    ends = lambda where, late: own.where(where).select("asset_id", (10.0 + late).alias("end_s"))
    return V.bars_agreement(ends("asset_id % 3 = 0", F.lit(0.0)), ends("asset_id % 2 = 0", F.col("late")), assets=own)


@_query("A11_border_widths", "SELECT p_partkey AS asset_id, p_size AS left_px, greatest(0, 720 - p_size - w) AS right_px, p_size % 9 AS top_px, greatest(0, 486 - p_size % 9 - 470) AS bottom_px, round(100.0 - 100.0 * w * 470 / (720 * 486), 6) AS crop_pct FROM (SELECT *, (680 + p_partkey % 30)::INT AS w FROM part)")
def _(spark, d):
    area = {"x": "p_size", "y": "p_size % 9", "w": "CAST(680 + p_partkey % 30 AS INT)", "h": "470", "width": "720", "height": "486"}
    return B.border_widths(table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), *[F.expr(e).alias(c) for c, e in area.items()]))
