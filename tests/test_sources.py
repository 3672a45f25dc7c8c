import gzip
import json
from collections import Counter

from pyspark.sql import functions as F

from tapeqc.functions import scalars as P
from tapeqc.operators import metadata as M
from tapeqc.sources import readers as R


def test_frame_reports_pivot(spark, tmp_path):
    frame = lambda kind, t, n, tags: f'<frame media_type="{kind}" pkt_pts_time="{t}" n="{n}">' + "".join(f'<tag key="{k}" value="{v}"/>' for k, v in tags.items()) + "</frame>"
    body = "".join(frame("video", k / 4, k, {"lavfi.signalstats.YMAX": 200 + k, "lavfi.psnr.mse.u": 1}) + frame("audio", k / 4, k, {"lavfi.astats.1.RMS_level": -21.0, "lavfi.astats.2.RMS_level": "-inf"}) for k in range(5))
    path = tmp_path / "tape.qctools.xml.gz"
    path.write_bytes(gzip.compress(f"<ffprobe><frames>{body}</frames></ffprobe>".encode()))
    tags = R.read_frame_reports(spark, str(path))
    wide = R.pivot_metrics(tags.where("media_type = 'video'"), ["YMAX", "mse.u"]).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.t, r.YMAX, r["mse.u"]) for r in wide] == [(k, k / 4, 200.0 + k, 1.0) for k in range(5)]
    audio = R.pivot_audio(tags.where("media_type = 'audio'"), ["RMS_level"]).select("ch", P.floor_neg_inf("rms_level").alias("x")).distinct().collect()
    assert sorted((r.ch, r.x) for r in audio) == [(1, -21.0), (2, -120.0)]


def test_metadata_sidecars(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    mi = put("a.mediainfo.json", json.dumps({"media": {"track": [{"@type": "General", "Format": "Matroska", "extra": {"ErrorDetectionType": "Per slice"}}, {"@type": "Video", "Format": "FFV1"}]}}))
    rows = {(r.section, r.field): r.value for r in R.read_mediainfo(spark, mi).collect()}
    assert rows["General", "ErrorDetectionType"] == "Per slice" and rows["Video", "Format"] == "FFV1"
    ex = put("a.exif.txt", "File Type : MKV\nDuration : 0:01:02\n")
    assert {(r.field, r.value) for r in R.read_exiftool(spark, ex).collect()} == {("FileType", "MKV"), ("Duration", "0:01:02")}
    ff = put("a.ffprobe.json", json.dumps({"streams": [{"codec_name": "ffv1"}, {"codec_name": "flac"}], "format": {"format_name": "matroska", "tags": {"TITLE": "x"}}}))
    assert {("video", "ffv1"), ("audio", "flac"), ("tags", "x")} <= {(r.section, r.value) for r in R.read_ffprobe(spark, ff).collect()}
    spec = put("spec.json", json.dumps({"mediainfo": {"Video": {"Format": "FFV1", "Standard": ["NTSC", "PAL"]}}}))
    assert {r.field: r.accepted for r in R.read_spec(spark, spec).collect()} == {"Format": ["FFV1"], "Standard": ["NTSC", "PAL"]}
    policy = put("p.xml", '<policy type="and" name="P"><rule name="r1" value="Format" tracktype="Video" operator="=">FFV1</rule><policy type="or" name="G"><rule name="r2" value="Width" tracktype="Video" operator="=">720</rule></policy></policy>')
    assert {(r.rule, r.group_op, r.value) for r in R.read_policy(spark, policy).collect()} >= {("r1", "and", "FFV1"), ("r2", "or", "720")}
    tags = put("a.tags.xml", "<Tags><Tag><Simple><Name>VIDEO_STREAM_HASH</Name><String>" + "a" * 32 + "</String></Simple></Tag></Tags>")
    assert [(r.stream, r.algorithm) for r in R.read_stream_hash_tags(spark, tags).collect()] == [("video", "md5")]


def test_tags_by_block(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    block = lambda name, *inner: f'<block offset="1" name="{name}">{"".join(inner)}</block>'
    data = lambda x: f"<data>{x}</data>"
    tag = lambda name, *value: block("SimpleTag", block("TagName", data(name)), *[block("TagString", data(v)) for v in value])
    trace = put("t.mediatrace.xml", "<MediaTrace>" + tag("ALONE") + tag("TITLE", "a &amp; b") + tag("TITLE", "later") + tag("CODEC", "FFV1") + "</MediaTrace>")
    assert {(r.field, r.value) for r in R.read_mediatrace_tags(spark, trace).collect()} == {("TITLE", "a & b"), ("CODEC", "FFV1")}
    simple = lambda n, v: f"<Simple><Name>{n}</Name><String>{v}</String></Simple>"
    xml = put("t.tags.xml", "<Tags><Tag><Targets><TargetTypeValue>50</TargetTypeValue></Targets>" + simple("A", "1") + simple("B", "&lt;2") + "</Tag><Tag><Targets><TrackUID>7</TrackUID></Targets>" + simple("C", "3") + "</Tag><Tag>" + simple("D", "4") + "</Tag></Tags>")
    assert sorted((r.scope, r.name, r.value) for r in R.read_matroska_tags(spark, xml).collect()) == [("global", "A", "1"), ("global", "B", "<2"), ("global", "D", "4"), ("targeted", "C", "3")]


def test_logs_regions_checksums(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    result = put("a.policy.csv", "one,two,three\npass,fail\n")
    assert [(r.rule, r.outcome) for r in R.read_policy_results(spark, result).collect()] == [("one", "pass"), ("two", "fail")]
    log = put("a.log", "....WRN0C2: odd Cluster at 12\nERR201: bad\n")
    assert [r.line for r in R.read_validator_log(spark, log).orderBy("line_no").collect()] == ["WRN0C2: odd Cluster at 12", "ERR201: bad"]
    sums = put("tape_2024_01_31_fixity.md5", "b" * 32 + "  tape.mkv\n")
    row = R.read_checksums(spark, sums).first()
    assert (row.asset_id, str(row.file_date), row.algorithm) == ("tape", "2024-01-31", "md5")
    regions = put("a.csv", "name,start,end\nhead,00:00:01.5,00:01:00\n00:02:00,00:03:00\n")
    assert sorted((r.label, r.start_s, r.end_s) for r in R.read_region_csv(spark, regions).collect()) == [("head", 1.5, 60.0), ("head", 120.0, 180.0)]
    listing = spark.createDataFrame([("/a/x/x.mkv",), ("/a/x/x.qctools.mkv",), ("/a/x/x_qc_metadata.qctools.xml.gz",), ("/a/y/y.txt",)], "path string")
    assert {r.asset_id: (r.video, r.report) for r in R.asset_inventory(listing).collect()} == {"/a/x": ("/a/x/x.mkv", "/a/x/x_qc_metadata.qctools.xml.gz"), "/a/y": (None, None)}


def test_findings_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "asset_id long, v string")
    R.write_findings(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_scalars(spark):
    one = spark.range(1).select(
        P.seconds_to_timecode(F.lit(600.0), 30000 / 1001, 0, True).alias("df"), P.timecode_to_frames(F.lit("00:10:00;00")).alias("frames"), P.timecode_to_frames(F.lit("bad")).alias("bad"), P.hms_to_seconds(F.lit("1:02:03.5")).alias("s"), P.format_elapsed(F.lit(65.26)).alias("e"), P.metric_name(F.lit("lavfi.psnr.mse.u")).alias("m"),
        P.dropped_sample_score(F.lit(3), F.lit(0.0)).alias("d"), P.characterize_imbalance(F.lit(-4.0)).alias("c"), P.byte_offset_seconds(F.lit(50), F.lit(100), F.lit(10.0)).alias("o"), P.format_percentage(F.lit(1), F.lit(3)).alias("p"),
        P.border_regions(F.lit(10), F.lit(0), F.lit(700), F.lit(480), 720, 480).alias("b"), P.parse_duration_tag(F.lit(None).cast("string"), F.lit("00:00:10.5")).alias("t"), R.decode_text(F.unhex(F.lit("636166e9"))).alias("latin"), R.decode_text(F.unhex(F.lit("636166c3a9"))).alias("utf"),
    ).first()
    assert one.df == "00:10:00;00"
    assert (one.frames.frames, one.frames.drop_frame, one.bad.frames) == (17982, True, 0)
    assert (one.s, one.e, one.m, one.c, one.o, one.p, one.t) == (3723.5, "1:05.3", "mse.u", "Moderate imbalance", 5.0, "33.33%", 10.5)
    assert (one.d.score, one.d.status) == (0.266, "warning")
    assert [(b.side, b.w) for b in one.b] == [("left", 10), ("right", 10)]
    assert (one.latin, one.utf) == ("café", "café")


def test_xml_that_is_none_gives_nothing(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    paths = [put("bad.tags.xml", "<Tags><Tag>"), put("empty.tags.xml", ""), put("ok.tags.xml", "<Tags><Tag><Simple><Name>A</Name><String>1</String><Simple><Name>B</Name></Simple></Simple></Tag></Tags>")]
    assert sorted((r.asset_id, r.name, r.value) for r in R.read_matroska_tags(spark, paths).collect()) == [("ok", "A", "1"), ("ok", "B", "")]
    policy = put("odd.xml", '<other><policy type="or"/></other>')
    assert R.read_policy_tree(spark, policy).count() == 0


def test_findings_replace_those_of_their_assets(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = lambda assets, run: spark.createDataFrame([(a, f"f{k}", run) for a in assets for k in range(3)], "asset_id int, finding string, run int")
    read = lambda: Counter((r.asset_id, r.run) for r in spark.read.parquet(path).collect())
    R.write_findings(rows(range(40), 1), path, buckets=8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "findings").rglob("*.parquet")}
    for _ in range(2):
        R.write_findings(rows([3, 5, 100], 2), path, buckets=8)
        assert read() == Counter({(a, 2 if a in (3, 5) else 1): 3 for a in range(40)} | {(100, 2): 3})
    kept = [p for p in before if p.exists()]
    assert kept and all(p.stat().st_mtime_ns == before[p] for p in kept)  # folders without these assets are left alone


def test_settings_move_by_their_longest_name(spark):
    settings = spark.createDataFrame([(1, "a.b.c", "yes"), (1, "a.bc", "yes"), (1, "x", "old"), (1, "y", "new"), (2, "a.b", "No"), (2, "z", None)], "asset_id int, path string, value string")
    renames = spark.createDataFrame([("a", "q"), ("a.b", "r"), ("x", "y")], "old string, new string")
    assert sorted(map(tuple, M.migrate_settings(settings, renames).collect())) == [(1, "q.bc", "true"), (1, "r.c", "true"), (1, "y", "new"), (2, "r", "false"), (2, "z", None)]
