"""Frame reports read by several tasks."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tapeqc.sources import readers as R
from tapeqc.sources import reports


def report(n, seed=0):
    rng, rows = random.Random(seed), []
    for k in range(n):
        kind = "audio" if k % 3 == 2 else "video"
        tags = {f"lavfi.signalstats.{m}": rng.randint(0, 1000) for m in rng.sample(["YMAX", "YMIN", "BRNG", "SATMAX"], rng.randint(0, 4))}
        rows.append((kind, k / 8, k, {k2: float(v) for k2, v in tags.items()} | ({"note": "<frame é & \"x\" 'y'"} if k % 50 == 7 else {})))
    esc = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    frame = lambda r: f'<frame media_type="{r[0]}" pkt_pts_time="{r[1]}" n="{r[2]}"' + ("/>" if not r[3] else ">\n" + "".join(f'  <tag value="{esc(v)}" key="{k}"/>\n' for k, v in r[3].items()) + "</frame>") + "\n"
    return rows, '<?xml version="1.0"?>\n<ffprobe:ffprobe xmlns:ffprobe="http://x"><program/><frames>\n' + "".join(map(frame, rows)) + "</frames><streams><stream index='0'/></streams></ffprobe:ffprobe>\n"


@pytest.mark.parametrize("ending", [".xml", ".xml.gz"])
@pytest.mark.parametrize("part", [200, 3001, 1 << 30])
def test_ranges(tmp_path, ending, part):
    rows, text = report(900)
    path = str(tmp_path / f"tape.qctools{ending}")
    data = text.encode() if ending == ".xml" else gzip.compress(text[:9000].encode()) + gzip.compress(text[9000:].encode())
    (tmp_path / f"tape.qctools{ending}").write_bytes(data)
    found, parts = [], reports._Reader([path], part).partitions()
    assert len(parts) == 1 if part == 1 << 30 else len(parts) > 4 and (ending == ".xml" or len(parts) <= 16)
    for p in parts:
        found += [x for b in reports.parsed_frames(reports.frame_blocks(p.path, p.start, p.end), "tape") for x in b.to_pylist()]
    assert [x["_n"] for x in found] == [r[2] for r in rows]
    assert [{t["_key"]: t["_value"] for t in x["tag"]} for x in found] == [{k: str(v) for k, v in r[3].items()} for r in rows]


def test_large_report_in_tasks(spark, tmp_path):
    rows, text = report(40_000, 3)
    (tmp_path / "a.one.qctools.xml.gz").write_bytes(gzip.compress(text.encode(), 1))
    (tmp_path / "b.qctools.xml").write_text(text)
    (tmp_path / "c.qctools.xml").write_text("<ffprobe><frames></frames></ffprobe>")
    frames = reports.report_frames(spark, str(tmp_path), part_bytes=1 << 20)
    assert frames.rdd.getNumPartitions() >= 6
    per_task = frames.groupBy("asset_id", F.spark_partition_id()).count().groupBy("asset_id").agg(F.count("*").alias("tasks"), F.sum("count").alias("n")).collect()
    assert {r.asset_id for r in per_task} == {"a", "b"} and all(r.tasks > 3 and r.n == 40_000 for r in per_task)
    tags = R.read_frame_reports(spark, [str(tmp_path / "a.one.qctools.xml.gz"), str(tmp_path / "b.qctools.xml")])
    wide = R.pivot_metrics(tags.where("media_type = 'video'"), ["YMAX", "BRNG"])
    want = {r[1]: r[3].get("lavfi.signalstats.YMAX") for r in rows if r[0] == "video" and any(k != "note" for k in r[3])}
    got = wide.where("asset_id = 'a'").collect()
    assert {r.t: r.YMAX for r in got if r.t in want} == want and wide.where("asset_id = 'b'").count() == len(got)


def test_clocks_and_odd_files(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    frame = lambda kind, n, **times: f'<frame media_type="{kind}" n="{n}" ' + " ".join(f'pkt_{k}_time="{v}"' for k, v in times.items()) + '><tag key="k" value="1"/></frame>'
    put("dts.xml", ("<f><frames>" + frame("audio", 0, pts=9) + frame("video", 0, pts=1, dts=5) + frame("video", 1, pts=2, dts=6) + frame("audio", 1, pts=9, dts=7) + "</frames></f>").encode())
    put("pts.xml", ("<f><frames>" + frame("video", 0, pts=1) + frame("video", 1, pts=2, dts=6) + "</frames></f>").encode())
    put("odd.xml", b'<f><frames><frame media_type="video" n="0" pkt_pts_time="0.5"><tag key="k" value="2"/><tag key="name" value="caf\xe9"/></frame></frames></f>')
    put("cut.xml.gz", gzip.compress(("<f><frames>" + frame("video", 0, pts=1) + "</frames></f>").encode()))
    got = sorted((r.asset_id, r.media_type, r.frame_idx, r.t, r.key, r.value) for r in R.read_frame_reports(spark, str(tmp_path)).collect())
    assert {r[:5] for r in got} == {("dts", "video", 0, 5.0, "k"), ("dts", "video", 1, 6.0, "k"), ("dts", "audio", 0, 7.0, "k"), ("pts", "video", 0, 1.0, "k"), ("pts", "video", 1, 2.0, "k"), ("odd", "video", 0, 0.5, "k"), ("odd", "video", 0, 0.5, "name"), ("cut", "video", 0, 1.0, "k")}
    with pytest.raises(Exception, match="missing"):
        R.read_frame_reports(spark, str(tmp_path / "missing.xml")).count()


def test_written_reports_come_back(spark):
    rows = [(a, k, None if a == 1 else k / 4, k / 4 + 1 if a else None, float(k) if k % 5 else None) for a in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "asset_id int, frame_idx long, pts double, dts double, YMAX double")
    files = reports.write_frame_reports(df, {"YMAX": "lavfi.signalstats.YMAX"}, F.col("asset_id") != 1).collect()
    assert sorted((r.asset_id, r.frames, r.path.endswith(".gz")) for r in files) == [("0", 40, True), ("1", 40, False), ("2", 40, True)]
    tags = R.read_frame_reports(spark, [r.path for r in files])
    got = sorted((int(r.asset_id), r.t, r.value) for r in tags.collect())
    assert got == sorted((a, d if a else p, x) for a, _, p, d, x in rows if x is not None)
