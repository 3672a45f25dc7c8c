"""What the findings of a reviewer's runs on larger tables were about, on small ones."""

import random
import statistics

from pyspark.sql import functions as F

from tapeqc.operators import audio, brng, intervals, metadata, video
from tapeqc.plans import catalog
from tapeqc.sources import readers, reports


def test_starts_are_refined_in_one_pass(spark):
    """the frames after a frame were read anew for each, so that an asset of n frames took n * n steps."""
    pick = random.Random(4)
    levels = [pick.choice([-70.0, -20.0, -20.0, None]) for _ in range(300)]
    own = spark.createDataFrame([(1, k, k * 0.25, x) for k, x in enumerate(levels)], "asset_id long, frame_idx long, t double, r128_m double")
    starts = [pick.uniform(-1, 80) for _ in range(40)] + [k * 0.25 for k in range(0, 300, 17)]
    out = audio.refine_start(spark.createDataFrame([(1, s, 99.0, s) for s in starts], "asset_id long, start_s double, end_s double, was double"), own)
    good = []
    for k in range(300):
        near = [x for x in levels[k : k + 4] if x is not None]
        good.append(bool(near) and -45 <= statistics.median(near) <= -8)
    for r in out.collect():
        k = next((k for k in range(300) if k * 0.25 >= r.was), 0)
        while k and good[k - 1]:
            k -= 1
        assert r.start_s == k * 0.25, r
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().toString()


def test_spreads_at_a_threshold(spark):
    """F6 to F8: of 5, 1 and 5 levels 2 dB apart the spread is 2 dB to the bit or less by a bit, by the order of the rows and the engine."""
    pick = random.Random(6)
    rows = []
    for asset in range(60):
        levels = [-20.0] * 5 + [-22.0] + [-24.0] * 5 + [None]
        pick.shuffle(levels)
        rows += [(asset, k, k * 2.5, x, -21.0, 5.0, -12.0, -22.0) for k, x in enumerate(levels)]
    kind = "asset_id long, frame_idx long, t double, r128_m double, r128_s double, r128_lra double, r128_lra_high double, r128_i double"
    want = set()
    for asset in range(60):
        n = mean = sq = 0.0
        for x in (r[3] for r in rows if r[0] == asset and r[3] is not None):
            n += 1
            before, mean = mean, mean + (x - mean) / n
            sq += (x - mean) * (x - before)
        if (sq / (n - 1)) ** 0.5 < 2:
            want.add(asset)
    assert 0 < len(want) < 60
    pick.shuffle(rows)
    for parts in (1, 7):
        own = spark.createDataFrame(rows, kind).repartition(parts)
        assert {r.asset_id for r in audio.r128_timecode(own).where("criterion LIKE 'R128-A%'").collect()} == want


def test_policy_levels_are_read_once(spark):
    """each level held all below it twice, and joins that broadcast one side of every asset's rules."""
    deep = 7
    nodes = [("p", 2 * k, 2 * k - 2 if k else None, k, "or" if k % 2 else "and", None, None, None, None, None) for k in range(deep)]
    nodes += [("p", 2 * k + 1, 2 * k, k + 1, None, "General", "x", "*", "=", str(k % 3)) for k in range(deep)]
    tree = spark.createDataFrame(nodes, "policy string, node_id int, parent_id int, depth int, op string, tracktype string, field string, occurrence string, operator string, value string")
    assets = spark.range(4).select(F.col("id").alias("asset_id"))
    out = metadata.check_policy_tree(assets.select("asset_id", F.lit("General").alias("section"), F.lit("x").alias("field"), F.col("asset_id").cast("string").alias("value")), assets, tree)
    want = {}
    for a in range(4):
        below = None
        for k in reversed(range(deep)):
            want[a, 2 * k + 1] = rule = str(a) == str(k % 3)
            below = rule if below is None else (rule or below) if k % 2 else (rule and below)
            want[a, 2 * k] = below
    assert {(r.asset_id, r.node_id): r.passed for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().toString()


def test_small_reports_share_tasks(spark):
    """a task for each range of each report, twice over, and all paths through the driver."""
    rows = [(a, k, k * 0.5, 7.0 + a) for a in range(40) for k in range(30)]
    own = spark.createDataFrame(rows, "asset_id long, frame_idx long, pts double, Y double").withColumn("dts", F.lit(None).cast("double"))
    files = reports.write_frame_reports(own, {"Y": "lavfi.signalstats.YMAX"}, F.col("asset_id") % 2 == 0)
    raw = reports.report_frames(spark, files.select("path"), part_bytes=1 << 10)
    assert raw.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted((int(r.asset_id), r._n, r._pkt_pts_time, float(r.tag[0]._value)) for r in raw.collect()) == rows
    tags = readers.read_frame_reports(spark, files, part_bytes=1 << 10)
    assert sorted((int(r.asset_id), r.frame_idx, r.t, r.value) for r in tags.collect()) == rows
    assert "MapInArrow" not in tags._jdf.queryExecution().toString()  # parsed once


def test_averages_are_rounded_as_they_are(spark):
    """of numbers halfway between two texts the even one, and of 1.005, which is a little less, 1.00."""
    texts = {0.125: "0.12% (low-level)", 0.375: "0.38% (low-level)", 1.005: "1.00%", 1.125: "1.12%", 2.5: "2.50%", 1234.5: "1234.50%", 0.0625: "0.062% (minimal)"}
    own = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "asset_id long, pct double")
    none = spark.createDataFrame([], "asset_id long, edge_pct double, linear_pct double")
    got = {r.max_pct: r.assessment for r in brng.violation_assessment(own, none).collect()}
    assert got == {x: f"Average BRNG: {text}" for x, text in texts.items()}


def test_settings_are_not_copied(spark):
    """a copy of each setting for each of its roots, gathered again by an aggregation."""
    settings = spark.createDataFrame([(1, "a.b.c", "yes"), (1, "a.b.d", "No"), (1, "a.x", "yes"), (1, "n.c", "kept"), (2, "a.bb", "yes"), (2, "a", "1"), (2, None, "q")], "asset_id long, path string, value string")
    names = [("a.b", "n"), ("a", "z"), ("gone", "g")]
    want = {(1, "n.c", "kept"), (1, "n.d", "false"), (1, "z.x", "true"), (2, "z.bb", "true"), (2, "z", "1"), (2, None, "q")}
    for more in (0, metadata.LITERAL_RENAMES):
        renames = spark.createDataFrame(names + [(f"other{k}", "o") for k in range(more)], "old string, new string")
        out = metadata.migrate_settings(settings, renames)
        assert {tuple(r) for r in out.collect()} == want
        if not more:
            assert "Generate" not in out._jdf.queryExecution().toString()


def test_detections_are_made_once(spark):
    """what made the detections ran again for each of the joins with them."""
    own = spark.range(40).select((F.col("id") % 2).alias("asset_id"), F.when(F.col("id") < 20, "R128-A").otherwise("astats (ch1)").alias("criterion"), F.lit("ch1").alias("channel"), F.col("id").cast("double").alias("start_s"), (F.col("id") + 2.0).alias("end_s"), F.lit("high").alias("confidence"))
    assets = spark.createDataFrame([(0, True), (1, False)], "asset_id long, astats_available boolean")
    assert "Range (" not in audio.timecode_consensus(own, assets)._jdf.queryExecution().toString()
    assert "Range (" not in audio.label_channels(own.withColumn("ch", F.lit(1)))._jdf.queryExecution().toString()


def test_failures_are_found_once(spark):
    """each frame's failures were found again for the number of its asset's tags, by a filter of arrays that Spark doesn't compile."""
    own = spark.range(40).select((F.col("id") % 2).alias("asset_id"), F.col("id").alias("frame_idx"), F.col("id").cast("double").alias("t"), *[F.when(F.col("id") % (2 + k) == 0, F.lit(9.0)).alias(x) for k, x in enumerate(("A", "B", "CMIN"))])
    bad = video.threshold_violations(own, {"A": 5.0, "B": 5.0, "CMIN": 5.0})
    assert "filter(array" not in bad._jdf.queryExecution().toString()
    assert sorted((r.frame_idx, r.tag) for r in bad.collect()) == sorted([(k, "A") for k in range(0, 40, 2)] + [(k, "B") for k in range(0, 40, 3)])
    out = brng.failure_highlights(bad)
    assert sorted((r.asset_id, r.tag, r["rank"], r.frame_idx) for r in out.collect()) == [(0, "A", k + 1, 4 * k) for k in range(5)] + [(0, "B", k + 1, 6 * k) for k in range(5)] + [(1, "B", k + 1, 6 * k + 3) for k in range(5)]
    assert "Range (" not in out._jdf.queryExecution().toString()


def test_regions_are_made_once(spark):
    """what made the regions ran twice, for the width of their bins and for the join."""
    own = spark.createDataFrame([(0, k * 1.0) for k in range(10)] + [(1, 3.0)], "asset_id long, t double")
    regions = spark.range(2).select(F.lit(0).cast("long").alias("asset_id"), (4.0 * F.col("id") + 1).alias("start_s"), (4.0 * F.col("id") + 2).alias("end_s"))
    out = intervals.exclude_regions(own, regions)
    assert sorted(map(tuple, out.collect())) == [(0, t) for t in (0.0, 3.0, 4.0, 7.0, 8.0, 9.0)] + [(1, 3.0)]
    assert "Range (" not in out._jdf.queryExecution().toString()


def test_frames_are_numbered_once(spark):
    """frames were numbered anew for their regions and for the join with these."""
    for name in ("A2_bars_extremes", "A3_bars_vs_reference", "J6_exclude_regions"):
        assert "l_partkey" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString(), name


def test_runs_sort_their_frames_once(spark):
    """each frame carried its place and state twice over, and was sorted twice, its runs three times."""
    own = spark.range(60).select((F.col("id") % 2).alias("asset_id"), F.floor(F.col("id") / 2).alias("frame_idx"), (F.col("id") / 16).alias("t"), *[F.when(F.col("id") % 10 < 6, 0.0).otherwise(9.0).alias(k) for k in ("YDIF", "UDIF", "VDIF")], F.lit(900.0).alias("YMAX"), F.lit(10.0).alias("YMIN"))
    out = video.freeze_candidates(own)
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2  # frames by block, runs by asset
    assert sorted((r.asset_id, r.start_s, r.duplicates) for r in out.collect()) == [(a, (10 * k + a) / 16, 3) for a in (0, 1) for k in range(6)]
