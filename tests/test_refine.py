import random

from pyspark.sql import functions as F

from tapeqc.operators import audio, intervals, video

GOOD, BAD = (900.0, 5.0, 1.0, 400.0), (500.0, 50.0, 1.0, 50.0)
WEAK = (700.0, 15.0, 10.0, 150.0)


def _frames(spark, stretches):
    rows, k = [], 0
    for n, values in stretches:
        for _ in range(n):
            rows.append((1, k, k * 0.1, *values))
            k += 1
    return spark.createDataFrame(rows, "asset_id long, frame_idx long, t double, YMAX double, YMIN double, YDIF double, SATMAX double")


def test_guided_bars(spark):
    span = "asset_id long, start_s double, end_s double"
    own = _frames(spark, [(100, BAD), (100, GOOD), (200, BAD)])
    none = spark.createDataFrame([], span)
    found = {r.label: (round(r.start_s, 1), round(r.end_s, 1)) for r in video.detect_bars_guided(own, none, spark.createDataFrame([(1, 5.0, 15.0), (1, 14.0, 30.0)], span)).collect()}
    assert found == {"head": (10.0, 19.9), "additional-1": (10.0, 19.9)}
    own = _frames(spark, [(100, BAD), (100, WEAK), (200, BAD)])
    found = {r.label: round(r.start_s, 1) for r in video.detect_bars_guided(own, spark.createDataFrame([(1, 9.0, 21.0)], span), none).collect()}
    assert found == {"head-relaxed": 10.0}
    assert video.detect_bars_guided(own, none, none).count() == 0


def test_refined_gaps(spark):
    on = [(1, 1, k, k * 0.5, 20 <= k < 60 or 70 <= k < 100) for k in range(140)]
    own = spark.createDataFrame(on, "asset_id long, ch int, frame_idx long, t double, flag boolean")
    regions = spark.createDataFrame([(1, 1, 12.0, 25.0, "medium"), (1, 1, 36.0, 45.0, "high")], "asset_id long, ch int, start_s double, end_s double, confidence string")
    found = sorted((r.start_s, r.end_s, r.confidence) for r in audio.refine_gaps(regions, own, "flag").collect())
    assert found == [(10.0, 29.5, "high"), (35.0, 49.5, "high")]
    apart = sorted(r.confidence for r in audio.refine_gaps(regions, own, "flag", gap=5.0, margin=4.0).collect())
    assert apart == ["high", "medium"]


def test_greedy_spaced(spark):
    pick = random.Random(5)
    rows = [(a, i, float(pick.randrange(n)), pick.randrange(50)) for a, n in ((1, 900), (2, 20), (3, 5), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "asset_id long, i long, t double, score long")
    for fill in (False, True):
        want = {}
        for a in (1, 2, 3, None):
            own = sorted((-s, i, t) for b, i, t, s in rows if a == b)
            took = []
            for x in own:
                if len(took) < 5 and all(abs(x[2] - y[2]) >= 4 for y in took):
                    took.append(x)
            took += [x for x in own if x not in took][: 5 - len(took)] if fill else []
            want |= {(a, k + 1): x[1] for k, x in enumerate(took)}
        out = intervals.greedy_spaced(df, ["asset_id"], [-F.col("score"), F.col("i")], "t", 4.0, 5, fill)
        assert {(r.asset_id, r["rank"]): r.i for r in out.collect()} == want
        assert "collect_list" not in out._jdf.queryExecution().toString()
