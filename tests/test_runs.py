"""Runs, range joins and running medians where one asset holds most rows, beside plain Python."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeqc.operators import intervals, medians, similarity, video
from tapeqc.operators.runs import near_rows, runs


@pytest.mark.parametrize("width", [1, 3, 7, 8192])
def test_runs(spark, width):
    rng = np.random.default_rng(width)
    rows = [(a, int(k), None if x == 3 else int(x), float(k)) for a, n in ((0, 600), (1, 40), (2, 1)) for k, x in zip(np.cumsum(rng.integers(1, 4, n)), np.repeat(rng.integers(0, 4, n), rng.integers(1, 9, n))[:n], strict=True)]
    df = spark.createDataFrame(rows, "asset_id int, k long, x int, t double").repartition(5)
    got = sorted(map(tuple, runs(df, ["asset_id"], "k", F.col("x"), {"x": (F.max("x"), F.max), "n": (F.count("*"), F.sum), "t": (F.sum("t"), F.sum)}, width=width).collect()))
    want = []
    for a, k, x, t in rows:
        if want and want[-1][0] == a and want[-1][3] == x:
            want[-1] = (a, want[-1][1], k, x, want[-1][4] + 1, want[-1][5] + t)
        else:
            want.append((a, k, k, x, 1, t))
    assert got == sorted(want)
    near = runs(df, ["asset_id"], "k", F.lit(0), {"n": (F.count("*"), F.sum)}, lambda before, now: now["first"] - before["last"] <= 2, width=width)
    groups = []
    for a, k, *_ in rows:
        if groups and groups[-1][0] == a and k - groups[-1][2] <= 2:
            groups[-1] = (a, groups[-1][1], k, groups[-1][3] + 1)
        else:
            groups.append((a, k, k, 1))
    assert sorted(map(tuple, near.collect())) == sorted(groups)


@pytest.mark.parametrize("width", [1, 4, 9, 8192])
def test_near_rows(spark, width):
    rng = np.random.default_rng(width)
    rows = [(a, int(k), int(x)) for a, n in ((0, 500), (1, 7), (2, 1)) for k, x in zip(np.cumsum(rng.integers(1, 3, n)), rng.integers(0, 9, n), strict=True)]
    df = spark.createDataFrame(rows, "asset_id int, k long, x int").repartition(4)
    got = near_rows(df, ["asset_id"], "k", {"sum": lambda w: F.sum("x").over(w.rowsBetween(-3, 2)), "prev": lambda w: F.lag("x", 3).over(w)}, 3, width=width)
    want = []
    for a in range(3):
        own = [r for r in rows if r[0] == a]
        want += [(*r, sum(x for _, _, x in own[max(0, i - 3) : i + 3]), own[i - 3][2] if i >= 3 else None) for i, r in enumerate(own)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_black_segments_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    dark, n = np.repeat(rng.integers(0, 2, 500), rng.integers(1, 60, 500)), 12_000
    times = np.cumsum(rng.choice([0.05, 0.1, 0.7], n, p=[0.6, 0.38, 0.02])).round(3)
    rows = [(0, k, float(times[k]), *((200.0, 60.0, 40.0, 2.0) if dark[k] else (900.0, 500.0, 200.0, 50.0))) for k in range(n)]
    rows += [(a, k, k * 0.1, 200.0, 60.0, 40.0, 2.0) for a in range(1, 4) for k in range(30)]
    df = spark.createDataFrame(rows, "asset_id int, frame_idx long, t double, YMAX double, YHIGH double, YLOW double, YMIN double")
    want = []
    for a in range(4):
        own, start, last, count = [r for r in rows if r[0] == a], None, None, 0
        for r in [*own, None]:
            black = r is not None and r[3] < 300
            if start is not None and (r is None or not black and r[2] - last > 0.5):
                if last - start >= 2.0:
                    want.append((a, start, last, count))
                start, count = None, 0
            if black:
                start, last, count = r[2] if start is None else start, r[2], count + 1
    for width in (50, 8192):
        monkeypatch.setattr(video.runs, "__defaults__", (None, width))
        assert sorted(map(tuple, video.black_segments(df).collect())) == sorted(want) and len(want) > 20


def test_freezes_leave_out_regions_and_count_missing_metrics(spark):
    frame = lambda k, **x: {"asset_id": 1, "frame_idx": k, "t": k / 10, "YDIF": 0.5, "UDIF": 0.1, "VDIF": 0.1, "YMIN": 10.0, "YMAX": 200.0, "VREP": 2.0} | x
    rows = [frame(k, YDIF=0.5 if k % 30 < 20 else 9.0) for k in range(120)]
    rows[5]["UDIF"] = None  # a difference that is missing is large
    rows[35]["YMAX"] = None  # a level that is missing is not flat
    rows[40]["t"] = None  # passed over
    rows[70]["YMAX"] = 12.0  # flat
    rows[71]["VREP"] = None
    df = spark.createDataFrame(rows, "asset_id int, frame_idx long, t double, YDIF double, UDIF double, VDIF double, YMIN double, YMAX double, VREP double")
    out = spark.createDataFrame([(1, 9.2, 9.5), (2, 0.0, 99.0)], "asset_id int, start_s double, end_s double")
    got = sorted((r.start_s, r.end_s, r.duplicates, r.frozen, r.avg_vrep) for r in video.freeze_candidates(df, excluded=out).collect())
    assert got == [(0.0, 0.4, 5, 6, 2.0), (0.6, 1.9, 14, 15, 2.0), (3.0, 4.9, 19, 20, 2.0), (6.0, 6.9, 10, 11, 2.0), (7.1, 7.9, 9, 10, round(16 / 9, 6)), (9.0, 9.1, 2, 3, 2.0), (9.6, 10.9, 14, 15, 2.0)]


def regions(rng, n, longest=5.0):
    starts = rng.uniform(0, 20_000, n).round(2)
    return [(0, f"r{k}", float(s), float(round(s + d, 2))) for k, (s, d) in enumerate(zip(starts, rng.uniform(0, longest, n), strict=True))]


def test_range_joins(spark):
    rng = np.random.default_rng(5)
    spans = [*regions(rng, 300), (0, "long", 10.0, 19_000.0), (0, "point", 500.0, 500.0), (1, "other", 0.0, 1e6), (0, "back", 9.0, 3.0), (0, "none", None, 4.0), (0, "open", 0.0, float("inf"))]
    points = [(0, float(t)) for t in rng.uniform(0, 20_000, 2000).round(2)] + [(0, 500.0), (0, 500.0), (2, 5.0), (0, None)]
    r = spark.createDataFrame(spans, "asset_id int, label string, start_s double, end_s double")
    p = spark.createDataFrame(points, "asset_id int, t double")
    hits = lambda a, t: [x for x in spans if x[0] == a and t is not None and x[2] is not None and x[3] != float("inf") and x[2] <= t <= x[3]]
    got = sorted((x.asset_id, x.t, x.label) for x in intervals.with_regions(p, r).select("asset_id", "t", "_region.label").collect())
    assert got == sorted((a, t, x[1]) for a, t in points for x in hits(a, t))
    key = lambda x: (x[0], x[1] is not None, x[1] or 0)
    assert sorted(map(tuple, intervals.exclude_regions(p, r).collect()), key=key) == sorted(((a, t) for a, t in points if not hits(a, t)), key=key)
    near = intervals.near_regions(p, r, "n", lambda held: F.coalesce(F.size(held), F.lit(0)))
    assert sorted(map(tuple, near.collect()), key=key) == sorted(((a, t, len(hits(a, t))) for a, t in points), key=key)


@pytest.mark.parametrize("inside", [True, False])
def test_overlaps(spark, inside):
    rng = np.random.default_rng(8)
    left, right = regions(rng, 200, 300.0), [(0, x[1], x[2], x[3]) for x in regions(rng, 40, 60.0)]
    left += [left[0], (0, "edge", right[0][3], right[0][3] + 1), (9, "alone", 0.0, 1.0), (0, "null", None, None)]
    schema = "asset_id int, label string, start_s double, end_s double"
    got = intervals.spans_overlap(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.25, inside=inside).collect()
    met = lambda x: x[2] is not None and any(x[0] == y[0] and x[2] <= y[3] + 0.25 and y[2] - 0.25 <= x[3] for y in right)
    assert sorted(map(str, map(tuple, got))) == sorted(str(x) for x in left if met(x) == inside)


def test_pairs_examined_are_near_the_pairs_found(spark):
    rng = np.random.default_rng(3)
    r = spark.createDataFrame(regions(rng, 10_000), "asset_id int, label string, start_s double, end_s double")
    points = spark.range(20_000).select(F.lit(0).alias("asset_id"), (F.col("id") * 1.0).alias("t"))
    _, binned = intervals._binned(r, ["asset_id"], F.col("end_s"))
    assert binned.count() <= 3 * 10_000
    found = intervals.with_regions(points, r).count()
    width = r.agg(F.avg(F.col("end_s") - F.col("start_s"))).first()[0]
    met = points.withColumn("_bin", F.floor(F.col("t") / width)).join(binned, ["asset_id", "_bin"]).count()
    assert found <= met <= 2.5 * found


def test_running_medians(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for n, w in ((1, 1), (2, 5), (999, 51)):
        x = rng.integers(0, 50, n).astype(float)
        low, high = np.maximum(0, np.arange(n) - w // 2), np.minimum(n, np.arange(n) + w // 2 + 1)
        assert medians.sliding_medians(x, low, high).tolist() == [float(np.median(x[i:j])) for i, j in zip(low, high, strict=True)]
    monkeypatch.setattr(medians, "BLOCK", 64)
    series = {0: rng.normal(0, 1, 3000), 1: rng.normal(0, 1, 40), 2: np.array([7.0])}
    rows = [(a, 3 * k, None if a == 0 and k % 11 == 5 else float(x)) for a, xs in series.items() for k, x in enumerate(xs)]
    got = {(r.asset_id, r._place): r.m for r in medians.running_median(spark.createDataFrame(rows, "asset_id int, frame_idx long, value double"), "value", 51, 20, "m").collect()}
    for a in series:
        xs = np.array([np.nan if r[2] is None else r[2] for r in rows if r[0] == a])
        half = max(51, len(xs) // 20) // 2
        padded = np.pad(xs, half, mode="edge")
        assert [got[a, k] for k in range(len(xs))] == [float(np.nanmedian(padded[k : k + 2 * half + 1])) for k in range(len(xs))]


def test_many_medians_in_time():
    x = np.random.default_rng(0).normal(0, 1, 100_000)
    began = time.time()
    place = np.arange(len(x))
    medians.sliding_medians(x, np.maximum(0, place - 2500), np.minimum(len(x), place + 2501))
    assert time.time() - began < 5


def test_similarity_of_batches():
    def plain(x, y, span, box=7):
        view = lambda a: np.lib.stride_tricks.sliding_window_view(a, (box, box)).reshape(-1, box * box)
        a, b = view(x), view(y)
        c1, c2, ma, mb = (0.01 * span) ** 2, (0.03 * span) ** 2, view(x).mean(axis=1), view(y).mean(axis=1)
        cov = ((a - ma[:, None]) * (b - mb[:, None])).sum(axis=1) / (box * box - 1)
        return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (a.var(axis=1, ddof=1) + b.var(axis=1, ddof=1) + c2))).mean())

    rng = np.random.default_rng(1)
    pictures, reference = rng.uniform(0, 255, (40, 48, 64)), rng.uniform(0, 255, (48, 64))
    pictures[3], pictures[4] = reference, 17.0
    began = time.time()
    want = [plain(p, reference, 255.0) for p in pictures]
    middle = time.time()
    got = similarity.ssim(pictures, reference, 255.0)
    assert np.abs(got - want).max() < 1e-9 and time.time() - middle < (middle - began) / 2
