"""Operators that SQL cannot state, or only by repeating their code, against plain Python on small series."""

import random

import numpy as np
from pyspark.sql import functions as F

from tapeqc.operators import audio, brng, intervals, similarity


def test_consensus(spark):
    assets = [(k, k % 2 == 0) for k in range(40)]
    rng, detections = random.Random(4), []
    for a, there in assets:
        for ch in (1, 2) if there else ():
            at = 0.0
            for _ in range(rng.randint(0, 4)):
                start = at + rng.randint(1, 30)
                at = start + rng.randint(5, 40)
                detections.append((a, f"astats (ch{ch})", rng.choice([f"ch{ch}", f"both (ch{ch})"]), start, at, rng.choice(["high", "medium"])))
        for name in ("R128-A (x)", "R128-B (y)"):
            at = 0.0
            for _ in range(rng.randint(0, 3)):
                start = at + rng.randint(1, 40)
                at = start + rng.randint(5, 60)
                detections.append((a, name, "one channel", start, at, rng.choice(["high", "medium"])))
    df = spark.createDataFrame([(a, c, n, float(s), float(e), x) for a, c, n, s, e, x in detections], "asset_id int, criterion string, channel string, start_s double, end_s double, confidence string")
    got = sorted(tuple(r) for r in audio.timecode_consensus(df, spark.createDataFrame(assets, "asset_id int, astats_available boolean")).collect())
    want = []
    for a, there in assets:
        own = [d for d in detections if d[0] == a]
        loud = sorted((d for d in own if d[1].startswith("R128")), key=lambda d: d[3:5])
        regions = []
        for d in sorted((d for d in own if d not in loud), key=lambda d: d[3]):
            if regions and d[3] <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], d[4])
                regions[-1][2].append(d)
            else:
                regions.append([d[3], d[4], [d]])
        meets = lambda d, r: d[3] <= r[1] and r[0] <= d[4]
        for d in loud:
            if not there and not any(meets(d, r) for r in regions):
                regions.append([d[3], d[4], []])
        for start, end, members in regions:
            near = [d for d in loud if meets(d, (start, end))]
            names = {d[1][-2] for d in members}
            both = any("both" in d[2] for d in members) or len(names) > 1
            channel = "Both channels" if both else f"Channel {names.pop()}" if names else "Not channel-specific (mix-based)"
            methods = ["R128"] * bool(near) + sorted({d[1] for d in members})
            best = "high" if any(d[5] == "high" for d in members + near) else "medium"
            want.append((a, start, end, channel, best, " + ".join(methods), len(methods)))
    assert got == sorted(want) and {w[3] for w in want} >= {"Both channels", "Channel 1", "Not channel-specific (mix-based)"}


def test_shifted_periods(spark):
    rng, periods, black, assets = random.Random(7), [], [], []
    for a in range(30):
        whole, at = rng.randint(60, 400), 0
        assets.append((a, float(whole), 12.0))
        for _ in range(rng.randint(0, 9)):
            start = at + rng.randint(0, 40)
            at = start + rng.randint(3, 50)
            black.append((a, float(start), float(at)))
        periods += [(a, k, float(rng.randint(0, max(1, whole - 40))), 20.0) for k in range(4)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = brng.shift_periods(frame(periods, "asset_id int, period_no int, start_s double, duration_s double"), frame(black, "asset_id int, start_s double, end_s double"), frame(assets, "asset_id int, duration_s double, first_s double"))
    want, dropped, moved = [], 0, 0
    for a, whole, first in assets:
        dark = [(s, e) for b, s, e in black if b == a]
        covered = lambda s: sum(max(0.0, min(s + 20, e) - max(s, b)) for b, e in dark)
        used = []
        for _, k, start, length in (p for p in periods if p[0] == a):
            if covered(start) / length > 0.25:
                places = [start + sign * off for off in np.arange(5.0, whole * 0.5, 5.0) for sign in (1, -1)]
                places = [p for p in places if first <= p and p + length <= whole - 10 and covered(p) / length <= 0.1 and all(abs(p - u) >= length for u in used)]
                if not places:
                    dropped += 1
                    continue
                start, moved = places[0], moved + 1
            used.append(start)
            want.append((a, k, start, length))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and dropped and moved


def test_settled_periods(spark):
    rng, periods, candidates, black, assets, want, moved, dropped = random.Random(11), [], [], [], [], [], 0, 0
    for a in range(40):
        whole = rng.randint(150, 400)
        assets.append((a, float(whole), 12.0))
        dark, at = [], 0
        for _ in range(rng.randint(0, 9)):
            start = at + rng.randint(0, 30)
            at = start + rng.randint(3, 40)
            dark.append((float(start), float(at)))
        black += [(a, *x) for x in dark]
        own = [(a, k, float(15 + 45 * k), 20.0, rng.choice(["content_violations", "border_violations", "minimal", "minimal"]), float(rng.randint(0, 8))) for k in range(3)]
        mine = [(a, k, float(rng.randint(0, whole)), 20.0) for k in range(6)]
        periods += own
        candidates += mine
        low = [p for p in own if {"content_violations": 100, "border_violations": 50}.get(p[4], 0) + p[5] < 5]
        free = [c for c in mine if all(c[2] + c[3] < p[2] or c[2] > p[2] + p[3] for p in own)]
        new = {p[1]: p[2] for p in own}
        for p, c in zip(low, free, strict=False):
            new[p[1]] = c[2]
        if not low or not free:
            want += [(a, k, s, 20.0) for k, s in new.items()]
            continue
        covered = lambda s: sum(max(0.0, min(s + 20, e) - max(s, b)) for b, e in dark)  # noqa: B023, E731
        used = []
        for k, start in sorted(new.items()):
            if covered(start) / 20 > 0.25:
                places = [start + sign * off for off in np.arange(5.0, whole * 0.5, 5.0) for sign in (1, -1)]
                places = [p for p in places if p >= 12 and p + 20 <= whole - 10 and covered(p) / 20 <= 0.1 and all(abs(p - u) >= 20 for u in used)]
                if not places:
                    dropped += 1
                    continue
                start, moved = places[0], moved + 1
            used.append(start)
            want.append((a, k, start, 20.0))
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = brng.settle_periods(frame(periods, "asset_id int, period_no int, start_s double, duration_s double, verdict string, active_pct double"), frame(candidates, "asset_id int, rank int, start_s double, duration_s double"), frame(black, "asset_id int, start_s double, end_s double"), frame(assets, "asset_id int, duration_s double, first_s double"))
    assert sorted(tuple(r) for r in got.select("asset_id", "period_no", "start_s", "duration_s").collect()) == sorted(want) and moved > 5 and dropped


def test_spaced_choices(spark):
    rng = random.Random(3)
    rows = [(a, k, float(rng.randint(0, 300)), float(rng.randint(0, 9)), rng.choice(["content", "border", "other"])) for a in range(6) for k in range(60)]
    df = spark.createDataFrame(rows, "asset_id int, frame_idx int, t double, score double, kind string")
    for touching in (False, True):
        got = {(r.asset_id, r["rank"]): r.frame_idx for r in intervals.greedy_spaced(df, ["asset_id"], [-F.col("score"), F.col("frame_idx")], "t", 20.0, 4, touching=touching).collect()}
        want = {}
        for a in range(6):
            chosen = []
            for r in sorted((r for r in rows if r[0] == a), key=lambda r: (-r[3], r[1])):
                if len(chosen) < 4 and all(abs(r[2] - c[2]) > 20 or not touching and abs(r[2] - c[2]) == 20 for c in chosen):
                    chosen.append(r)
            want |= {(a, k + 1): r[1] for k, r in enumerate(chosen)}
        assert got == want
    got = {(r.asset_id, r["rank"]): r.frame_idx for r in brng.diverse_top_k(df).collect()}
    place = {"content": 0, "other": 1, "border": 2}
    want = {}
    for a in range(6):
        order = sorted((r for r in rows if r[0] == a), key=lambda r: (place[r[4]], -r[3], r[1]))
        chosen = []
        for r in order:
            if len(chosen) < 5 and all(abs(r[2] - c[2]) >= 10 for c in chosen):
                chosen.append(r)
        chosen += [r for r in order if r not in chosen][: 5 - len(chosen)]
        want |= {(a, k + 1): r[1] for k, r in enumerate(chosen)}
    assert got == want
    periods = {(r.asset_id, r["rank"]): r.start_s for r in brng.suggest_periods(df.select("asset_id", "t"), 3, 20.0).collect()}
    for a in range(6):
        own = [r[2] for r in rows if r[0] == a]
        bins = {}
        for t in own:
            bins[min(own) + (t - min(own)) // 10 * 10] = bins.get(min(own) + (t - min(own)) // 10 * 10, 0) + 1
        chosen = []
        for at in sorted(bins, key=lambda at: (-bins[at], at)):
            if len(chosen) < 3 and all(at + 20 < c or at > c + 20 for c in chosen):
                chosen.append(at)
        assert [periods.get((a, k + 1)) for k in range(3)] == [*chosen, None, None, None][:3]


def test_highlights(spark):
    rng = random.Random(5)
    rows = [(a, k, float(rng.randint(0, 90)), rng.choice("YUVS"[: a + 1]), float(rng.randint(0, 50)), 25.0) for a in range(4) for k in range(50)]
    df = spark.createDataFrame(rows, "asset_id int, frame_idx int, t double, tag string, value double, threshold double")
    got = {(r.asset_id, r.tag, r["rank"]): r.frame_idx for r in brng.failure_highlights(df).collect()}
    want = {}
    for a in range(4):
        tags = {r[3] for r in rows if r[0] == a}
        for tag in tags:
            chosen = []
            for r in sorted((r for r in rows if r[0] == a and r[3] == tag), key=lambda r: (-abs(r[4] - 25), r[1])):
                if len(chosen) < (5 if len(tags) <= 2 else 3) and all(abs(r[2] - c[2]) >= 4 for c in chosen):
                    chosen.append(r)
            want |= {(a, tag, k + 1): r[1] for k, r in enumerate(chosen)}
    assert got == want


def test_spikes(spark):
    rng = np.random.default_rng(2)
    series = {0: rng.normal(0, 1, 400), 1: np.zeros(300), 2: np.full(90, 5.0), 3: rng.normal(0, 1, 1600), 4: np.array([1.0])}
    series[1][[40, 41, 100, 101, 102, 200]] = 9
    for k in range(0, 400, 57):
        series[0][k] += 25
    series[3][800:845] += 12
    rows = [(a, k, float(x)) for a, xs in series.items() for k, x in enumerate(xs)]
    got = sorted((r.asset_id, r.first_idx, r.last_idx, round(r.peak, 9)) for r in audio.spike_detection(spark.createDataFrame(rows, "asset_id int, frame_idx int, value double")).collect())
    want = []
    for a, xs in series.items():
        w = max(51, len(xs) // 20)
        w += w % 2 == 0
        padded = np.pad(xs, w // 2, mode="edge")
        dev = xs - np.array([np.median(padded[k : k + w]) for k in range(len(xs))])
        least = np.median(np.abs(dev)) or np.std(dev)
        hits = np.flatnonzero(dev > 3 * least) if least else []
        groups = []
        for k in hits:
            if groups and k - groups[-1][-1] <= 2:
                groups[-1].append(k)
            else:
                groups.append([k])
        want += [(a, int(g[0]), int(g[-1]), round(float(dev[g].max()), 9)) for g in groups if len(g) <= 2]
    assert got == sorted(want) and any(a == 1 for a, *_ in got)


def test_ssim_runs(spark):
    scores = {0: "0110111100", 1: "1111", 2: "0100111110", 3: "0000"}
    rows = [(a, 30 * k, 0.9 if c == "1" else 0.1) for a, s in scores.items() for k, c in enumerate(s)]
    df = spark.createDataFrame(rows, "asset_id int, frame_idx int, score double")
    assert sorted(map(tuple, similarity.ssim_runs(df, least=30).collect())) == [(0, 30, 90)]
    assert sorted(map(tuple, similarity.ssim_runs(df, least=30, all_runs=True).collect())) == [(0, 30, 90), (0, 120, 240), (2, 120, 270)]


def test_ssim_of_known_pictures(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 255, (16, 16))
    rows = [(1, 0, a.ravel().tolist()), (1, 1, (a * 0 + a.mean()).ravel().tolist()), (1, 2, (255 - a).ravel().tolist())]
    got = {r.frame_idx: r.score for r in similarity.ssim_to_reference(spark.createDataFrame(rows, "asset_id int, frame_idx int, luma array<double>"), a.ravel().tolist(), 16, 16).collect()}
    assert abs(got[0] - 1) < 1e-12 and got[2] < 0 < got[0] and abs(got[1]) < 0.1


def test_targeted_samples(spark):
    segments = [(1, 0, 10.0, 20.0, 240, 24.0), (1, 1, 40.0, 50.0, 240, 24.0), (2, 0, 0.0, 5.0, 120, 24.0)]
    violations = [(1, k, 10 + k * 0.25, float(k % 7)) for k in range(60)]
    got = {}
    for r in brng.sample_targeted(spark.createDataFrame(segments, "asset_id int, period_no int, start_s double, end_s double, total_frames int, fps double"), spark.createDataFrame(violations, "asset_id int, frame_idx int, t double, score double"), 50, 20, 10, 15).collect():
        got.setdefault((r.asset_id, r.period_no), []).append(r.frame_no)
    worst = sorted(violations, key=lambda v: (-v[3], v[1]))[:50]
    for a, p, start, end, total, fps in segments:
        hits = sorted({int((v[2] - start) * fps) for v in worst if v[0] == a and start <= v[2] < end})
        if a == 2:
            want = sorted(set(np.linspace(0, total - 1, 15, dtype=int).tolist()))
        elif len(hits) < 20:
            want = sorted({*hits, *np.linspace(0, total - 1, 10, dtype=int).tolist()})[:15]
        else:
            want = hits
        assert sorted(got[a, p]) == want


def test_repeated_points_stay(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 50.0), (2, 5.0)], "asset_id int, t double")
    periods = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 0, 4.0, 10.0)], "asset_id int, period_no int, start_s double, duration_s double")
    assert sorted(map(str, intervals.assign_period(points, periods).collect())) == sorted(f"Row(asset_id={a}, t={t}, period_no={p})" for a, t, p in ((1, 5.0, 0), (1, 5.0, 0), (1, 50.0, None), (2, 5.0, None)))


def test_dropout_events(spark):
    rows = [(1, 1, 0.0, -90.0, -20.0, ["Max_difference"]), (1, 1, 3.0, -95.0, -21.0, ["RMS_difference"]), (1, 1, 20.0, -80.0, -20.0, ["Zero_crossings_rate"]), (1, 2, 20.4, -85.0, -20.0, ["Max_difference"]), (1, 1, 40.0, -80.0, -20.0, ["Zero_crossings_rate"]), (1, 2, 60.0, -80.0, -20.0, []), (1, 2, 63.0, -80.0, -20.0, ["Max_difference"])]
    df = spark.createDataFrame(rows, "asset_id int, ch int, t double, rms_level double, median_rms double, corroborating array<string>")
    got = {(r.ch, r.start_s, r.end_s): (r.worst_rms, r.median_rms, r.confidence) for r in audio.dropout_events(df).collect()}
    # The long event of one metric at 60 leaves, and so does the one at 40 that zero crossings alone support.
    assert got == {(1, 0.0, 3.0): (-95.0, -20.0, "high"), (1, 20.0, 20.0): (-80.0, -20.0, "medium"), (2, 20.4, 20.4): (-85.0, -20.0, "medium")}


def test_tone_spans(spark):
    tone, other = [1.0, 1.0], [0.0, 0.0]
    rows = [(1, k, tone if 2 <= k < 12 or k >= 20 else other) for k in range(24)]
    got = [tuple(r) for r in audio.tone_spans(spark.createDataFrame(rows, "asset_id int, chunk_no int, samples array<double>")).collect()]
    assert got == [(1, 500.0, 3000.0)]


def test_subregions(spark):
    rng, rows = random.Random(8), []
    for a in range(8):
        on, k = True, 0
        while k < 160:
            n = rng.choice([1, 2, 4, 9, 15, 30])
            rows += [(a, 1, k + i, (k + i) * 0.5, on if rng.random() > 0.03 else not on) for i in range(n)]
            on, k = not on, k + n
    got = sorted((r.asset_id, r.start_s, r.end_s) for r in audio.tc_subregions(spark.createDataFrame(rows, "asset_id int, ch int, frame_idx int, t double, flag boolean"), "flag").collect())
    want = []
    for a in range(8):
        seg = [(r[3], r[4]) for r in rows if r[0] == a]
        smooth = [sum(f for _, f in seg[max(0, k - 3) : k + 4]) > len(seg[max(0, k - 3) : k + 4]) / 2 for k in range(len(seg))]
        gaps = []
        for k, (t, _) in enumerate(seg):
            if not smooth[k]:
                if gaps and k and not smooth[k - 1] or gaps and t - gaps[-1][1] < 1.0:
                    gaps[-1][1] = t
                else:
                    gaps.append([t, t])
        bounds = [seg[0][0], *(t for g in gaps if g[1] - g[0] >= 2.0 for t in g), seg[-1][0]]
        for lo, hi in zip(bounds[::2], bounds[1::2], strict=True):
            times = [t for t, f in seg if lo <= t <= hi and f]
            if times and times[-1] - times[0] >= 2.0:
                want.append((a, times[0], times[-1]))
    assert got == want
