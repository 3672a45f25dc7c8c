"""Video checks over wide frames (asset_id, frame_idx, t, one double column for each metric)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LUMA_ZONES, luma_zone
from .intervals import ASSET, merge_spans, near_regions, with_regions
from .runs import runs


#: Extreme values of SMPTE bars in 10 bits.
SMPTE = {"YMAX": 940.0, "YMIN": 28.0, "UMIN": 148.0, "UMAX": 876.0, "VMIN": 124.0, "VMAX": 867.0, "SATMIN": 0.0, "SATMAX": 405.0}


def fails(metric: Column, value: Column, threshold: Column) -> Column:
    """MIN and LOW metrics fail below their threshold, others above it."""
    return F.when(metric.contains("MIN") | metric.contains("LOW"), value < threshold).otherwise(value > threshold)


def threshold_violations(frames: DataFrame, thresholds: dict[str, float], start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """asset_id, frame_idx, t, tag, value, threshold: a row for each metric of a frame that fails, in one pass over the wide frames."""
    if start_s is not None:
        frames = frames.where(F.col("t") >= start_s)
    if end_s is not None:
        frames = frames.where(F.col("t") <= end_s)
    # Plain conditions, which Spark compiles; a filter of arrays is interpreted for each row.
    items = F.array(*[F.when(fails(F.lit(k), F.col(k), F.lit(float(v))), F.struct(F.lit(k).alias("tag"), F.col(k).alias("value"), F.lit(float(v)).alias("threshold"))) for k, v in thresholds.items()])
    return frames.select("asset_id", "frame_idx", "t", F.explode(items).alias("x")).where("x IS NOT NULL").select("asset_id", "frame_idx", "t", "x.*")


def thresholds_by_asset(assets: DataFrame, checks: DataFrame) -> DataFrame:
    """asset_id, limits: the thresholds of each asset's profile as one map; assets (asset_id, profile), checks (profile, tag, threshold). A profile without thresholds checks nothing."""
    maps = checks.where("threshold IS NOT NULL").groupBy("profile").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.col("threshold").cast("double")))).alias("limits"))
    return assets.join(maps, "profile", "left").select("asset_id", F.coalesce("limits", F.create_map().cast("map<string, double>")).alias("limits"))


def _by_limits(frames: DataFrame, limits: DataFrame) -> tuple[DataFrame, list[str], Callable[[str], Column]]:
    """frames with their asset's limits, the metrics that frames have, and whether a metric fails its asset's limit."""
    metrics = [c for c, t in frames.dtypes if t == "double" and c != "t"]
    limit = lambda k: F.try_element_at("limits", F.lit(k))
    return frames.join(limits, "asset_id"), metrics, lambda k: F.coalesce(fails(F.lit(k), F.col(k), limit(k)), F.lit(False))


def profile_violations(frames: DataFrame, limits: DataFrame) -> DataFrame:
    """threshold_violations with the thresholds of each asset's own profile (limits: asset_id, limits), over the wide frames as they are."""
    wide, metrics, bad = _by_limits(frames, limits)
    items = F.array(*[F.when(bad(k), F.struct(F.lit(k).alias("tag"), F.col(k).alias("value"), F.try_element_at("limits", F.lit(k)).alias("threshold"))) for k in metrics])
    return wide.select("asset_id", "frame_idx", "t", F.explode(F.array_compact(items)).alias("x")).select("asset_id", "frame_idx", "t", "x.*")


def profile_summary(frames: DataFrame, limits: DataFrame) -> DataFrame:
    """threshold_summary with the thresholds of each asset's own profile: a row for each metric that the profile has, in one aggregation."""
    wide, metrics, bad = _by_limits(frames, limits)
    one = wide.groupBy("asset_id").agg(F.count("*").alias("total"), F.count_if(reduce(lambda a, b: a | b, map(bad, metrics))).alias("any_failed"), F.first("limits").alias("limits"), *[F.count_if(bad(k)).alias(k) for k in metrics])
    items = F.array_compact(F.array(*[F.when(F.map_contains_key("limits", k), F.struct(F.lit(k).alias("tag"), F.col(k).alias("failed"))) for k in metrics]))
    long = one.select("asset_id", "total", "any_failed", F.explode(items).alias("x"))
    return long.select("asset_id", "x.tag", "x.failed", F.round(100.0 * F.col("x.failed") / F.col("total"), 6).alias("pct"), "any_failed", "total")


def threshold_summary(frames: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """asset_id, tag, failed, pct, any_failed, total: one aggregation with a count for each metric, unpivoted; no shuffle beyond the asset."""
    bad = {k: F.coalesce(fails(F.lit(k), F.col(k), F.lit(float(v))), F.lit(False)) for k, v in thresholds.items()}
    one = frames.groupBy("asset_id").agg(F.count("*").alias("total"), F.count_if(reduce(lambda a, b: a | b, bad.values())).alias("any_failed"), *[F.count_if(x).alias(k) for k, x in bad.items()])
    long = one.select("asset_id", "total", "any_failed", F.explode(F.array(*[F.struct(F.lit(k).alias("tag"), F.col(k).alias("failed")) for k in bad])).alias("x"))
    return long.select("asset_id", "x.tag", "x.failed", F.round(100.0 * F.col("x.failed") / F.col("total"), 6).alias("pct"), "any_failed", "total")


# Levels of black frames, bars, chroma errors and frames that hardly differ, by bit depth where they depend on it.
BLACK = {"ymax": 300, "yhigh": 115, "ylow": 97, "ymin": 6.5}
BARS = {10: (800, 10, 8, 250), 8: (210, 10, 3, 100)}
RELAXED = (0.75, 2, 2, 0.4)
CHROMA = {"low": 100, "high": 900, "saturation": 600}
FREEZE = {10: (1.0, 8.0), 8: (0.25, 2.0)}
CLAMPED = {"tolerance": 1.0, "hits": 10, "pct": 1.0}


def is_black(ymax: float = BLACK["ymax"], yhigh: float = BLACK["yhigh"], ylow: float = BLACK["ylow"], ymin: float = BLACK["ymin"]) -> Column:
    return F.coalesce((F.col("YMAX") < ymax) & (F.col("YHIGH") < yhigh) & (F.col("YLOW") < ylow) & (F.col("YMIN") < ymin), F.lit(False))


def bars_frame(bit_depth: int = 10, relaxed: bool = False) -> Column:
    ymax, ymin, ydif, sat = (x * (y if relaxed else 1) for x, y in zip(BARS[bit_depth], RELAXED, strict=True))
    return F.coalesce((F.col("YMAX") > ymax) & (F.col("YMIN") < ymin) & (F.col("YDIF") < ydif) & (F.col("SATMAX") > sat), F.lit(False))


# What a frame of bars stays over or under when a whole video is tested, by bit depth.
WHOLE_BARS = {
    10: {"TOUT": 0.020, "YMAX": 800, "YMIN": 10, "YDIF": 25, "SATMAX": 300, "UMAX": 1020, "UDIF": 20, "VMAX": 970, "VDIF": 15},
    8: {"TOUT": 0.020, "YMAX": 199, "YMIN": 3, "YDIF": 2, "SATMAX": 75, "UMAX": 255, "UDIF": 5, "VMAX": 243, "VDIF": 4},
}


def whole_bars_frame(bit_depth: int = 10) -> Column:
    """Whether a frame meets all nine criteria; a metric that is missing fails."""
    k, out = WHOLE_BARS[bit_depth], F.lit(True)
    for c, limit in k.items():
        out = out & (F.col(c) <= limit if c == "TOUT" else F.col(c) > limit if c in ("YMAX", "SATMAX") else F.col(c) < limit)
    return F.coalesce(out, F.lit(False))


def whole_video_bars(frames: DataFrame, share: float = 0.95, bit_depth: int = 10) -> DataFrame:
    """asset_id, end_s: assets of which at least `share` of the frames are bars by all nine criteria."""
    met = F.count_if(whole_bars_frame(bit_depth)) * 1.0 / F.count("*")
    return frames.groupBy("asset_id").agg(met.alias("x"), F.max("t").alias("end_s")).where(F.col("x") >= share).select("asset_id", "end_s")


def detect_bars(frames: DataFrame, min_run: int | None = None, max_misses: int | None = None, relaxed: bool = False, start_s: float = 0.0, end_s: float = 300.0, min_s: float = 2.0, bit_depth: int = 10) -> DataFrame:
    """asset_id, start_s, end_s (last frame that passes), closed_s (the frame that ended them; null if none did): the head bars.

    Start: the first frame of the first run of `min_run` frames that pass. End: before the first `max_misses` misses in a row that follow once
    the bars last longer than `min_s`.
    """
    min_run, max_misses = min_run or (10 if relaxed else 30), max_misses or (30 if relaxed else 15)
    own = frames.where(F.col("t").between(start_s, end_s)).select("asset_id", "frame_idx", "t", bars_frame(bit_depth, relaxed).alias("ok"))
    totals = {"ok": (F.bool_or("ok"), F.bool_or), "n": (F.count("*"), F.sum), "first_s": (F.min("t"), F.min), "last_s": (F.max("t"), F.max)}
    found = runs(own, ASSET, "frame_idx", F.col("ok"), totals)
    # All from the runs, which stay where their asset's frames are: no frame is read twice.
    whole = Window.partitionBy("asset_id")
    found = found.withColumn("start_s", F.min(F.when(F.col("ok") & (F.col("n") >= min_run), F.col("first_s"))).over(whole))
    ended = ~F.col("ok") & (F.col("n") >= max_misses) & (F.col("first_s") - F.col("start_s") > min_s)
    found = found.withColumn("closed_s", F.min(F.when(ended, F.col("first_s"))).over(whole))
    inside = F.col("ok") & (F.col("first_s") >= F.col("start_s")) & (F.col("closed_s").isNull() | (F.col("first_s") < F.col("closed_s")))
    return found.where(inside).groupBy("asset_id", "start_s", "closed_s").agg(F.max("last_s").alias("end_s")).select("asset_id", "start_s", "end_s", "closed_s")


def bars_extremes(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """asset_id, label, and each of eight extremes, truncated, over the frames of each region."""
    wide = with_regions(frames, regions.select("asset_id", "label", "start_s", "end_s"))
    extreme = [(F.greatest(F.lit(0), F.max(k).cast("int")) if k.endswith("MAX") else F.least(F.lit(1023), F.min(k).cast("int"))).alias(k) for k in SMPTE if k in frames.columns]
    return wide.groupBy("asset_id", F.col("_region.label").alias("label")).agg(*extreme)


def bars_vs_reference(assets: DataFrame, extremes: DataFrame) -> DataFrame:
    """asset_id, tag, expected, detected: SMPTE values stand in where an asset has no bars."""
    keys = [k for k in SMPTE if k in extremes.columns]
    wide = assets.select("asset_id").join(extremes.drop("label"), "asset_id", "left")
    items = F.array(*[F.struct(F.lit(k).alias("tag"), F.lit(SMPTE[k]).alias("expected"), F.coalesce(F.col(k).cast("double"), F.lit(SMPTE[k])).alias("detected")) for k in keys])
    return wide.select("asset_id", F.explode(items).alias("x")).select("asset_id", "x.*")


def clamped_levels(frames: DataFrame, limits: dict[str, tuple[float, str]], tolerance: float = CLAMPED["tolerance"], hits: int = CLAMPED["hits"], pct: float = CLAMPED["pct"]) -> DataFrame:
    """asset_id, metric, extreme, hits, hit_pct, beyond, verdict for each limit {metric: (level, 'floor' or 'ceiling')}, in one pass."""
    aggs = [F.count("*").alias("total")]
    for k, (level, side) in limits.items():
        c = F.col(k)
        aggs += [(F.min(c) if side == "floor" else F.max(c)).alias(f"{k}_x"), F.count_if(F.abs(c - level) <= tolerance).alias(f"{k}_h"), F.count_if(c < level - tolerance if side == "floor" else c > level + tolerance).alias(f"{k}_b")]
    one = frames.groupBy("asset_id").agg(*aggs)
    items = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}_x").alias("extreme"), F.col(f"{k}_h").alias("hits"), F.col(f"{k}_b").alias("beyond")) for k in limits])
    long = one.select("asset_id", "total", F.explode(items).alias("x")).select("asset_id", "total", "x.*")
    share = F.col("hits") * 100.0 / F.col("total")
    verdict = F.when(F.col("beyond") > 0, "Not Clamped").when((F.col("hits") >= hits) & (share >= pct), "Clamped").otherwise("Inconclusive")
    return long.select("asset_id", "metric", "extreme", "hits", F.round(share, 6).alias("hit_pct"), "beyond", verdict.alias("verdict"))


def bit_depth(frames: DataFrame) -> DataFrame:
    """asset_id, bits: 10 if the first frame's chroma averages exceed 300, else if any YMAX of the first 101 frames exceeds 250 (missing: 255)."""
    first = F.min_by(F.greatest("UAVG", "VAVG"), "frame_idx")
    high = F.max(F.when(F.col("frame_idx") <= 100, F.coalesce("YMAX", F.lit(255.0))))
    one = frames.groupBy("asset_id").agg(first.alias("chroma"), high.alias("high"))
    return one.select("asset_id", F.when(F.col("chroma") > 300, 10).when(F.col("high") > 250, 10).otherwise(8).alias("bits"))


def chroma_flags(bit_depth: int = 10) -> dict[str, Column]:
    """envelope: U and V reach both ends; saturation: SATMAX too high."""
    low, high, most = (CHROMA[x] * (1.0 if bit_depth == 10 else 0.25) for x in ("low", "high", "saturation"))
    envelope = (F.col("UMIN") < low) & (F.col("VMIN") < low) & (F.col("UMAX") > high) & (F.col("VMAX") > high)
    return {"envelope": F.coalesce(envelope, F.lit(False)), "saturation": F.coalesce(F.col("SATMAX") > most, F.lit(False))}


def chroma_events(frames: DataFrame, gap: int = 10, bit_depth: int = 10) -> DataFrame:
    """Runs of flagged frames with index gaps of at most `gap`; single frames stay only if both rules fire. With the summary of each."""
    flags = chroma_flags(bit_depth)
    own = frames.select("asset_id", "frame_idx", "t", "SATMAX", "HUEMED", *[x.alias(k) for k, x in flags.items()]).where("envelope or saturation")
    peak = F.max(F.struct("SATMAX", -F.col("frame_idx"), "t", "HUEMED"))
    totals = {"start_s": (F.min("t"), F.min), "end_s": (F.max("t"), F.max), "frame_count": (F.count("*"), F.sum), "p": (peak, F.max), "both": (F.count_if(F.col("envelope") & F.col("saturation")), F.sum)}
    totals |= {k: (F.bool_or(k), F.bool_or) for k in flags}
    events = runs(own, ASSET, "frame_idx", F.lit(True), totals, lambda before, now: now["first"] - before["last"] <= gap)
    rules = F.array_compact(F.array(*[F.when(F.col(k), k) for k in flags]))
    out = events.select("asset_id", "start_s", "end_s", "frame_count", F.array_join(rules, "+").alias("rules"), F.col("p.SATMAX").alias("peak_satmax"), "p", "both")
    out = out.where("frame_count >= 2 or both > 0")
    return out.select("asset_id", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "frame_count", "rules", "peak_satmax", F.col("p.t").alias("peak_s"), F.col("p.HUEMED").alias("peak_hue"))


def top_events(events: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("asset_id").orderBy(F.desc("frame_count"), "start_s")
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def black_segments(frames: DataFrame, min_s: float = 2.0, gap: float = 0.5) -> DataFrame:
    """asset_id, start_s, end_s, frames: runs of black frames. A run ends where a frame that is not black stands over `gap` after its last black one."""
    own = frames.select("asset_id", "frame_idx", "t", is_black().alias("black"))
    dark = F.when(F.col("black"), F.col("t"))
    totals = {"light_s": (F.max(F.when(~F.col("black"), F.col("t"))), F.max), "start_s": (F.min(dark), F.min), "end_s": (F.max(dark), F.max), "frames": (F.count_if("black"), F.sum)}
    # Frames that are not black with the black ones after them; then those of them that belong together.
    units = runs(own, ASSET, "frame_idx", F.col("black"), totals, lambda before, now: ~before["tail"] | now["head"]).where("frames > 0").drop("last")
    totals = {"start_s": (F.min("start_s"), F.min), "end_s": (F.max("end_s"), F.max), "frames": (F.sum("frames"), F.sum)}
    found = runs(units, ASSET, "first", F.struct("light_s", "end_s"), totals, lambda before, now: now["head"]["light_s"] - before["tail"]["end_s"] <= gap)
    return found.where(F.col("end_s") - F.col("start_s") >= min_s).select("asset_id", "start_s", "end_s", "frames")


def low_diff_frame(bit_depth: int = 10) -> Column:
    """Whether a frame hardly differs from the one before, and is no flat field: a difference that is missing is large, a missing level is not flat."""
    most, flat = FREEZE[bit_depth]
    low = (F.col("YDIF") < most) & (F.col("UDIF") < most) & (F.col("VDIF") < most)
    return F.coalesce(low, F.lit(False)) & ~F.coalesce(F.col("YMAX") - F.col("YMIN") < flat, F.lit(False))


def freeze_candidates(frames: DataFrame, min_run: int = 2, bit_depth: int = 10, excluded: DataFrame | None = None) -> DataFrame:
    """Runs of at least min_run frames that hardly differ from the one before: start_s, end_s, duplicates, frozen (one more) and their differences; of VREP too, where frames have it.

    Frames in an excluded region (asset_id, start_s, end_s: black segments, bars) end a run; those without a time are passed over.
    """
    means = {k: c for k, c in {"avg_ydif": "YDIF", "avg_udif": "UDIF", "avg_vdif": "VDIF", "avg_vrep": "VREP"}.items() if c in frames.columns}
    own = frames.where(F.col("t").isNotNull()).select("asset_id", "frame_idx", "t", low_diff_frame(bit_depth).alias("low"), *[F.coalesce(c, F.lit(0.0)).alias(c) if c == "VREP" else c for c in means.values()])
    if excluded is not None:
        own = near_regions(own, excluded.select("asset_id", "start_s", "end_s"), "_out", lambda held: F.coalesce(F.size(held) > 0, F.lit(False)))
        own = own.withColumn("low", F.col("low") & ~F.col("_out"))
    totals = {"low": (F.bool_or("low"), F.bool_or), "start_s": (F.min("t"), F.min), "end_s": (F.max("t"), F.max), "duplicates": (F.count("*"), F.sum), "max_ydif": (F.max("YDIF"), F.max)}
    totals |= {f"{k}_{x}": (f(c), F.sum) for k, c in means.items() for x, f in (("sum", F.sum), ("n", F.count))}
    out = runs(own, ASSET, "frame_idx", F.col("low"), totals).where(F.col("low") & (F.col("duplicates") >= min_run))
    mean = {k: F.round(F.col(f"{k}_sum") / F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_n")), 6).alias(k) for k in means}
    return out.select("asset_id", "start_s", "end_s", "duplicates", (F.col("duplicates") + 1).alias("frozen"), mean["avg_ydif"], "max_ydif", *[mean[k] for k in means if k != "avg_ydif"])


def freeze_summary(runs: DataFrame, assets: DataFrame, fps: float = 30000 / 1001) -> DataFrame:
    """asset_id, runs, duplicates, loss_s, status: critical from five runs or ten frames on."""
    one = runs.groupBy("asset_id").agg(F.count("*").alias("runs"), F.sum("duplicates").alias("duplicates"))
    out = assets.select("asset_id").join(one, "asset_id", "left").na.fill(0, ["runs", "duplicates"])
    status = F.when(F.col("runs") == 0, "clean").when((F.col("runs") >= 5) | (F.col("duplicates") >= 10), "critical").otherwise("warning")
    return out.select("asset_id", "runs", "duplicates", F.round(F.col("duplicates") / fps, 6).alias("loss_s"), status.alias("status"))


def downsample_trace(points: DataFrame, value: str, n: int = 5000, mode: str = "max") -> DataFrame:
    """asset_id, bucket, t, value: of each of about n buckets of consecutive points the extreme one, the first of equals."""
    own = points.where(F.col(value).isNotNull()).select("asset_id", "t", F.col(value).alias("value"))
    w = Window.partitionBy("asset_id")
    own = own.withColumn("i", F.row_number().over(w.orderBy("t")) - 1).withColumn("total", F.count("*").over(w))
    own = own.withColumn("bucket", F.floor(F.col("i") / F.ceil(F.col("total") / n)).cast("long"))
    sign = 1 if mode == "max" else -1
    return own.groupBy("asset_id", "bucket").agg(F.max_by(F.struct("t", "value"), F.struct(sign * F.col("value"), -F.col("i"))).alias("x")).select("asset_id", "bucket", "x.*")


def head_bars_end(a: DataFrame, b: DataFrame, within_s: float = 10.0) -> DataFrame:
    """asset_id, bars_end_s: the later end of two detectors, the second only where it starts within `within_s`."""
    both = a.select("asset_id", "end_s").unionByName(b.where(F.col("start_s") < within_s).select("asset_id", "end_s"))
    return both.groupBy("asset_id").agg(F.max("end_s").alias("bars_end_s"))


def bars_agreement(a: DataFrame, b: DataFrame, tolerance: float = 1.0, assets: DataFrame | None = None) -> DataFrame:
    """asset_id, verdict: how two detectors' ends (end_s) compare; with assets (asset_id, those on which both ran), also where both found none."""
    wide = a.select("asset_id", F.col("end_s").alias("a")).join(b.select("asset_id", F.col("end_s").alias("b")), "asset_id", "full_outer")
    verdict = F.when(F.col("a").isNull(), "second only").when(F.col("b").isNull(), "first only").when(F.abs(F.col("a") - F.col("b")) <= tolerance, "agree").otherwise("differ")
    found = wide.select("asset_id", verdict.alias("verdict"))
    return found if assets is None else assets.select("asset_id").distinct().join(found, "asset_id", "left").select("asset_id", F.coalesce("verdict", F.lit("none")).alias("verdict"))


def union_passes(passes: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """asset_id, place, kind, label, start_s, end_s: the regions (asset_id, start_s, end_s) of all passes, numbered by start within the asset.

    passes: regions by (kind, label), in their order: of equal starts, the earlier pass comes first, then the earlier end.
    """
    parts = [df.select("asset_id", F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(k).alias("_pass"), "start_s", "end_s") for k, ((kind, label), df) in enumerate(passes.items())]
    w = Window.partitionBy("asset_id").orderBy("start_s", "_pass", "end_s")
    return reduce(DataFrame.unionByName, parts).select("asset_id", F.row_number().over(w).alias("place"), "kind", "label", "start_s", "end_s")


# The bit that each noise plane of a 10-bit sample shows, and the planes' channels.
BIT_PLANES, PLANE_CHANNELS = {1: "9th", 2: "10th", 3: "8th", 4: "7th"}, {0: "Y", 1: "Cb", 2: "Cr"}


def bitplane_summary(planes: DataFrame) -> DataFrame:
    """asset_id, channel, bit, status, frames, zero_pct, average, max: of per-frame noise (asset_id, channel, bit, value) in the four lowest planes.

    Every asset has a row for each of the three channels and four bits: empty (always 0), active, or no_data.
    """
    own = planes.where(F.col("bit").isin(*BIT_PLANES) & F.col("channel").isin(*PLANE_CHANNELS))
    found = own.groupBy("asset_id", "channel", "bit").agg(F.count("value").alias("frames"), F.count_if(F.col("value") == 0).alias("zeros"), F.avg("value").alias("average"), F.max("value").alias("max"))
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(b).alias("bit")) for c in PLANE_CHANNELS for b in BIT_PLANES])
    every = planes.select("asset_id").distinct().select("asset_id", F.explode(pairs).alias("p")).select("asset_id", "p.*")
    wide = every.join(found, ["asset_id", "channel", "bit"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    status = F.when(F.col("frames") == 0, "no_data").when(F.col("zeros") == F.col("frames"), "empty").otherwise("active")
    return wide.select("asset_id", "channel", "bit", status.alias("status"), "frames", F.round(F.col("zeros") * 100.0 / F.col("frames"), 1).alias("zero_pct"), F.round("average", 6).alias("average"), F.round("max", 6).alias("max"))


def bitplane_verdict(planes: DataFrame) -> DataFrame:
    """asset_id, status, order_check, avg_9th_10th, avg_7th_8th: whether samples have the depth that they claim.

    truncated: all planes with data are empty; partial_truncation: some are; else valid. order_check: whether the less significant bits
    have no less noise (expected) than the more significant ones; null where one of the four has no data.
    """
    summary = bitplane_summary(planes).groupBy("asset_id").agg(F.bool_or(F.col("status") == "empty").alias("any"), F.bool_or(F.col("status") == "active").alias("active"))
    bit = lambda b: F.round(F.avg(F.when(F.col("bit") == b, F.col("value"))), 6)
    bits = planes.where(F.col("channel").isin(*PLANE_CHANNELS)).groupBy("asset_id").agg(((bit(1) + bit(2)) / 2).alias("low"), ((bit(3) + bit(4)) / 2).alias("high"))
    status = F.when(F.col("any") & ~F.col("active"), "truncated").when(F.col("any"), "partial_truncation").otherwise("valid")
    order = F.when(F.col("low") >= F.col("high"), "expected").when(F.col("low") < F.col("high"), "unexpected")
    shown = lambda c: F.when(order.isNotNull(), F.round(c, 6))
    return summary.join(bits, "asset_id", "left").select("asset_id", status.alias("status"), order.alias("order_check"), shown("low").alias("avg_9th_10th"), shown("high").alias("avg_7th_8th"))


def luma_zones(pixels: DataFrame) -> DataFrame:
    """asset_id, subblack_ratio, midtone_ratio, highlight_ratio, primary_zone: where in brightness the pixels (asset_id, y) in violation lie."""
    zone, names = luma_zone("y"), list(LUMA_ZONES.values())
    one = pixels.groupBy("asset_id").agg(*[F.count_if(zone == z).alias(z) for z in names])
    whole = F.greatest(F.lit(1), F.col("subblack") + F.col("midtones") + F.col("highlights"))
    most = F.greatest(*names)
    primary = F.when(F.col("subblack") == most, "subblack").when(F.col("midtones") == most, "midtones").otherwise("highlights")
    return one.select("asset_id", *[F.round(F.col(z) / whole, 6).alias(f"{z.rstrip('s')}_ratio") for z in names], primary.alias("primary_zone"))


def _within(frames: DataFrame, spans: DataFrame, margin: float = 0.0) -> DataFrame:
    """frames inside the spans of their asset, with asset_id as struct(asset_id, span_s), one copy for each span."""
    own = spans.select("asset_id", F.col("start_s").alias("_from"), F.col("end_s").alias("_to"))
    near = frames.join(own, "asset_id").where(F.col("t").between(F.col("_from") - margin, F.col("_to") + margin))
    return near.withColumn("asset_id", F.struct("asset_id", F.col("_from").alias("span_s"))).drop("_from", "_to")


def detect_bars_guided(frames: DataFrame, first: DataFrame, extra: DataFrame, margin: float = 5.0) -> DataFrame:
    """asset_id, label, start_s, end_s: bars at the head, and in windows that another detector names.

    Assets without a head are tried again, relaxed, within `margin` of their `first` windows; `extra` windows are merged and scanned, as usual and
    then relaxed, and numbered by their start.
    """
    head = detect_bars(frames).select("asset_id", F.lit("head").alias("label"), "start_s", "end_s")
    again = detect_bars(_within(frames, first.join(head, "asset_id", "left_anti"), margin), relaxed=True, end_s=float("inf"))
    again = again.groupBy(F.col("asset_id.asset_id").alias("asset_id")).agg(F.lit("head-relaxed").alias("label"), F.min("start_s").alias("start_s"), F.min_by("end_s", "start_s").alias("end_s"))
    scanned = _within(frames, merge_spans(extra, 0.0))
    usual = detect_bars(scanned, end_s=float("inf")).select("asset_id", "start_s", "end_s")
    relaxed = detect_bars(scanned, relaxed=True, end_s=float("inf")).select("asset_id", "start_s", "end_s").join(usual, "asset_id", "left_anti")
    found = usual.unionByName(relaxed).select("asset_id.asset_id", "start_s", "end_s")
    number = F.row_number().over(Window.partitionBy("asset_id").orderBy("start_s", "end_s"))
    more = found.select("asset_id", F.concat(F.lit("additional-"), number.cast("string")).alias("label"), "start_s", "end_s")
    return head.unionByName(again).unionByName(more)
