"""Audio checks over per-channel frames (asset_id, ch, frame_idx, t, metrics) and per-frame loudness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import IMBALANCE, characterize_imbalance, dropped_sample_score
from ..tables import written
from .intervals import ASSET, gap_islands, islands, merge_spans, near_regions, suppress_in_bars
from .medians import running_median
from .runs import near_rows, runs

CHANNEL = ["asset_id", "ch"]


def clipping_summary(frames: DataFrame, level: float = -0.5) -> DataFrame:
    """asset_id, total, clipped, pct, max_peak, max_flat: frames whose peak level reaches `level` dBFS."""
    clipped = F.count_if(F.col("peak_level") >= level)
    return frames.groupBy("asset_id").agg(F.count("*").alias("total"), clipped.alias("clipped"), F.round(clipped * 100.0 / F.count("*"), 6).alias("pct"), F.max("peak_level").alias("max_peak"), F.max("flat_factor").alias("max_flat"))


def channel_means(frames: DataFrame) -> DataFrame:
    """asset_id, ch, mean_rms, n: over the first frames of each channel, as many as the shortest channel has."""
    own = frames.where(F.col("rms_level").isNotNull()).select("asset_id", "ch", "rms_level", F.row_number().over(Window.partitionBy(*CHANNEL).orderBy("frame_idx")).alias("i"))
    least = own.groupBy(*CHANNEL).agg(F.max("i").alias("n")).groupBy("asset_id").agg(F.min("n").alias("n"))
    return own.join(least, "asset_id").where("i <= n").groupBy(*CHANNEL, "n").agg(F.avg("rms_level").alias("mean_rms")).select(*CHANNEL, "mean_rms", "n")


def channel_pairs(means: DataFrame) -> DataFrame:
    """asset_id, ch_a, ch_b, diff_db, label, louder: each pair of channels of an asset once."""
    a, b = (means.select("asset_id", F.col("ch").alias(f"ch_{x}"), F.col("mean_rms").alias(f"mean_{x}")) for x in "ab")
    wide = a.join(b, "asset_id").where("ch_a < ch_b").withColumn("diff_db", F.col("mean_a") - F.col("mean_b"))
    louder = F.when(F.col("diff_db") > 0, F.col("ch_a")).when(F.col("diff_db") < 0, F.col("ch_b"))
    return wide.select("asset_id", "ch_a", "ch_b", F.round(F.abs("diff_db"), 6).alias("diff_db"), characterize_imbalance("diff_db").alias("label"), louder.alias("louder"))


def channel_imbalance(frames: DataFrame, silent_db: float = -60.0) -> DataFrame:
    """asset_id, channels, label, worst_a, worst_b, worst_db, silent: the worst pair, and the silent channels of a significant imbalance."""
    means = channel_means(frames)
    worst = channel_pairs(means).groupBy("asset_id").agg(F.max_by(F.struct("ch_a", "ch_b", "diff_db", "label"), F.struct("diff_db", -F.col("ch_a"), -F.col("ch_b"))).alias("w"))
    one = means.groupBy("asset_id").agg(F.count("*").alias("channels"), F.array_sort(F.collect_list(F.when(F.col("mean_rms") < silent_db, F.col("ch")))).alias("quiet"))
    out = one.join(worst, "asset_id", "left")
    label = F.when(F.col("channels") == 1, "Mono").otherwise(F.col("w.label"))
    return out.select("asset_id", "channels", label.alias("label"), F.col("w.ch_a").alias("worst_a"), F.col("w.ch_b").alias("worst_b"), F.col("w.diff_db").alias("worst_db"), F.when(label == IMBALANCE[None], F.array_join("quiet", ",")).otherwise("").alias("silent"))


def _upper_median(c: str, n: int, keys: list[str | Column] = CHANNEL) -> Column:
    """The upper median of the previous n values that are there; null before n of them."""
    before = F.collect_list(c).over(Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-n, -1))
    return F.when(F.size(before) == n, F.element_at(F.sort_array(before), n // 2 + 1))


def dropout_candidates(frames: DataFrame, n: int = 7, floor_db: float = -55.0, drop_db: float = 40.0) -> DataFrame:
    """asset_id, ch, frame_idx, t, rms_level, median_rms, corroborating: frames that fall far below the median of the n before.

    Frames without an RMS level are left out first; each other metric keeps a window of its own values that are there. A frame joins the
    windows after it was judged.
    """
    rules = {"max_difference": ("Max_difference", lambda x, m: x < 0.1 * m), "rms_difference": ("RMS_difference", lambda x, m: x < 0.1 * m), "zero_crossings_rate": ("Zero_crossings_rate", lambda x, m: x > 3 * m)}
    rules = {c: rule for c, rule in rules.items() if c in frames.columns}
    own = frames.where(F.col("rms_level").isNotNull()).withColumn("median_rms", _upper_median("rms_level", n))
    for c in rules:  # a metric's rows with and without a value are apart, so that the rows before are those with one
        own = own.withColumn(f"_{c}", _upper_median(c, n, [*CHANNEL, F.col(c).isNull()]))
    found = own.where((F.col("median_rms") >= floor_db) & (F.col("median_rms") - F.col("rms_level") >= drop_db))
    names = [F.when((F.col(f"_{c}") > 0) & rule(F.col(c), F.col(f"_{c}")), name) for c, (name, rule) in rules.items()]
    return found.select(*CHANNEL, "frame_idx", "t", "rms_level", "median_rms", F.array_compact(F.array(*names).cast("array<string>")).alias("corroborating"))


def dropout_events(candidates: DataFrame, bars: DataFrame | None = None, gap: float = 3.5, long_s: float = 2.0) -> DataFrame:
    """asset_id, ch, start_s, end_s, worst_rms, median_rms, corroborating, confidence: candidates of a channel at most `gap` apart are one event.

    Those inside bars are left out. Events longer than `long_s` need two corroborators; those that zero crossings alone corroborate need an
    event of another channel, better corroborated, that overlaps within half a second.
    """
    if bars is not None:
        candidates = suppress_in_bars(candidates, bars)
    grouped = gap_islands(candidates, CHANNEL, "t", gap)
    events = grouped.groupBy(*CHANNEL, "island").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.min("rms_level").alias("worst_rms"), F.max("median_rms").alias("median_rms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("corroborating")))).alias("corroborating")).drop("island")
    n = F.size("corroborating")
    events = events.withColumn("confidence", F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low"))
    events = events.where((F.col("end_s") - F.col("start_s") <= long_s) | (n >= 2))
    alone = F.coalesce((n == 1) & F.array_contains("corroborating", "Zero_crossings_rate"), F.lit(False))
    strong = events.where(F.exists("corroborating", lambda x: x != "Zero_crossings_rate"))
    on = (F.col("l.asset_id") == F.col("r.asset_id")) & (F.col("l.ch") != F.col("r.ch")) & (F.col("l.start_s") <= F.col("r.end_s") + 0.5) & (F.col("r.start_s") <= F.col("l.end_s") + 0.5)
    supported = events.where(alone).alias("l").join(strong.alias("r"), on, "left_semi")
    return events.where(~alone).unionByName(supported)


# Thresholds of audible timecode in loudness (R128) and in channel statistics (astats).
WINDOW_S, R128_WINDOWS, ASTATS_WINDOWS = 30.0, 6, 2
R128_A = {"m_stdev": 2.0, "m_mean": -25.0, "lra_median": 8.5}
R128_B = {"lra_high": (-30.0, -10.0), "lra_high_stdev": 2.0, "m_i_diff": 20.0, "lra_median": 13.0}
R128_C = {"ms_diff_median": 1.5, "m_stdev": 8.0, "lra_high": (-30.0, -24.0), "lra_high_stdev": 3.0, "m_min": -60.0}
R128_NAMES = {"A": "R128-A (stable mix at TC level)", "B": "R128-B (TC + silence)", "C": "R128-C (TC + program audio)"}
ASTATS_BANDS = {"rms_level": (-30.0, -10.0), "crest_factor": (1.55, 2.25), "zero_crossings_rate": (0.05, 0.10), "entropy": (0.60, 0.80)}
ASTATS_STDEV = {"rms_level": 1.0, "crest_factor": 0.30, "zero_crossings_rate": 0.02, "entropy": 0.05}
ASTATS_STDEV_HIGH = {"rms_level": 0.5, "crest_factor": 0.10, "zero_crossings_rate": 0.005, "entropy": 0.02}
REFINE_BAND, REFINE_SMOOTH_S = (-45.0, -8.0), 1.0


def frame_steps(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames with _i (a key's frames from 0), _n (how many) and _dt: the seconds between its first two frames, a tenth where there is no such step."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dt = F.nth_value("t", 2).over(whole) - F.first("t").over(whole)
    return frames.select("*", (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"), F.when(dt > 0, dt).otherwise(0.1).alias("_dt"))


def hopping_windows(df: DataFrame, keys: list[str], seconds: float = WINDOW_S, nearest: bool = False) -> DataFrame:
    """df with win for each full window of `seconds`, every half window, that a row belongs to: rows are copied at most three times.

    A window's frames are counted by the key's own step, cut to a whole number, or rounded (half to even) with `nearest`.
    """
    own = frame_steps(df, keys)
    frames = F.lit(seconds) / F.col("_dt")
    own = own.withColumn("_size", F.greatest(F.lit(1), F.bround(frames, 0).cast("int") if nearest else F.floor(frames).cast("int")))
    own = own.withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_size") / 2).cast("int")))
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - F.col("_size") + 1) / F.col("_step")).cast("int"))
    high = F.least(F.floor(F.col("_i") / F.col("_step")), F.floor((F.col("_n") - F.col("_size")) / F.col("_step"))).cast("int")
    return own.where((high >= low) & (F.col("_n") >= F.col("_size"))).withColumn("win", F.explode(F.sequence(low, high))).drop("_i", "_n", "_dt", "_size", "_step")


def _rows(*metrics: str) -> Column:
    """An aggregate: a window's frames in their order, with these metrics."""
    return F.array_sort(F.collect_list(F.struct("frame_idx", *metrics)))


def _measured(rows: str, c: str) -> Column:
    """The values of a metric that were measured, in the order of the frames."""
    return F.filter(F.transform(rows, lambda z: z[c]), lambda x: x.isNotNull())


def _spread(values: Column) -> Column:
    """The sample's standard deviation of an array, 0 of fewer than two values.

    Mean and squares run in the array's order, as stddev_samp's in the order of arrival: spreads that stand at a threshold fall on the same
    side of it however the rows were shuffled.
    """
    mean = lambda a, x: a["mean"] + (x - a["mean"]) / (a["n"] + 1)
    add = lambda a, x: F.struct((a["n"] + 1).alias("n"), mean(a, x).alias("mean"), (a["sq"] + (x - mean(a, x)) * (x - a["mean"])).alias("sq"))
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))
    return F.aggregate(values, none, add, lambda a: F.when(a["n"] > 1, F.sqrt(a["sq"] / (a["n"] - 1))).otherwise(0.0))


def astats_timecode(frames: DataFrame, seconds: float = WINDOW_S) -> DataFrame:
    """asset_id, ch, criterion, win, start_s, end_s, confidence: windows of a channel in which all four metrics stay in their bands and steady.

    frames: asset_id, ch, frame_idx, t and the metrics of ASTATS_BANDS, null where not measured. high: all four are steadier still.
    """
    wide = hopping_windows(frames, CHANNEL, seconds, nearest=True)
    out = wide.groupBy(*CHANNEL, "win").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), *[F.avg(c).alias(f"{c}_m") for c in ASTATS_BANDS], _rows(*ASTATS_BANDS).alias("_rows"))
    for c, band in ASTATS_BANDS.items():
        out = out.where(F.col(f"{c}_m").between(*band))
    out = out.withColumns({f"{c}_s": _spread(_measured("_rows", c)) for c in ASTATS_BANDS}).drop("_rows")
    high = F.lit(True)
    for c in ASTATS_BANDS:
        out = out.where(F.col(f"{c}_s") < ASTATS_STDEV[c])
        high = high & (F.col(f"{c}_s") < ASTATS_STDEV_HIGH[c])
    criterion = F.concat(F.lit("astats (ch"), F.col("ch").cast("string"), F.lit(")"))
    return out.select(*CHANNEL, criterion.alias("criterion"), "win", "start_s", "end_s", F.when(high, "high").otherwise("medium").alias("confidence"))


def label_channels(detections: DataFrame) -> DataFrame:
    """Detections (asset_id, ch, start_s, end_s, ...) with channel: chN, or both (chN) where one of the other channel of 1 and 2 overlaps or touches."""
    detections = written(detections, "channel-detections")  # asked for four times
    on = (F.col("l.asset_id") == F.col("r.asset_id")) & (F.col("l.ch") + F.col("r.ch") == 3) & (F.col("l.start_s") <= F.col("r.end_s")) & (F.col("r.start_s") <= F.col("l.end_s"))
    name = F.concat(F.lit("ch"), F.col("ch").cast("string"))
    both = detections.alias("l").join(detections.alias("r"), on, "left_semi").withColumn("channel", F.concat(F.lit("both ("), name, F.lit(")")))
    return both.unionByName(detections.alias("l").join(detections.alias("r"), on, "left_anti").withColumn("channel", name))


def r128_timecode(frames: DataFrame, seconds: float = WINDOW_S) -> DataFrame:
    """asset_id, criterion, channel, win, start_s, end_s, confidence: a row for each window and each of the three loudness criteria that it meets.

    frames: asset_id, frame_idx, t and r128_m, r128_s, r128_lra, r128_lra_high, r128_i of the mix, null where not measured. A: steady at
    timecode's level. B: a loud side that is steady, far from the asset's integrated loudness (its last below -1), with a wide range.
    C: a momentary loudness that swings away from the short-term one, above silence.
    """
    i = frames.groupBy("asset_id").agg(F.max_by("r128_i", F.when(F.col("r128_i") < -1, F.col("frame_idx"))).alias("i"))
    wide = hopping_windows(frames, ["asset_id"], seconds)
    one = wide.groupBy("asset_id", "win").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.avg("r128_m").alias("m_mean"), F.percentile("r128_m", 0.5).alias("m_med"), F.min("r128_m").alias("m_min"),
        F.percentile("r128_lra", 0.5).alias("lra_med"), F.avg("r128_lra_high").alias("high_mean"), _rows("r128_m", "r128_s", "r128_lra_high").alias("_rows"),
    )
    pairs = F.filter(F.zip_with(_measured("_rows", "r128_m"), _measured("_rows", "r128_s"), lambda m, s: F.abs(m - s)), lambda x: x.isNotNull())
    spreads = {f"{k}_std": _spread(_measured("_rows", c)) for k, c in {"m": "r128_m", "high": "r128_lra_high"}.items()}
    one = one.withColumns(spreads | {"gaps": F.array_sort(pairs)}).drop("_rows").join(i, "asset_id")
    n = F.size("gaps")
    gap = F.when(n > 0, (F.get("gaps", F.floor((n - 1) / 2).cast("int")) + F.get("gaps", F.floor(n / 2).cast("int"))) / 2)
    there = F.col("m_mean").isNotNull()
    a = there & (F.col("m_std") < R128_A["m_stdev"]) & (F.col("m_mean") > R128_A["m_mean"]) & (F.col("lra_med") < R128_A["lra_median"])
    b = there & F.col("high_mean").between(*R128_B["lra_high"]) & (F.col("high_std") < R128_B["lra_high_stdev"]) & (F.abs(F.col("m_med") - F.col("i")) > R128_B["m_i_diff"]) & (F.col("lra_med") > R128_B["lra_median"])
    c = there & (gap > R128_C["ms_diff_median"]) & (F.col("m_std") > R128_C["m_stdev"]) & F.col("high_mean").between(*R128_C["lra_high"]) & (F.col("high_std") < R128_C["lra_high_stdev"]) & (F.col("m_min") > R128_C["m_min"])
    sure = {"A": F.col("m_std") < 1.0, "B": F.col("high_std") < 0.5, "C": gap > 2.0}
    found = [F.when(met, F.struct(F.lit(R128_NAMES[k]).alias("criterion"), F.lit("n/a (mix-based)" if k == "A" else "one channel").alias("channel"), F.when(sure[k], "high").otherwise("medium").alias("confidence"))) for k, met in zip("ABC", (a, b, c), strict=True)]
    out = one.select("asset_id", "win", "start_s", "end_s", F.explode(F.array_compact(F.array(*found))).alias("x"))
    return out.select("asset_id", "x.criterion", "x.channel", "win", "start_s", "end_s", "x.confidence")


def filter_consecutive(detections: DataFrame, n: int = R128_WINDOWS, gap: float = 1.5 * WINDOW_S) -> DataFrame:
    """Detections of runs of at least n, per asset and criterion: one more belongs to a run that starts at most `gap` after the end of the one before."""
    keys = ["asset_id", "criterion"]
    before = F.lag("end_s").over(Window.partitionBy(*keys).orderBy("start_s", "win"))
    grouped = islands(detections.withColumn("_before", before), keys, ["start_s", "win"], F.col("start_s") - F.col("_before") > gap)
    return grouped.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "island"))).where(F.col("_n") >= n).drop("_n", "_before", "island")


def merge_detections(detections: DataFrame, gap: float = WINDOW_S) -> DataFrame:
    """Per asset and criterion, detections that start at most `gap` after the latest end before are one: high if any of them is, with the first one's channel."""
    first = F.min_by(F.struct("channel", "confidence"), F.struct("start_s", "end_s")).alias("_first")
    out = merge_spans(detections, gap, ["asset_id", "criterion"], [F.bool_or(F.col("confidence") == "high").alias("_high"), first])
    return out.select("asset_id", "criterion", "start_s", "end_s", "n_spans", F.col("_first.channel").alias("channel"), F.when(F.col("_high"), "high").otherwise(F.col("_first.confidence")).alias("confidence"))


def union_detections(detections: dict[str, DataFrame]) -> DataFrame:
    """asset_id, place, method, criterion, channel, start_s, end_s, confidence: the detections of all methods, numbered by start within the asset.

    Of equal starts, those of the earlier method come first, then the earlier end and the criterion.
    """
    parts = [df.select("asset_id", F.lit(name).alias("method"), F.lit(k).alias("_method"), "criterion", "channel", "start_s", "end_s", "confidence") for k, (name, df) in enumerate(detections.items())]
    w = Window.partitionBy("asset_id").orderBy("start_s", "_method", "end_s", "criterion", "channel")
    return reduce(DataFrame.unionByName, parts).select("asset_id", F.row_number().over(w).alias("place"), "method", "criterion", "channel", "start_s", "end_s", "confidence")


def majority_smooth(frames: DataFrame, flag: str, k: int = 3, keys: list[str] = CHANNEL, out: str = "smooth") -> DataFrame:
    """df with `out`: more than half of the rows within k, itself included, have the flag."""
    share = lambda w: F.avg(F.col(flag).cast("double")).over(w.rowsBetween(-k, k)) > 0.5
    return near_rows(frames, keys, "frame_idx", {out: share}, k)


def tc_subregions(frames: DataFrame, flag: str, hole_s: float = 2.0, join_s: float = 1.0, least_s: float = 2.0) -> DataFrame:
    """asset_id, ch, start_s, end_s: from first to last flagged frame of the stretches between sustained holes, at least least_s long.

    A hole is a run of frames whose smoothed flag is off, runs less than join_s apart being one, of hole_s or more; its first and last frame
    belong to the stretches beside it.
    """
    own = majority_smooth(frames, flag)
    bounds = {"start_s": (F.min("t"), F.min), "end_s": (F.max("t"), F.max)}
    off = runs(own, CHANNEL, "frame_idx", F.col("smooth"), bounds | {"on": (F.bool_or("smooth"), F.bool_or)}).where("not on")
    merged = {"start_s": (F.min("start_s"), F.min), "end_s": (F.max("end_s"), F.max), "_last": (F.max("last"), F.max)}
    holes = runs(off.select(*CHANNEL, "first", "last", "start_s", "end_s"), CHANNEL, "first", F.struct("start_s", "end_s"), merged, lambda before, now: now["head"]["start_s"] - before["tail"]["end_s"] < join_s)
    holes = holes.where(F.col("end_s") - F.col("start_s") >= hole_s).select(*CHANNEL, "start_s", "end_s", "_last")
    holes = written(holes, "holes")  # few, and asked for three times
    inside = lambda held: F.coalesce(F.exists(held, lambda h: (F.col("t") > h["start_s"]) & (F.col("t") < h["end_s"])), F.lit(False))
    kept = near_regions(own.where(F.col(flag)).select(*CHANNEL, "frame_idx", "t"), holes, "_inside", inside, keys=CHANNEL).where("not _inside")
    # A stretch begins anew before the last frame of each hole.
    cuts = holes.select(*CHANNEL, (F.col("_last") - 0.5).alias("place"), F.lit(None).cast("double").alias("t"))
    marks = kept.select(*CHANNEL, F.col("frame_idx").cast("double").alias("place"), F.col("t").cast("double").alias("t")).unionByName(cuts)
    out = runs(marks, CHANNEL, "place", F.col("t").isNull(), bounds, lambda before, now: ~now["head"])
    return out.where(F.col("end_s") - F.col("start_s") >= least_s).select(*CHANNEL, "start_s", "end_s")


def refine_start(regions: DataFrame, frames: DataFrame, level: str = "r128_m", band: tuple[float, float] = REFINE_BAND, smooth_s: float = REFINE_SMOOTH_S) -> DataFrame:
    """regions (asset_id, start_s, ...) with the start moved back to the first of the frames before it, without a break, whose smoothed level is in the band.

    A frame's smoothed level is the median of the levels there are in the `smooth_s` seconds from it on, by the asset's own step. The walk begins at
    the first frame from the start on; a region after the last frame, or of an asset without frames, begins with the asset's first frame, or stays.
    """
    asked = frames.join(regions.select("asset_id").distinct(), "asset_id", "left_semi")
    own = frame_steps(asked, ASSET).select("asset_id", "t", "_i", F.col(level).alias("x"), F.greatest(F.lit(1), F.floor(smooth_s / F.col("_dt")).cast("int")).alias("_ahead"))
    w = Window.partitionBy("asset_id").orderBy("_i")
    # One frame for windows of any width: places are measured in widths, a little short of which the next window begins.
    near = Window.partitionBy("asset_id").orderBy(F.col("_i") / (F.col("_ahead") - 0.5)).rangeBetween(0, 1)
    judged = own.withColumns({"mid": F.percentile("x", 0.5).over(near), "_next": F.lead("t").over(w)})
    failed = F.when(~F.coalesce(F.col("mid").between(*band), F.lit(False)), F.col("_next"))
    reach = judged.select("asset_id", "t", "_i", F.coalesce(F.max(failed).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("t").over(w)).alias("reach"))
    row = F.struct(*regions.columns)
    marks = reach.select("asset_id", "t", "_i", F.lit(1).alias("kind"), "reach").unionByName(regions.select("asset_id", F.col("start_s").alias("t"), F.lit(0).alias("kind"), row.alias("_row")), allowMissingColumns=True)
    # From the last frame back: a frame that grows with each row is kept up, one that shrinks would be read anew for each.
    ahead = Window.partitionBy("asset_id").orderBy(F.desc("t"), F.desc("kind"), F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.min(F.when(F.col("kind") == 1, F.col("t"))).over(Window.partitionBy("asset_id"))
    out = marks.select("_row", "kind", F.last("reach", ignorenulls=True).over(ahead).alias("reach"), begin.alias("begin")).where("kind = 0")
    return out.select(*[F.coalesce("reach", "begin", "_row.start_s").alias(c) if c == "start_s" else F.col("_row")[c].alias(c) for c in regions.columns])


_RANK = {"low": 1, "medium": 2, "high": 3}


def _best(confidences: Column) -> Column:
    rank = lambda c: F.struct(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), F.lower(c)), F.lit(0)).alias("rank"), c.alias("c"))
    return F.array_max(F.transform(confidences, rank))["c"]


def timecode_consensus(detections: DataFrame, assets: DataFrame) -> DataFrame:
    """asset_id, start_s, end_s, channel, confidence, methods, method_count: regions on which detectors agree.

    detections: asset_id, criterion, channel, start_s, end_s, confidence. Those of astats, of both channels, make the regions; R128 ones that overlap or touch
    add their method and confidence and never move a bound. An R128 one that meets no region stands alone unless assets (asset_id,
    astats_available) says that the asset has channel statistics; of such that overlap, the first stands.
    """
    loud = F.lower(F.col("criterion")).startswith("r128")
    detections = written(detections, "detections")  # merged ones are few, and asked for three times
    r128, astats = detections.where(loud), detections.where(~loud)
    extra = [F.collect_list("confidence").alias("confs"), F.array_sort(F.collect_set("criterion")).alias("names"), F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("channel"), F.lit("ch([0-9]+)"), F.lit(1))))).alias("chs"), F.coalesce(F.bool_or(F.lower("channel").contains("both")), F.lit(False)).alias("both")]
    regions = written(merge_spans(astats.select("asset_id", "start_s", "end_s", "confidence", "criterion", "channel"), 0.0, ASSET, extra).drop("n_spans"), "consensus-regions")
    met = (F.col("l.asset_id") == F.col("r.asset_id")) & (F.col("l.start_s") <= F.col("r.end_s")) & (F.col("r.start_s") <= F.col("l.end_s"))
    measured = assets.where("astats_available").select("asset_id")
    free = r128.alias("l").join(regions.alias("r"), met, "left_anti").join(measured, "asset_id", "left_anti")
    spans = free.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("spans"))  # merged detections of one asset
    none = F.array().cast("array<struct<start_s: double, end_s: double>>")
    apart = F.aggregate("spans", none, lambda a, x: F.when((F.size(a) == 0) | (F.element_at(a, -1)["end_s"] < x["start_s"]), F.array_append(a, x)).otherwise(a))
    alone = spans.select("asset_id", F.explode(apart).alias("x")).select("asset_id", "x.start_s", "x.end_s", F.array().cast("array<string>").alias("confs"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("chs"), F.lit(False).alias("both"))
    whole = regions.select(alone.columns).unionByName(alone)
    wide = whole.alias("l").join(r128.select("asset_id", "start_s", "end_s", "confidence").alias("r"), met, "left")
    out = wide.groupBy("l.asset_id", "l.start_s", "l.end_s", "confs", "names", "chs", "both").agg(F.collect_list("r.confidence").alias("more"), F.count("r.asset_id").alias("n"))
    methods = F.concat(F.when(F.col("n") > 0, F.array(F.lit("R128"))).otherwise(F.array().cast("array<string>")), F.col("names"))
    channel = F.when(F.col("both") | (F.size("chs") > 1), "Both channels").when(F.size("chs") == 1, F.concat(F.lit("Channel "), F.get("chs", F.lit(0)))).otherwise("Not channel-specific (mix-based)")
    return out.select("asset_id", "start_s", "end_s", channel.alias("channel"), _best(F.concat("confs", "more")).alias("confidence"), F.array_join(methods, " + ").alias("methods"), F.size(methods).alias("method_count"))


def single_audio_stream(frames: DataFrame, streams: DataFrame) -> DataFrame:
    """frames of the assets whose audio is one stream (streams: asset_id, audio_streams); an unknown number passes, several streams were mixed down."""
    return frames.join(streams.where(F.col("audio_streams") > 1).select("asset_id"), "asset_id", "left_anti")


def tone_spans(chunks: DataFrame, tolerance: float = 1.0, least_ms: float = 2000.0, chunk_ms: float = 250.0) -> DataFrame:
    """asset_id, start_ms, end_ms: runs of chunks (chunk_no, samples) whose dot product with the chunk before reaches `tolerance`."""
    dot = F.aggregate(F.zip_with("samples", "_prev", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    own = near_rows(chunks.select("asset_id", "chunk_no", "samples"), ASSET, "chunk_no", {"_prev": lambda w: F.lag("samples").over(w)}, 1)
    like = F.coalesce((F.size("samples") == F.size("_prev")) & (dot >= tolerance), F.lit(False))
    out = runs(own.select("asset_id", "chunk_no", like.alias("like")), ASSET, "chunk_no", F.col("like"), {}, lambda before, now: now["head"]).where("last > first")
    out = out.select("asset_id", (F.col("first") * chunk_ms).alias("start_ms"), ((F.col("last") + 1) * chunk_ms).alias("end_ms"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def spike_detection(series: DataFrame, least_width: int = 51, share: int = 20, k: float = 3.0, group: int = 2, bright: float = 0.3) -> DataFrame:
    """asset_id, first_idx, last_idx, peak: narrow places of a series (asset_id, frame_idx, value) that stand far above its running median.

    The median's window is the larger of `least_width` and one in `share` of the asset's values, made odd; beyond the ends the first and the last value go
    on. Far is over k times the median absolute deviation, or the standard deviation where that is 0; a flat series has no spikes. Where there
    is a column bright, that share of a place must be bright too. Places at most `group` apart are one; of over `group` values none is a spike.
    """
    dev = running_median(series, "value", least_width, share, "_median").withColumn("dev", F.col("value") - F.col("_median"))
    spread = dev.groupBy("asset_id").agg(F.percentile(F.abs("dev"), 0.5).alias("mad"), F.stddev_pop("dev").alias("sd"))
    least = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd"))
    high = dev.join(spread, "asset_id").where((least > 0) & (F.col("dev") > k * least))
    if "bright" in series.columns:
        high = high.where(F.col("bright") > bright)
    totals = {"first_idx": (F.min("frame_idx"), F.min), "last_idx": (F.max("frame_idx"), F.max), "peak": (F.max("dev"), F.max), "n": (F.count("*"), F.sum)}
    hits = runs(high, ASSET, "_place", F.lit(True), totals, lambda before, now: now["first"] - before["last"] <= group)
    return hits.where(F.col("n") <= group).select("asset_id", "first_idx", "last_idx", "peak")


def excluded_channels(imbalance_silent: DataFrame, ltc_coverage: DataFrame, channels: DataFrame, share: float = 0.75) -> DataFrame:
    """asset_id, ch, reasons: silent channels and those that timecode covers; none where an asset has under two channels or both of 1 and 2 are flagged."""
    flagged = imbalance_silent.select("asset_id", "ch", F.lit("silent").alias("reason")).unionByName(ltc_coverage.where(F.col("fraction") >= share).select("asset_id", "ch", F.lit("timecode").alias("reason")))
    one = flagged.groupBy("asset_id", "ch").agg(F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reasons"))
    both = one.where(F.col("ch").isin(1, 2)).groupBy("asset_id").agg(F.count("*").alias("n")).where("n = 2")
    return one.join(channels.where(F.col("channels") >= 2).select("asset_id"), "asset_id", "left_semi").join(both, "asset_id", "left_anti")


def tc_channel_summary(regions: DataFrame) -> DataFrame:
    """asset_id, label: both, or the one channel that regions (asset_id, ch) name."""
    one = regions.groupBy("asset_id").agg(F.array_sort(F.collect_set("ch")).alias("chs"))
    return one.select("asset_id", F.when(F.size("chs") >= 2, "Both channels").otherwise(F.concat(F.lit("Channel "), F.element_at("chs", 1).cast("string"))).alias("label"))




def refine_gaps(regions: DataFrame, frames: DataFrame, flag: str, gap: float = 120.0, margin: float = 15.0, **kw: float) -> DataFrame:
    """asset_id, ch, start_s, end_s, confidence: regions at most `gap` apart bridged, looked at again with `margin` more on both sides.

    What the frames' flag shows there is split as tc_subregions does; each part has the best confidence of the regions bridged.
    """
    order = Window.partitionBy(*CHANNEL).orderBy("start_s", "end_s")
    before = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = regions.withColumn("_cut", F.when(F.col("start_s") - before <= gap, 0).otherwise(1))
    numbered = cut.withColumn("_region", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    spans = numbered.groupBy(*CHANNEL, "_region").agg((F.min("start_s") - margin).alias("_from"), (F.max("end_s") + margin).alias("_to"), F.min_by("confidence", rank).alias("_confidence"))
    near = frames.join(spans, CHANNEL).where(F.col("t").between(F.col("_from"), F.col("_to")))
    keyed = near.select("asset_id", F.struct("ch", "_region", "_confidence").alias("ch"), "frame_idx", "t", flag)
    found = tc_subregions(keyed, flag, **kw)
    return found.select("asset_id", F.col("ch.ch").alias("ch"), "start_s", "end_s", F.col("ch._confidence").alias("confidence"))


def dropped_sample_summary(spikes: DataFrame, durations: DataFrame, sample_rate: float = 48000.0) -> DataFrame:
    """asset_id, spikes, diff_ms, loss_s, score, status: of spikes (a row each) and the streams' durations (video_s, audio_s) of every asset."""
    wide = durations.join(spikes.groupBy("asset_id").agg(F.count("*").alias("n")), "asset_id", "left")
    n, ms = F.coalesce("n", F.lit(0)).cast("long"), F.round((F.col("video_s") - F.col("audio_s")) * 1000, 3)
    own = wide.select("asset_id", n.alias("spikes"), ms.alias("diff_ms"), F.round(n / sample_rate, 9).alias("loss_s"))
    return own.select("*", dropped_sample_score("spikes", F.coalesce("diff_ms", F.lit(0.0))).alias("_x")).select("asset_id", "spikes", "diff_ms", "loss_s", "_x.score", "_x.status")
