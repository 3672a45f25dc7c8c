"""Broadcast-range violations: detection, periods, borders, patterns, assessments and diverse examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .intervals import descending, greedy_spaced, with_regions
from .video import is_black


def brng_violations(frames: DataFrame, least: float = 0.01, start_s: float | None = None, end_s: float | None = None, skip_until: float | None = None) -> DataFrame:
    """asset_id, frame_idx, t, score, pct: frames out of range by more than `least` that are not black."""
    for bound, keep in ((start_s, lambda b: F.col("t") >= b), (end_s, lambda b: F.col("t") <= b), (skip_until, lambda b: F.col("t") > b)):
        if bound is not None:
            frames = frames.where(keep(bound))
    return frames.where((F.col("BRNG") > least) & ~is_black()).select("asset_id", "frame_idx", "t", F.col("BRNG").alias("score"), (F.col("BRNG") * 100).alias("pct"))


def top_violations(violations: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("asset_id").orderBy(F.desc("score"), "frame_idx")
    return violations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def violation_histogram(violations: DataFrame, bin_s: float = 10.0) -> DataFrame:
    """asset_id, bin, start_s, n: counts in bins from the asset's first violation on."""
    first = violations.groupBy("asset_id").agg(F.min("t").alias("first"))
    own = violations.join(first, "asset_id").withColumn("bin", F.floor((F.col("t") - F.col("first")) / bin_s))
    return own.groupBy("asset_id", "bin", "first").agg(F.count("*").alias("n")).select("asset_id", "bin", (F.col("first") + F.col("bin") * bin_s).alias("start_s"), "n")


def suggest_periods(violations: DataFrame, n: int = 3, length_s: float = 60.0, bin_s: float = 10.0) -> DataFrame:
    """asset_id, rank, start_s, n: the densest bins, the earlier of equal ones first, whose periods of length_s neither overlap nor touch."""
    bins = violation_histogram(violations, bin_s).select("asset_id", "start_s", "n")
    return greedy_spaced(bins, ["asset_id"], [-F.col("n"), F.col("start_s")], "start_s", length_s, n, touching=True)


def diverse_top_k(violations: DataFrame, k: int = 5, apart_s: float = 10.0) -> DataFrame:
    """asset_id, rank and the violation: by priority (content, other, border), then score, apart_s from all chosen; others fill up."""
    priority = F.when(F.col("kind") == "content", 0).when(F.col("kind") == "border", 2).otherwise(1)
    own = violations.withColumn("priority", priority)
    return greedy_spaced(own, ["asset_id"], [F.col("priority"), descending("score"), F.col("frame_idx")], "t", apart_s, k, fill=True)


def failure_highlights(failures: DataFrame, apart_s: float = 4.0) -> DataFrame:
    """asset_id, tag, rank and the failure: the farthest from their threshold, apart_s apart; five a tag for assets with up to two tags, else three."""
    own = failures.withColumn("off", F.abs(F.col("value") - F.col("threshold")))
    picked = greedy_spaced(own, ["asset_id", "tag"], [descending("off"), F.col("frame_idx")], "t", apart_s, 5)
    # Every tag that fails has one first row: the failures are not read again for the tags.
    tags = F.count_if(F.col("rank") == 1).over(Window.partitionBy("asset_id"))
    return picked.withColumn("tags", tags).where((F.col("tags") <= 2) | (F.col("rank") <= 3)).drop("tags")


def brng_period_summary(frames: DataFrame, periods: DataFrame, least: float = 0.01) -> DataFrame:
    """asset_id, period_no, frames, violations, pct, max_brng, avg_brng: over the frames of each period."""
    spans = periods.select("asset_id", "period_no", "start_s", "duration_s")
    own = with_regions(frames.select("asset_id", "t", "BRNG"), spans, F.col("start_s") + F.col("duration_s"), open_end=True)
    bad = F.count_if(F.col("BRNG") > least)
    return own.groupBy("asset_id", F.col("_region.period_no").alias("period_no")).agg(F.count("*").alias("frames"), bad.alias("violations"), F.round(bad * 100.0 / F.count("*"), 6).alias("pct"), F.max("BRNG").alias("max_brng"), F.round(F.avg("BRNG"), 9).alias("avg_brng"))


def period_compare(full: DataFrame, active: DataFrame) -> DataFrame:
    """asset_id, period_no, verdict: border_violations where the full frame has far more than the active area, content, or minimal."""
    wide = full.select("asset_id", "period_no", F.col("pct").alias("full")).join(active.select("asset_id", "period_no", F.col("pct").alias("active")), ["asset_id", "period_no"])
    verdict = F.when((F.col("full") > F.col("active") + 5) & (F.col("active") < 30), "border_violations").when(F.col("active") > 10, "content_violations").otherwise("minimal")
    return wide.select("asset_id", "period_no", verdict.alias("verdict"))


def border_fraction(full: DataFrame, active: DataFrame) -> DataFrame:
    """asset_id, fraction: the share of violations that lie in borders, within 0 and 1."""
    a = full.groupBy("asset_id").agg(F.sum("pct").alias("full"))
    b = active.groupBy("asset_id").agg(F.sum("pct").alias("active"))
    share = F.when(F.col("full") > 0, (F.col("full") - F.coalesce("active", F.lit(0.0))) / F.col("full")).otherwise(0.0)
    return a.join(b, "asset_id", "left").select("asset_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 6).alias("fraction"))


SIDES = ("left", "right", "top", "bottom")


def violation_patterns(violations: DataFrame) -> DataFrame:
    """asset_id, n, edge_pct, continuous_pct, linear_pct; left_pct, left_score, left_px and so on for each side; n_edges, adjust.

    violations: asset_id, edges (array of the sides affected), continuous (whether a side's violations run on), linear (whether lines were
    found), scores (map of side to its line score). A side's pixels to add are 10 where over half of the violations affect it, 5 over a
    fifth. adjust: whether borders should move, by any of six rules.
    """
    n = F.count("*")
    pct = lambda c: F.count_if(F.coalesce(c, F.lit(False))) * 100.0 / n
    sides = [x for s in SIDES for x in (pct(F.array_contains("edges", s)).alias(f"{s}_pct"), F.avg(F.try_element_at("scores", F.lit(s))).alias(f"{s}_score"))]
    one = violations.groupBy("asset_id").agg(n.alias("n"), pct(F.size("edges") > 0).alias("edge_pct"), pct(F.col("continuous")).alias("continuous_pct"), pct(F.col("linear")).alias("linear_pct"), *sides)
    pixels = [F.when(F.col(f"{s}_pct") > 50, 10).when(F.col(f"{s}_pct") > 20, 5).otherwise(0).alias(f"{s}_px") for s in SIDES]
    several, edge, continuous = F.lit(0), F.col("edge_pct"), F.col("continuous_pct")
    for s in SIDES:
        several = several + (F.col(f"{s}_pct") > 0).cast("int")
    one = one.select("*", *pixels, several.alias("n_edges"))
    highest = F.greatest(*[F.coalesce(F.col(f"{s}_score"), F.lit(0.0)) for s in SIDES])
    rules = (F.col("linear_pct") > 20) | (continuous > 15) | ((edge > 30) & (continuous > 0)) | ((edge > 60) & (continuous == 0)) | ((continuous > 10) & (F.col("n_edges") >= 2)) | (highest > 40)
    return one.withColumn("adjust", rules)


# Diagnostics in the order of a report; one that only recommends is none.
DIAGNOSTICS = ("Sub-black detected", "Highlight clipping", "Edge artifacts", "Linear blanking patterns", "General broadcast range violations")
NO_DIAGNOSTIC = "Border adjustment recommended"


def diagnostic_counts(violations: DataFrame) -> DataFrame:
    """asset_id, diagnostic, n, pct (of the asset's violations), rank (the report's order, others after it by first appearance), dominant.

    violations: asset_id, frame_idx, diagnostics (array). "Edge artifacts (...)" count as one whatever the sides; the dominant diagnostic is the
    commonest, the first to appear of equal ones.
    """
    own = violations.select("asset_id", "frame_idx", F.posexplode("diagnostics").alias("i", "d"))
    own = own.withColumn("diagnostic", F.when(F.col("d").startswith("Edge artifacts"), "Edge artifacts").otherwise(F.col("d"))).where(F.col("diagnostic") != NO_DIAGNOSTIC)
    one = own.groupBy("asset_id", "diagnostic").agg(F.count("*").alias("n"), F.min(F.struct("frame_idx", "i")).alias("first"))
    whole = violations.groupBy("asset_id").agg(F.count("*").alias("whole"))
    order = F.array_position(F.array(*map(F.lit, DIAGNOSTICS)), F.col("diagnostic"))
    w = Window.partitionBy("asset_id")
    rank = F.row_number().over(w.orderBy(F.when(order > 0, order).otherwise(len(DIAGNOSTICS) + 1), "first"))
    first = F.row_number().over(w.orderBy(F.desc("n"), "first")) == 1
    return one.join(whole, "asset_id").select("asset_id", "diagnostic", "n", F.round(F.col("n") * 100.0 / F.col("whole"), 6).alias("pct"), rank.alias("rank"), first.alias("dominant"))


def violation_assessment(violations: DataFrame, patterns: DataFrame) -> DataFrame:
    """asset_id, n, avg_pct, max_pct, edge_pct, linear_pct, assessment: the text composed of the level, the place and the lines of an asset's violations.

    violations: asset_id, pct; patterns: asset_id, edge_pct, linear_pct. Assets without violations give no row.
    """
    one = violations.groupBy("asset_id").agg(F.count("*").alias("n"), F.avg("pct").alias("avg_pct"), F.max("pct").alias("max_pct"))
    wide = one.join(patterns.select("asset_id", "edge_pct", "linear_pct"), "asset_id", "left").fillna(0.0, ["edge_pct", "linear_pct"])
    avg, edge, linear = F.col("avg_pct"), F.col("edge_pct"), F.col("linear_pct")
    whole = lambda x: F.bround(x, 0).cast("long")
    text = lambda x, pattern: F.call_function("format_number", x, F.lit(pattern))  # noqa: E731; rounds the number itself, half to even, not its shortest digits
    level = F.when(avg >= 1.0, F.format_string("Average BRNG: %s%%", text(avg, "0.00"))).when(avg >= 0.1, F.format_string("Average BRNG: %s%% (low-level)", text(avg, "0.00"))).otherwise(F.format_string("Average BRNG: %s%% (minimal)", text(avg, "0.000")))
    place = F.when(edge > 70, F.format_string("%d%% of violations at frame edges", whole(edge))).when(edge > 40, F.format_string("%d%% edge violations, %d%% content area", whole(edge), whole(100 - edge))).when(edge > 0, F.format_string("Violations primarily in content area (%d%%)", whole(100 - edge)))
    lines = F.when(linear > 20, F.format_string("linear blanking patterns detected (%d%%)", whole(linear)))
    return wide.select("asset_id", "n", "avg_pct", "max_pct", "edge_pct", "linear_pct", F.concat_ws("; ", level, place, lines).alias("assessment"))


# Diagnoses of an asset's broadcast range.
DIAGNOSES = {
    "compliant": "Video appears broadcast-compliant",
    "minor": "Minor BRNG violations - likely acceptable",
    "significant": "Significant BRNG violations requiring correction",
    "moderate": "Moderate BRNG violations detected",
    "border": "BRNG violations primarily in border areas - active content appears broadcast-safe",
    "content": "Significant BRNG violations in active picture area - requires correction",
    "review": "BRNG violations detected in active picture area - review recommended",
    "bordered": "Video appears broadcast-compliant with properly detected borders",
}


def brng_diagnosis(pct: Column, max_brng: Column, border_periods: Column, content_periods: Column, has_active_area: Column) -> Column:
    """The diagnosis by the share of frames in violation and the worst value; with an active area, by the periods' verdicts (J16)."""
    say = {k: F.lit(v) for k, v in DIAGNOSES.items()}
    plain = F.when((pct < 10) & (max_brng < 0.1), say["compliant"]).when((pct < 50) & (max_brng < 1.0), say["minor"]).when(max_brng > 2.0, say["significant"]).otherwise(say["moderate"])
    area = F.when(border_periods > content_periods, say["border"]).when((content_periods > 0) & (pct > 50), say["content"]).when(content_periods > 0, say["review"]).otherwise(say["bordered"])
    return F.when(has_active_area, area).otherwise(plain)


def meaningful_improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """asset_id, improved: whether a refinement (after) helped, or another one should be tried.

    Both: asset_id, n (violations), worst_pct (of the first one reported), edge_pct, width, height (of the active area; null if unknown). Fewer than 80 per
    cent of the violations, or of the worst one, is an improvement. Else, where edges still hold over half, it goes on unless the area
    is known and did not move; else edges must have fallen below 70 per cent of theirs. Assets that one of the two lacks are not improved.
    """
    b = before.select("asset_id", *[F.col(c).alias(f"{c}0") for c in ("n", "worst_pct", "edge_pct", "width", "height")])
    a = after.select("asset_id", *[F.col(c).alias(f"{c}1") for c in ("n", "worst_pct", "edge_pct", "width", "height")])
    wide = b.join(a, "asset_id", "full_outer")
    known = F.col("width0").isNotNull() & F.col("width1").isNotNull() & F.col("height0").isNotNull() & F.col("height1").isNotNull()
    moved = (F.col("width0") != F.col("width1")) | (F.col("height0") != F.col("height1"))
    fewer, milder = F.col("n1") < 0.8 * F.col("n0"), F.coalesce("worst_pct1", F.lit(0.0)) < 0.8 * F.coalesce("worst_pct0", F.lit(0.0))
    edge0, edge1 = F.coalesce("edge_pct0", F.lit(0.0)), F.coalesce("edge_pct1", F.lit(0.0))
    improved = F.when(F.col("n0").isNull() | F.col("n1").isNull(), False).when(fewer | milder, True).when(edge1 > 50, ~known | moved).otherwise((edge0 > 0) & (edge1 < 0.7 * edge0))
    return wide.select("asset_id", improved.alias("improved"))


def method_correlation(by_signal: DataFrame, by_brng: DataFrame) -> DataFrame:
    """asset_id, agreement: how the period analysis (diagnosis, a text of DIAGNOSES) and the frame analysis (adjust, edge_pct) of an asset agree.

    both_border, both_content, content_and_border, border_and_content; where one of them is of neither kind likely_border (edges over
    half), likely_content (under a fifth) or mixed. Assets that one of the two lacks give no row.
    """
    wide = by_signal.select("asset_id", F.lower("diagnosis").alias("d")).join(by_brng.select("asset_id", "adjust", "edge_pct"), "asset_id")
    border, content = F.col("d").contains("border"), F.col("d").contains("active") & F.col("d").contains("requires")
    edges = F.col("edge_pct")
    at_border = F.coalesce("adjust", F.lit(False)) | (edges > 50)
    inside = ~at_border & (edges < 30)
    out = F.when(border & at_border, "both_border").when(content & inside, "both_content").when(content & at_border, "content_and_border").when(border & inside, "border_and_content")
    return wide.select("asset_id", out.when(edges > 50, "likely_border").when(edges < 20, "likely_content").otherwise("mixed").alias("agreement"))


def border_median(frame_borders: DataFrame) -> DataFrame:
    """asset_id, left_px, right_px, top_px, bottom_px: medians over frames, truncated."""
    return frame_borders.groupBy("asset_id").agg(*[F.percentile(s, 0.5).cast("int").alias(f"{s}_px") for s in ("left", "right", "top", "bottom")])


def _spaced(last: Column, n: int) -> Column:
    """n whole numbers evenly spaced from 0 to `last`, cut to whole numbers; repeats left out."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * last / max(1, n - 1)).cast("long")))


def sample_evenly(frames: DataFrame, n: int = 20) -> DataFrame:
    """asset_id, frame_idx, t: n frames of each asset, evenly spaced (all, if it has no more)."""
    last = frames.groupBy("asset_id").agg(F.max("frame_idx").alias("last"))
    picks = last.select("asset_id", F.explode(_spaced(F.col("last"), n)).alias("frame_idx"))
    return frames.join(picks, ["asset_id", "frame_idx"], "left_semi").select("asset_id", "frame_idx", "t")


def sample_targeted(segments: DataFrame, violations: DataFrame, first: int = 500, least: int = 100, fill: int = 100, most: int = 500) -> DataFrame:
    """asset_id, period_no, frame_no: the frames of each segment (start_s, end_s, total_frames, fps) to look at.

    Those of the asset's worst `first` violations (asset_id, frame_idx, t, score) that lie in the segment; where they are fewer than `least`, `fill`
    evenly spaced frames too, of all then the first `most`. A segment of an asset without violations has `most` evenly spaced frames.
    """
    worst = top_violations(violations, first).select("asset_id", "t")
    some = segments.join(worst.select("asset_id").distinct().withColumn("_any", F.lit(True)), "asset_id", "left")
    on = (F.col("s.asset_id") == F.col("v.asset_id")) & (F.col("v.t") >= F.col("s.start_s")) & (F.col("v.t") < F.col("s.end_s"))
    hits = segments.alias("s").join(worst.alias("v"), on).select("s.asset_id", "period_no", F.floor((F.col("v.t") - F.col("s.start_s")) * F.col("fps")).alias("frame_no"), "total_frames")
    hits = hits.where(F.col("frame_no") < F.col("total_frames")).groupBy("asset_id", "period_no").agg(F.array_sort(F.collect_set("frame_no")).alias("hits"))  # at most `first`
    wide = some.join(hits, ["asset_id", "period_no"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<bigint>")))
    filled = F.slice(F.array_sort(F.array_union("hits", _spaced(F.col("total_frames") - 1, fill))), 1, most)
    picks = F.when(F.col("_any").isNull(), F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.col("total_frames")).cast("int") - 1), lambda k: F.floor(k * (F.col("total_frames") - 1) / F.greatest(F.lit(1), F.least(F.lit(most), F.col("total_frames")) - 1)).cast("long"))).when(F.size("hits") < least, filled).otherwise(F.col("hits"))
    return wide.select("asset_id", "period_no", F.explode(F.array_distinct(picks)).alias("frame_no"))


def border_widths(areas: DataFrame) -> DataFrame:
    """asset_id, left_px, right_px, top_px, bottom_px, crop_pct of active areas (asset_id, x, y, w, h, width, height): the borders around them, none below 0, and the share of the picture that they take."""
    right, bottom = (F.greatest(F.lit(0), F.col(whole) - F.col(at) - F.col(n)) for whole, at, n in (("width", "x", "w"), ("height", "y", "h")))
    share = F.when(F.col("width") * F.col("height") > 0, 100.0 - 100.0 * F.col("w") * F.col("h") / (F.col("width") * F.col("height")))
    return areas.select("asset_id", F.col("x").alias("left_px"), right.alias("right_px"), F.col("y").alias("top_px"), bottom.alias("bottom_px"), F.round(share, 6).alias("crop_pct"))


def _shared(start: str, length: str) -> Column:
    """Seconds that a span (p.start, p.length) and a black segment (b) share."""
    return F.least(F.col(start) + F.col(length), F.col("b.end_s")) - F.greatest(start, "b.start_s")


def black_seconds(periods: DataFrame, black: DataFrame, start: str = "start_s", keys: tuple[str, ...] = ("asset_id", "period_no")) -> DataFrame:
    """periods with black_s: the seconds of each that black segments (asset_id, start_s, end_s) cover."""
    shared = _shared(f"p.{start}", "p.duration_s")
    own = periods.alias("p").join(black.alias("b"), (F.col("p.asset_id") == F.col("b.asset_id")) & (shared > 0)).select(*[F.col(f"p.{k}") for k in keys], shared.alias("_s"))
    sums = own.groupBy(*keys).agg(F.sum("_s").alias("black_s"))
    return periods.join(sums, list(keys), "left").withColumn("black_s", F.coalesce("black_s", F.lit(0.0)))


def validate_periods(periods: DataFrame, black: DataFrame, most: float = 0.25) -> DataFrame:
    """periods (asset_id, period_no, start_s, duration_s) with black_s and valid: black segments may cover at most that share of a period."""
    return black_seconds(periods, black).withColumn("valid", F.col("black_s") <= most * F.col("duration_s"))


def shift_periods(periods: DataFrame, black: DataFrame, assets: DataFrame, step_s: float = 5.0, most: float = 0.25, most_shifted: float = 0.1, tail_s: float = 10.0) -> DataFrame:
    """asset_id, period_no, start_s, duration_s: periods that black segments cover too much of, moved; those without a place leave.

    assets: asset_id, duration_s (of the whole), first_s (where periods may begin). Places are tried in steps up to half of the asset to either side,
    forward first: inside the asset less its last `tail_s`, covered to at most `most_shifted`, and a whole duration away from the starts of
    the asset's periods before. Periods of an asset are settled in order; candidates are judged for those that must move only.
    """
    judged = validate_periods(periods, black, most).join(assets.select("asset_id", F.col("duration_s").alias("whole_s"), "first_s"), "asset_id")
    steps = F.greatest(F.lit(0), F.ceil(F.col("whole_s") * 0.5 / step_s).cast("int") - 1)
    moves = F.flatten(F.transform(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), lambda k: F.array(k * step_s, -k * step_s)))
    tried = judged.where("not valid").select("asset_id", "period_no", "start_s", "duration_s", "whole_s", "first_s", F.posexplode(moves).alias("k", "by"))
    tried = tried.withColumn("at", F.col("start_s") + F.col("by")).where((F.col("at") >= F.col("first_s")) & (F.col("at") + F.col("duration_s") <= F.col("whole_s") - tail_s))
    free = black_seconds(tried.select("asset_id", "period_no", "k", "at", "duration_s"), black, "at", ("asset_id", "period_no", "k")).where(F.col("black_s") / F.col("duration_s") <= most_shifted)
    places = free.groupBy("asset_id", "period_no").agg(F.array_sort(F.collect_list(F.struct("k", "at"))).alias("places"))  # as many as an asset has steps
    rows = judged.join(places, ["asset_id", "period_no"], "left")
    each = rows.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("period_no", "start_s", "duration_s", "valid", F.coalesce("places", F.expr("array()").cast("array<struct<k: int, at: double>>")).alias("places")))).alias("ps"))
    none = F.array().cast("array<struct<period_no: int, start_s: double, duration_s: double>>")

    def settle(done: Column, p: Column) -> Column:
        far = F.filter(p["places"], lambda x: F.forall(done, lambda u: F.abs(x["at"] - u["start_s"]) >= p["duration_s"]))
        put = lambda at: F.array_append(done, F.struct(p["period_no"].cast("int").alias("period_no"), at.alias("start_s"), p["duration_s"].alias("duration_s")))
        return F.when(p["valid"], put(p["start_s"])).when(F.size(far) > 0, put(F.get(far, F.lit(0))["at"])).otherwise(done)

    return each.select("asset_id", F.explode(F.aggregate("ps", none, settle)).alias("x")).select("asset_id", "x.*")


def settle_periods(periods: DataFrame, candidates: DataFrame, black: DataFrame, assets: DataFrame, least: float = 5.0, **shifts: float) -> DataFrame:
    """replace_low_value_periods, and the periods of assets in which one was replaced judged anew against black segments and moved, or left out, by shift_periods; others stay as they are."""
    periods = written(periods, "periods")  # few, and asked for several times, as is what comes of them
    new = written(replace_low_value_periods(periods, candidates, least), "periods")
    was = periods.select("asset_id", "period_no", F.col("start_s").alias("_s"), F.col("duration_s").alias("_d"))
    moved = new.join(was, ["asset_id", "period_no"]).where((F.col("start_s") != F.col("_s")) | (F.col("duration_s") != F.col("_d"))).select("asset_id").distinct()
    again = shift_periods(new.join(moved, "asset_id", "left_semi"), written(black, "black-segments"), assets, **shifts)
    return again.unionByName(new.join(moved, "asset_id", "left_anti").select(again.columns))


def replace_low_value_periods(periods: DataFrame, candidates: DataFrame, least: float = 5.0) -> DataFrame:
    """asset_id, period_no, start_s, duration_s: periods that showed next to nothing give way, in order, to the candidates that meet no current period.

    periods: asset_id, period_no, start_s, duration_s, verdict (J16), active_pct. A period's score is the active area's share, 100 more with
    content violations, 50 more with border ones. candidates: asset_id, rank, start_s, duration_s; those that overlap or touch a current period are out.
    """
    base = F.when(F.col("verdict") == "content_violations", 100).when(F.col("verdict") == "border_violations", 50).otherwise(0)
    scored = periods.withColumn("score", base + F.coalesce("active_pct", F.lit(0.0)))
    keep, low = scored.where(F.col("score") >= least), scored.where(F.col("score") < least)
    on = (F.col("c.asset_id") == F.col("k.asset_id")) & (F.col("c.start_s") <= F.col("k.start_s") + F.col("k.duration_s")) & (F.col("k.start_s") <= F.col("c.start_s") + F.col("c.duration_s"))
    free = candidates.alias("c").join(periods.alias("k"), on, "left_anti")
    number = lambda df, by: df.withColumn("_i", F.row_number().over(Window.partitionBy("asset_id").orderBy(by)))
    new = number(free, "rank").select("asset_id", "_i", F.col("start_s").alias("new_s"), F.col("duration_s").alias("new_length"))
    swapped = number(low, "period_no").join(new, ["asset_id", "_i"], "left").select("asset_id", "period_no", F.coalesce("new_s", "start_s").alias("start_s"), F.coalesce("new_length", "duration_s").alias("duration_s"))
    return keep.select("asset_id", "period_no", "start_s", "duration_s").unionByName(swapped)
