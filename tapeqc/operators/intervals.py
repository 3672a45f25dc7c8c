"""Interval algebra over regions (asset_id, start_s, end_s): runs, unions, overlaps and exclusions, all keyed by asset.

Range joins are equality joins on asset and bin, with a residual condition. Bins are as wide as regions are long on average, so that regions
have at most three copies each on average, whatever their lengths, and a point, which has one bin, meets only the regions near it: an asset's points
and regions are dealt over as many tasks as they fill. Two intervals overlap if one's start lies in the other, so that overlaps are two joins of
points with regions, which between them find a pair once. Regions with a null or infinite bound, or that end before they start, hold nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

ASSET = ["asset_id"]


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, out: str = "island") -> DataFrame:
    """df with the number of its run among rows of the same keys: a new run starts where `breaks` is true (or null: the first row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_islands(df: DataFrame, keys: list[str], order: str, gap: float, out: str = "island") -> DataFrame:
    """Runs whose neighbours stand at most `gap` apart in `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return islands(df.withColumn("_prev", F.lag(order).over(w)), keys, [order], F.col(order) - F.col("_prev") > gap, out).drop("_prev")


def merge_spans(spans: DataFrame, gap: float = 0.0, keys: list[str] = ASSET, extra: list[Column] | None = None) -> DataFrame:
    """Unions of spans whose start is at most `gap` after the latest end before; n_spans and `extra` aggregates for each."""
    w = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    before = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(spans.withColumn("_end", before), keys, ["start_s", "end_s"], F.col("start_s") - F.col("_end") > gap)
    return runs.groupBy(*keys, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_spans"), *(extra or [])).drop("island")


#: The least width of a bin in seconds.
LEAST_S = 1 / 64


def _binned(regions: DataFrame, keys: list[str], end: Column) -> tuple[Column, DataFrame]:
    """A bin's width, and keys, _bin, _from, _to, _region: a row for each region and each bin that it reaches, _region the struct of its columns.

    The regions are written, so that what makes them does not run again for the width.
    """
    bounds = regions.select(*keys, F.col("start_s").cast("double").alias("_from"), end.cast("double").alias("_to"), F.struct(*regions.columns).alias("_region"))
    bounds = bounds.where((F.col("_from") <= F.col("_to")) & (F.abs("_from") < float("inf")) & (F.abs("_to") < float("inf")))
    bounds = written(bounds, "regions")
    width = F.greatest(F.lit(LEAST_S), F.coalesce(bounds.select(F.avg(F.col("_to") - F.col("_from"))).scalar(), F.lit(1.0)))
    return width, bounds.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))))


def _inside(at: Column, open_end: bool) -> Column:
    return (at >= F.col("r._from")) & ((at < F.col("r._to")) if open_end else (at <= F.col("r._to")))


def with_regions(points: DataFrame, regions: DataFrame, end: Column | None = None, keys: list[str] = ASSET, open_end: bool = False, how: str = "inner") -> DataFrame:
    """points (keys, t, ...) with _region, the struct of a region that holds them: a row for each pair; or, by `how`, the points with or without any.

    `end`: a region's end, if it is not end_s; with open_end it is outside.
    """
    width, binned = _binned(regions, keys, F.col("end_s") if end is None else end)
    on = (F.col("p._bin") == F.col("r._bin")) & _inside(F.col("p.t"), open_end)
    for k in keys:
        on = (F.col(f"p.{k}") == F.col(f"r.{k}")) & on
    joined = points.withColumn("_bin", F.floor(F.col("t") / width)).alias("p").join(binned.alias("r"), on, how)
    return joined.select("p.*", "r._region").drop("_bin") if how == "inner" else joined.drop("_bin")


def near_regions(points: DataFrame, regions: DataFrame, out: str, found: Callable[[Column], Column], end: Column | None = None, open_end: bool = False, keys: list[str] = ASSET) -> DataFrame:
    """points (keys, t, ...), each once, with `out`: `found` of the array of the regions that hold it (null where there is none near).

    The regions of a bin come to its points as one array.
    """
    width, binned = _binned(regions, keys, F.col("end_s") if end is None else end)
    lists = binned.groupBy(*keys, "_bin").agg(F.collect_list(F.struct("_from", "_to", "_region")).alias("_near"))
    holds = lambda r: (F.col("t") >= r["_from"]) & ((F.col("t") < r["_to"]) if open_end else (F.col("t") <= r["_to"]))
    joined = points.withColumn("_bin", F.floor(F.col("t") / width)).join(lists, [*keys, "_bin"], "left")
    return joined.select(*points.columns, found(F.transform(F.filter("_near", holds), lambda r: r["_region"])).alias(out))


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """_left, _right: structs of the rows whose intervals (start_s, end_s; both ends included) overlap, each pair of rows once."""
    a, b = (df.select(*keys, "start_s", "end_s", F.col("start_s").alias("t"), F.struct(*df.columns).alias("_row")) for df in (left, right))
    pair = lambda x, y: (x.alias("_left"), y.alias("_right"))
    first = with_regions(a, b, keys=keys).select(*pair(F.col("_row"), F.col("_region._row")))
    second = with_regions(b, a, keys=keys).where(F.col("t") > F.col("_region.start_s")).select(*pair(F.col("_region._row"), F.col("_row")))
    return first.union(second)


def spans_overlap(left: DataFrame, right: DataFrame, slack: float = 0.0, keys: list[str] = ASSET, inside: bool = True) -> DataFrame:
    """Rows of left that overlap (touching counts) some span of right within `slack`; with inside=False those that overlap none. Rows that repeat stay."""
    wide = right.select(*keys, (F.col("start_s") - slack).alias("start_s"), (F.col("end_s") + slack).alias("end_s"))
    met = _met(left.distinct(), wide, keys).select("_left").distinct()
    return left.withColumn("_row", F.struct(*left.columns)).join(met, F.col("_row").eqNullSafe(F.col("_left")), "left_semi" if inside else "left_anti").drop("_row")


def uncovered(left: DataFrame, right: DataFrame, slack: float = 5.0, pad: float = 5.0) -> DataFrame:
    """Spans of left that right does not cover, padded by `pad` seconds (from 0 on) and merged."""
    alone = spans_overlap(left, right, slack, inside=False)
    padded = alone.select("asset_id", F.greatest(F.lit(0.0), F.col("start_s") - pad).alias("start_s"), (F.col("end_s") + pad).alias("end_s"))
    return merge_spans(padded)


def exclude_regions(points: DataFrame, regions: DataFrame, margin: float = 0.0) -> DataFrame:
    """Rows (asset_id, t) that lie in no region, ends included and `margin` seconds after them; regions without bounds exclude nothing."""
    return with_regions(points, regions, F.col("end_s") + margin, how="left_anti")


def time_range(points: DataFrame, start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """Rows whose t lies from start_s to end_s, both included; an end that is None leaves its side open."""
    for bound, keep in ((start_s, lambda b: F.col("t") >= b), (end_s, lambda b: F.col("t") <= b)):
        points = points if bound is None else points.where(keep(bound))
    return points


def skip_head_bars(points: DataFrame, ends: DataFrame, inclusive: bool = False) -> DataFrame:
    """Rows (asset_id, t) from the end of their asset's head bars (asset_id, bars_end_s) on, or after it with `inclusive`; assets without bars stay whole."""
    on = (F.col("p.asset_id") == F.col("e.asset_id")) & ((F.col("p.t") <= F.col("e.bars_end_s")) if inclusive else (F.col("p.t") < F.col("e.bars_end_s")))
    return points.alias("p").join(ends.alias("e"), on, "left_anti")


def suppress_in_bars(candidates: DataFrame, bars: DataFrame, margin: float = 1.0) -> DataFrame:
    return exclude_regions(candidates, bars, margin)


def assign_period(points: DataFrame, periods: DataFrame) -> DataFrame:
    """points (asset_id, t, ...) with period_no of the first period [start_s, start_s + duration_s) that holds them, else null; repeated points stay."""
    first = lambda held: F.array_min(F.transform(held, lambda p: p["period_no"]))
    return near_regions(points, periods.select("asset_id", "period_no", "start_s", "duration_s"), "period_no", first, F.col("start_s") + F.col("duration_s"), open_end=True)


def period_overlap(p: DataFrame, q: DataFrame) -> DataFrame:
    """asset_id, period_p, period_q, overlap_s: seconds that two sets of periods (period_no, start_s, duration_s) share, pair by pair."""
    a, b = (df.select("asset_id", "period_no", "start_s", (F.col("start_s") + F.col("duration_s")).alias("end_s")) for df in (p, q))
    shared = F.least("_left.end_s", "_right.end_s") - F.greatest("_left.start_s", "_right.start_s")
    wide = _met(a, b, ASSET).where(shared > 0)
    return wide.select("_left.asset_id", F.col("_left.period_no").alias("period_p"), F.col("_right.period_no").alias("period_q"), shared.alias("overlap_s"))


def coverage_fraction(spans: DataFrame, durations: DataFrame, keys: list[str] = ASSET) -> DataFrame:
    """keys, covered_s, fraction: the share of each duration that the union of spans covers; nothing counts twice."""
    covered = merge_spans(spans, 0.0, keys).groupBy(*keys).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("covered_s"))
    out = durations.join(covered, keys, "left").withColumn("covered_s", F.coalesce("covered_s", F.lit(0.0)))
    return out.select(*keys, "covered_s", F.when(F.col("duration_s") > 0, F.least(F.lit(1.0), F.col("covered_s") / F.col("duration_s"))).otherwise(0.0).alias("fraction"))


def overlapping_methods(astats: DataFrame, r128: DataFrame) -> DataFrame:
    """Spans of r128 kept where they overlap one of astats; all of them for assets without any of astats."""
    with_any = spans_overlap(r128, astats)
    alone = r128.join(astats.select("asset_id").distinct(), "asset_id", "left_anti")
    return with_any.unionByName(alone)


def cross_channel_support(events: DataFrame, slack: float = 0.5) -> DataFrame:
    """Events (asset_id, ch, start_s, end_s, corroborating) that another channel's event, corroborated by more than zero crossings, overlaps."""
    strong = events.where(F.exists("corroborating", lambda x: x != "Zero_crossings_rate"))
    wide = strong.select("asset_id", "ch", (F.col("start_s") - slack).alias("start_s"), (F.col("end_s") + slack).alias("end_s"))
    met = _met(events.distinct(), wide, ASSET).where(F.col("_left.ch") != F.col("_right.ch")).select("_left").distinct()
    return events.withColumn("_row", F.struct(*events.columns)).join(met, F.col("_row").eqNullSafe(F.col("_left")), "left_semi").drop("_row")


def even_periods(assets: DataFrame, n: int = 3, length_s: float = 60.0, lead_s: float = 10.0, tail_s: float = 30.0, hints: DataFrame | None = None) -> DataFrame:
    """asset_id, period_no, start_s, duration_s: up to n periods of each asset (asset_id, duration_s, content_start_s, bars_end_s).

    They begin `lead_s` after the content's start and the bars' end and leave the last `tail_s` alone. Where the n best hints (asset_id, rank, t) from
    there on all give a period around them that fits, these are it. Else periods are evenly spaced, fewer where there is no room for n;
    where there is none for one, one is cut to what there is; an asset with nothing left has none.
    """
    first = F.greatest(F.coalesce("content_start_s", F.lit(0.0)), F.coalesce("bars_end_s", F.lit(0.0))) + lead_s
    base = assets.select("asset_id", first.alias("first"), (F.col("duration_s") - tail_s).alias("end")).withColumn("room", F.col("end") - F.col("first"))
    count = F.when(F.col("room") >= n * length_s, n).when(F.col("room") >= length_s, F.least(F.lit(n), F.floor(F.col("room") / length_s))).otherwise(1).cast("int")
    own = base.where("room > 0").withColumn("n", count)
    spaced = own.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("period_no"))
    step = F.greatest(F.lit(0.0), F.col("room") - length_s) / F.greatest(F.lit(1), F.col("n") - 1)
    even = spaced.select("asset_id", "period_no", (F.col("first") + F.col("period_no") * step).alias("start_s"), F.least(F.lit(length_s), F.col("room")).alias("duration_s"))
    if hints is None:
        return even
    near = hints.join(base, "asset_id").where(F.col("t") >= F.col("first"))
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("asset_id").orderBy("rank"))).where(F.col("_r") <= n)
    around = best.withColumn("start_s", F.greatest("first", F.col("t") - length_s / 2)).where(F.col("start_s") + length_s <= F.col("end"))
    full = around.groupBy("asset_id").agg(F.count("*").alias("_k")).where(F.col("_k") == n).select("asset_id")
    chosen = around.join(full, "asset_id", "left_semi").select("asset_id", (F.col("_r") - 1).alias("period_no"), "start_s", F.lit(length_s).alias("duration_s"))
    return chosen.unionByName(even.join(full, "asset_id", "left_anti"))


def descending(c: str) -> Column:
    """A number that sorts as desc(c) does, NaN first."""
    return F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(-F.col(c))


def greedy_spaced(df: DataFrame, keys: list[str], order: list[Column], at: str, apart: float, k: int, fill: bool = False, touching: bool = False) -> DataFrame:
    """The first k rows of each key in `order` (ascending) that stand at least `apart` (more than that if `touching` is too near) from all chosen before; with `fill`, others make up k.

    A round for each of the k takes every key's best row by an aggregation, then leaves out the rows near it: a key holds k rows at once, however
    many candidates it has.
    """
    cols = [c for c in df.columns if c not in keys]
    own = written(df.select(*keys, F.struct(*cols).alias("_row"), F.col(at).cast("double").alias("_at"), F.struct(*order).alias("_by"), F.monotonically_increasing_id().alias("_id")), "spaced-candidates")
    chosen = None

    def left(near: Column) -> DataFrame:
        on = near
        for c in keys:
            on = F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) & on
        return own.alias("l").join(chosen.alias("c"), on, "left_anti")

    same, far = F.col("l._id") == F.col("c._id"), F.abs(F.col("l._at") - F.col("c._at"))
    near = same | F.coalesce(far <= apart if touching else far < apart, F.lit(True))
    for rank in range(1, k + 1):
        best = (own if chosen is None else left(near)).groupBy(*keys).agg(F.min_by(F.struct("_row", "_at", "_id"), F.struct("_by", "_id")).alias("_x"))
        best = written(best.select(*keys, F.lit(rank).alias("rank"), "_x.*"), "spaced-chosen")
        if rank > 1 and best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best)
    out = chosen.select(*keys, "rank", "_row")
    if fill:
        w = Window.partitionBy(*keys).orderBy("_by", "_id")
        rest = left(same).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k)
        held = chosen.groupBy(*keys).agg(F.max("rank").alias("_held"))
        on = F.lit(True)
        for c in keys:
            on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}"))
        more = rest.alias("l").join(held.alias("h"), on).where(F.col("_place") + F.col("_held") <= k)
        out = out.unionByName(more.select(*[F.col(f"l.{c}") for c in keys], (F.col("_place") + F.col("_held")).alias("rank"), "_row"))
    return out.select(*keys, "rank", "_row.*")
