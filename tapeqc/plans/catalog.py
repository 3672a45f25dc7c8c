"""The registered queries by name: each operator over the whole of a table, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..operators import audio as A
from ..operators import brng as B
from ..operators import intervals as I
from ..operators import metadata as M
from ..operators import similarity as S
from ..operators import video as V
from ..sources import readers as R
from ..tables import written
from . import files
from .frames import CHANNELS, FRAMES, LOUDNESS, TIMECODE, channels, frames, loudness, table, timecode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _kept(own: DataFrame, metrics: set[str]) -> DataFrame:
    """The frames with these metrics as a written table: what is asked for several times is numbered once."""
    return written(own.select("asset_id", "frame_idx", "t", *sorted(metrics)), "frames")


def _r(x: str) -> str:
    return f"round({x}, 6)"


# --- Frames: thresholds, levels, bars ------------------------------------------------------------------------------------------------

THRESHOLDS = {"YMIN": 10.0, "YMAX": 960.0, "YLOW": 60.0, "SATMAX": 550.0, "BRNG": 0.03, "TOUT": 0.009}
_FAILS = {k: f"coalesce({k} {'<' if 'MIN' in k or 'LOW' in k else '>'} {v}, false)" for k, v in THRESHOLDS.items()}
_ANY = " OR ".join(_FAILS.values())
_VIOLATIONS = " UNION ALL ".join(f"SELECT asset_id, frame_idx, t, '{k}' AS tag, {k} AS value, CAST({v} AS DOUBLE) AS threshold FROM frames WHERE {_FAILS[k]}" for k, v in THRESHOLDS.items())


@_query("F1_threshold_violations", f"WITH {FRAMES} {_VIOLATIONS}")
def _(spark, d):
    return V.threshold_violations(frames(spark, d), THRESHOLDS)


@_query("A1_threshold_summary", f"WITH {FRAMES}, one AS (SELECT asset_id, count(*) AS total, count(*) FILTER (WHERE {_ANY}) AS any_failed, {', '.join(f'count(*) FILTER (WHERE {x}) AS f_{k}' for k, x in _FAILS.items())} FROM frames GROUP BY asset_id) " + " UNION ALL ".join(f"SELECT asset_id, '{k}' AS tag, f_{k} AS failed, {_r(f'100.0 * f_{k} / total')}::DOUBLE AS pct, any_failed, total FROM one" for k in THRESHOLDS))
def _(spark, d):
    return V.threshold_summary(frames(spark, d), THRESHOLDS)


_BLACK = "coalesce(YMAX < 300 AND YHIGH < 115 AND YLOW < 97 AND YMIN < 6.5, false)"


@_query("F2_black_frames", f"WITH {FRAMES} SELECT asset_id, count(*) FILTER (WHERE {_BLACK}) AS n FROM frames GROUP BY asset_id")
def _(spark, d):
    return frames(spark, d).groupBy("asset_id").agg(F.count_if(V.is_black()).alias("n"))


_BRNG = f"SELECT asset_id, frame_idx, t, BRNG AS score, BRNG * 100 AS pct FROM frames WHERE BRNG > 0.01 AND NOT {_BLACK}"


@_query("F3_brng_violations", f"WITH {FRAMES} {_BRNG}")
def _(spark, d):
    return B.brng_violations(frames(spark, d))


_BARS = "coalesce(YMAX > 800 AND YMIN < 10 AND YDIF < 8 AND SATMAX > 250, false)"


@_query("F4_bars_frames", f"WITH {FRAMES} SELECT asset_id, count(*) FILTER (WHERE {_BARS}) AS strict, count(*) FILTER (WHERE coalesce(YMAX > 600 AND YMIN < 20 AND YDIF < 16 AND SATMAX > 100, false)) AS relaxed FROM frames GROUP BY asset_id")
def _(spark, d):
    return frames(spark, d).groupBy("asset_id").agg(F.count_if(V.bars_frame()).alias("strict"), F.count_if(V.bars_frame(relaxed=True)).alias("relaxed"))


_TAPE = {"YMAX": ("820 + YDIF", 205), "YMIN": (4, 2), "YDIF": ("YDIF", 1), "SATMAX": ("310 + YDIF", 80), "UMAX": ("UMAX", 240), "UDIF": ("UDIF", 2), "VMAX": ("VMAX", 230), "VDIF": ("VDIF", 2), "TOUT": ("CASE WHEN asset_id % 15 = 5 AND frame_idx % 50 = 9 THEN NULL ELSE 0.02 END", 0.01)}
_BAR = "asset_id % 5 = 0 AND NOT (asset_id % 10 = 0 AND frame_idx % 18 = 3)"
_TAPES = "SELECT asset_id, frame_idx, t, " + ", ".join(f"CAST(CASE WHEN {_BAR} THEN {ten} WHEN asset_id % 5 = 1 THEN {eight} ELSE {c} END AS DOUBLE) AS {c}" for c, (ten, eight) in _TAPE.items()) + " FROM frames"


def _whole_sql(bits: int) -> str:
    k = V.WHOLE_BARS[bits]
    met = " AND ".join(f"{c} {'<=' if c == 'TOUT' else '>' if c in ('YMAX', 'SATMAX') else '<'} {x}" for c, x in k.items())
    return f"WITH {FRAMES}, tapes AS ({_TAPES}) SELECT asset_id, max(t) AS end_s FROM tapes GROUP BY asset_id HAVING count(*) FILTER (WHERE {met}) * 100.0 / count(*) >= 95"


def _tapes(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_TAPES.replace("FROM frames", "FROM {frames}"), frames=frames(spark, d))


@_query("F5_whole_video_bars", _whole_sql(10))
def _(spark, d):
    return V.whole_video_bars(_tapes(spark, d))


@_query("F5_whole_video_bars_8bit", _whole_sql(8))
def _(spark, d):
    return V.whole_video_bars(_tapes(spark, d), bit_depth=8)


_DETECT = f"""own AS (SELECT asset_id, frame_idx, t, {_BARS} AS ok FROM frames WHERE t BETWEEN 0 AND 300),
grp AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY asset_id, ok ORDER BY frame_idx) AS g FROM own),
runs AS (SELECT asset_id, ok, g, count(*) AS n, min(t) AS first, max(t) AS last FROM grp GROUP BY ALL),
heads AS (SELECT asset_id, min(first) AS start_s FROM runs WHERE ok AND n >= 30 GROUP BY asset_id),
ends AS (SELECT h.asset_id, h.start_s, (SELECT min(r.first) FROM runs r WHERE r.asset_id = h.asset_id AND NOT r.ok AND r.n >= 15 AND r.first - h.start_s > 2) AS closed_s FROM heads h),
detected AS (SELECT e.asset_id, e.start_s, max(o.t) AS end_s, e.closed_s FROM ends e JOIN own o ON o.asset_id = e.asset_id AND o.ok AND o.t >= e.start_s AND (e.closed_s IS NULL OR o.t < e.closed_s) GROUP BY ALL)"""


@_query("W2_detect_bars", f"WITH {FRAMES}, {_DETECT} SELECT asset_id, start_s, end_s, closed_s FROM detected")
def _(spark, d):
    return V.detect_bars(frames(spark, d))


@_query("A2_bars_extremes", f"WITH {FRAMES}, {_DETECT} SELECT d.asset_id, 'head' AS label, " + ", ".join(f"{'greatest(0, ' if k.endswith('MAX') else 'least(1023, '}CAST({'max' if k.endswith('MAX') else 'min'}(f.{k}) AS INT)) AS {k}" for k in V.SMPTE) + " FROM detected d JOIN frames f ON f.asset_id = d.asset_id AND f.t BETWEEN d.start_s AND d.end_s GROUP BY d.asset_id")
def _(spark, d):
    own = _kept(frames(spark, d), {*V.SMPTE, "YDIF"})
    return V.bars_extremes(own, V.detect_bars(own).withColumn("label", F.lit("head")))


@_query("A3_bars_vs_reference", f"WITH {FRAMES}, {_DETECT}, x AS (SELECT d.asset_id, " + ", ".join(f"{'greatest(0, ' if k.endswith('MAX') else 'least(1023, '}CAST({'max' if k.endswith('MAX') else 'min'}(f.{k}) AS INT)) AS {k}" for k in V.SMPTE) + " FROM detected d JOIN frames f ON f.asset_id = d.asset_id AND f.t BETWEEN d.start_s AND d.end_s GROUP BY d.asset_id), a AS (SELECT DISTINCT asset_id FROM frames) " + " UNION ALL ".join(f"SELECT a.asset_id, '{k}' AS tag, CAST({e} AS DOUBLE) AS expected, coalesce(CAST(x.{k} AS DOUBLE), {e}) AS detected FROM a LEFT JOIN x ON x.asset_id = a.asset_id" for k, e in {"YMAX": 940.0, "YMIN": 28.0, "UMIN": 148.0, "UMAX": 876.0, "VMIN": 124.0, "VMAX": 867.0, "SATMIN": 0.0, "SATMAX": 405.0}.items()))
def _(spark, d):
    own = _kept(frames(spark, d), {*V.SMPTE, "YDIF"})
    return V.bars_vs_reference(own.select("asset_id").distinct(), V.bars_extremes(own, V.detect_bars(own).withColumn("label", F.lit("head"))))


_LIMITS = {"YMIN": (12.0, "floor"), "YMAX": (990.0, "ceiling"), "UMIN": (51.0, "floor"), "UMAX": (940.0, "ceiling"), "VMIN": (60.0, "floor"), "VMAX": (913.0, "ceiling")}


def _clamped(k: str, level: float, side: str) -> str:
    x, beyond = ("min", f"{k} < {level - 1}") if side == "floor" else ("max", f"{k} > {level + 1}")
    return f"""SELECT asset_id, '{k}' AS metric, {x}({k}) AS extreme, count(*) FILTER (WHERE abs({k} - {level}) <= 1) AS hits, {_r(f'count(*) FILTER (WHERE abs({k} - {level}) <= 1) * 100.0 / count(*)')}::DOUBLE AS hit_pct, count(*) FILTER (WHERE {beyond}) AS beyond,
CASE WHEN count(*) FILTER (WHERE {beyond}) > 0 THEN 'Not Clamped' WHEN count(*) FILTER (WHERE abs({k} - {level}) <= 1) >= 10 AND count(*) FILTER (WHERE abs({k} - {level}) <= 1) * 100.0 / count(*) >= 1 THEN 'Clamped' ELSE 'Inconclusive' END AS verdict FROM frames GROUP BY asset_id"""


@_query("A4_clamped_levels", f"WITH {FRAMES} " + " UNION ALL ".join(_clamped(k, *v) for k, v in _LIMITS.items()))
def _(spark, d):
    return V.clamped_levels(frames(spark, d), _LIMITS)


@_query("A9_bit_depth", f"WITH {FRAMES} SELECT asset_id, CASE WHEN arg_min(greatest(UAVG, VAVG), frame_idx) > 300 OR max(CASE WHEN frame_idx <= 100 THEN coalesce(YMAX, 255) END) > 250 THEN 10 ELSE 8 END AS bits FROM frames GROUP BY asset_id")
def _(spark, d):
    return V.bit_depth(frames(spark, d))


_ENVELOPE = "(UMIN < 100 AND VMIN < 100 AND UMAX > 900 AND VMAX > 900)"


@_query("F7_chroma_flags", f"WITH {FRAMES} SELECT asset_id, count(*) FILTER (WHERE {_ENVELOPE}) AS envelope, count(*) FILTER (WHERE SATMAX > 600) AS saturation FROM frames GROUP BY asset_id")
def _(spark, d):
    return frames(spark, d).groupBy("asset_id").agg(*[F.count_if(x).alias(k) for k, x in V.chroma_flags().items()])


_CHROMA = f"""flagged AS (SELECT asset_id, frame_idx, t, SATMAX, HUEMED, {_ENVELOPE} AS envelope, SATMAX > 600 AS saturation FROM frames WHERE {_ENVELOPE} OR SATMAX > 600),
cut AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY asset_id ORDER BY frame_idx) <= 10 THEN 0 ELSE 1 END AS c FROM flagged),
isl AS (SELECT *, sum(c) OVER (PARTITION BY asset_id ORDER BY frame_idx) AS g FROM cut),
chroma AS (SELECT asset_id, min(t) AS start_s, max(t) AS end_s, max(t) - min(t) AS duration_s, count(*) AS frame_count,
 CASE WHEN bool_or(envelope) AND bool_or(saturation) THEN 'envelope+saturation' WHEN bool_or(envelope) THEN 'envelope' ELSE 'saturation' END AS rules, max(SATMAX) AS peak_satmax,
 arg_min(t, (-SATMAX, frame_idx)) AS peak_s, arg_min(HUEMED, (-SATMAX, frame_idx)) AS peak_hue FROM isl GROUP BY asset_id, g HAVING count(*) >= 2 OR bool_or(envelope AND saturation))"""


@_query("W6_chroma_events", f"WITH {FRAMES}, {_CHROMA} SELECT * FROM chroma")
def _(spark, d):
    return V.chroma_events(frames(spark, d))


@_query("T2_top_events", f"WITH {FRAMES}, {_CHROMA}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY frame_count DESC, start_s) AS INT) AS rank FROM chroma) SELECT * FROM ranked WHERE rank <= 10")
def _(spark, d):
    return V.top_events(V.chroma_events(frames(spark, d)))


_SEGMENTS = f"""b AS (SELECT asset_id, frame_idx, t, {_BLACK} AS black FROM frames),
lastb AS (SELECT *, max(CASE WHEN black THEN t END) OVER (PARTITION BY asset_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM b),
cutb AS (SELECT *, sum(CASE WHEN NOT black AND t - last > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY frame_idx) AS g FROM lastb),
segments AS (SELECT asset_id, min(t) AS start_s, max(t) AS end_s, count(*) AS frames FROM cutb WHERE black GROUP BY asset_id, g HAVING max(t) - min(t) >= 2)"""


@_query("W4_black_segments", f"WITH {FRAMES}, {_SEGMENTS} SELECT * FROM segments")
def _(spark, d):
    return V.black_segments(frames(spark, d))


_LOW = "coalesce(YDIF < 1 AND coalesce(UDIF, 0) < 1 AND coalesce(VDIF, 0) < 1 AND YMAX - YMIN >= 8, false)"
_FREEZES = f"""lowf AS (SELECT *, {_LOW} AS low FROM frames), grpf AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY asset_id, low ORDER BY frame_idx) AS g FROM lowf),
freezes AS (SELECT asset_id, min(t) AS start_s, max(t) AS end_s, count(*) AS duplicates, count(*) + 1 AS frozen, {_r('avg(YDIF)')} AS avg_ydif, max(YDIF) AS max_ydif, {_r('avg(UDIF)')} AS avg_udif, {_r('avg(VDIF)')} AS avg_vdif FROM grpf WHERE low GROUP BY asset_id, g HAVING count(*) >= 2)"""


@_query("F8_low_diff_frames", f"WITH {FRAMES} SELECT asset_id, count(*) FILTER (WHERE {_LOW}) AS n FROM frames GROUP BY asset_id")
def _(spark, d):
    return frames(spark, d).groupBy("asset_id").agg(F.count_if(V.low_diff_frame()).alias("n"))


@_query("W5_freeze_candidates", f"WITH {FRAMES}, {_FREEZES} SELECT * FROM freezes")
def _(spark, d):
    return V.freeze_candidates(frames(spark, d))


@_query("A15_freeze_summary", f"WITH {FRAMES}, {_FREEZES}, one AS (SELECT asset_id, count(*) AS runs, CAST(sum(duplicates) AS BIGINT) AS duplicates FROM freezes GROUP BY asset_id) SELECT a.asset_id, coalesce(runs, 0) AS runs, coalesce(duplicates, 0) AS duplicates, {_r('coalesce(duplicates, 0) / (30000.0::DOUBLE / 1001)')} AS loss_s, CASE WHEN coalesce(runs, 0) = 0 THEN 'clean' WHEN runs >= 5 OR duplicates >= 10 THEN 'critical' ELSE 'warning' END AS status FROM (SELECT DISTINCT asset_id FROM frames) a LEFT JOIN one USING (asset_id)")
def _(spark, d):
    own = frames(spark, d)
    return V.freeze_summary(V.freeze_candidates(own), own.select("asset_id").distinct())


@_query("J6_exclude_regions", f"WITH {FRAMES}, {_SEGMENTS} SELECT f.asset_id, f.frame_idx FROM frames f WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.asset_id = f.asset_id AND f.t BETWEEN s.start_s AND s.end_s)")
def _(spark, d):
    own = _kept(frames(spark, d), {"YMAX", "YHIGH", "YLOW", "YMIN"})
    return I.exclude_regions(own, V.black_segments(own)).select("asset_id", "frame_idx")


@_query("W20_downsample_trace", f"WITH {FRAMES}, n AS (SELECT asset_id, t, YMAX AS value, row_number() OVER (PARTITION BY asset_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY asset_id) AS total FROM frames WHERE YMAX IS NOT NULL), b AS (SELECT *, CAST(floor(i / ceil(total / 50.0)) AS BIGINT) AS bucket FROM n) SELECT asset_id, bucket, arg_min(t, (-value, i)) AS t, max(value) AS value FROM b GROUP BY asset_id, bucket")
def _(spark, d):
    return V.downsample_trace(frames(spark, d), "YMAX", 50)


@_query("P24_luma_zones", f"WITH {FRAMES}, z AS (SELECT asset_id, count(*) FILTER (WHERE YAVG - 280 < 64) AS a, count(*) FILTER (WHERE YAVG - 280 >= 64 AND YAVG - 280 < 192) AS b, count(*) FILTER (WHERE YAVG - 280 >= 192) AS c FROM frames WHERE asset_id % 4 <> 3 OR YAVG >= 380 GROUP BY asset_id) SELECT asset_id, round(a / greatest(1, a + b + c), 6) AS subblack_ratio, round(b / greatest(1, a + b + c), 6) AS midtone_ratio, round(c / greatest(1, a + b + c), 6) AS highlight_ratio, CASE WHEN a >= b AND a >= c THEN 'subblack' WHEN b >= c THEN 'midtones' ELSE 'highlights' END AS primary_zone FROM z")
def _(spark, d):
    return V.luma_zones(frames(spark, d).where("asset_id % 4 != 3 or YAVG >= 380").select("asset_id", (F.col("YAVG") - 280).alias("y")))


_HUE_SQL = "CASE " + " ".join(f"WHEN HUEMED % 360 < {k} THEN '{h}'" for k, h in ((15, "red"), (45, "orange"), (75, "yellow"), (105, "yellow-green"), (135, "green"), (165, "green-cyan"), (195, "cyan"), (225, "blue-cyan"), (255, "blue"), (285, "blue-magenta"), (315, "magenta"), (345, "red-magenta"), (360, "red"))) + " ELSE '' END"


@_query("P9_hue_label", f"WITH {FRAMES} SELECT asset_id, {_HUE_SQL} AS hue, count(*) AS n FROM frames GROUP BY ALL")
def _(spark, d):
    return frames(spark, d).select("asset_id", P.hue_label("HUEMED").alias("hue")).groupBy("asset_id", "hue").agg(F.count("*").alias("n"))


@_query("P3_seconds_to_hms4", f"WITH {FRAMES} SELECT asset_id, frame_idx, printf('%02d:%02d:%02d.%04d', CAST(floor(t * 37) AS BIGINT) // 3600, CAST(floor(t * 37) AS BIGINT) // 60 % 60, CAST(floor(t * 37) AS BIGINT) % 60, CAST(round((t * 37 - floor(t * 37)) * 10000) AS BIGINT)) AS hms FROM frames")
def _(spark, d):
    return frames(spark, d).select("asset_id", "frame_idx", P.seconds_to_hms4(F.col("t") * 37).alias("hms"))


@_query("P4_seconds_to_timecode", f"WITH {FRAMES}, n AS (SELECT asset_id, frame_idx, CAST(frame_idx * 25 AS BIGINT) AS f FROM frames) SELECT asset_id, frame_idx, printf('%02d:%02d:%02d:%02d', f // 90000 % 24, f // 1500 % 60, f // 25 % 60, f % 25) AS tc FROM n")
def _(spark, d):
    return frames(spark, d).select("asset_id", "frame_idx", P.seconds_to_timecode(F.col("t") * 8, 25.0).alias("tc"))


# --- Broadcast range -----------------------------------------------------------------------------------------------------------------

_PERIODS = "periods AS (SELECT DISTINCT asset_id, p AS period_no, CAST(5 + 20 * p AS DOUBLE) AS start_s, CAST(15 AS DOUBLE) AS duration_s FROM frames, (VALUES (0), (1), (2)) v(p))"


def _periods(own: DataFrame, gap: float = 20.0, first: float = 5.0) -> DataFrame:
    numbered = own.select("asset_id").distinct().withColumn("period_no", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return numbered.select("asset_id", "period_no", (F.lit(first) + gap * F.col("period_no")).alias("start_s"), F.lit(15.0).alias("duration_s"))


@_query("T1_top_violations", f"WITH {FRAMES}, v AS ({_BRNG}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, frame_idx) AS INT) AS rank FROM v) SELECT * FROM r WHERE rank <= 10")
def _(spark, d):
    return B.top_violations(B.brng_violations(frames(spark, d)))


_HISTOGRAM = f"v AS ({_BRNG}), f0 AS (SELECT asset_id, min(t) AS first FROM v GROUP BY asset_id), bins AS (SELECT asset_id, CAST(floor((t - first) / 10) AS BIGINT) AS bin, first + floor((t - first) / 10) * 10 AS start_s, count(*) AS n FROM v JOIN f0 USING (asset_id) GROUP BY ALL)"


@_query("A21_violation_histogram", f"WITH {FRAMES}, {_HISTOGRAM} SELECT * FROM bins")
def _(spark, d):
    return B.violation_histogram(B.brng_violations(frames(spark, d)))


def _greedy(k: str, near: str) -> str:
    """The first k of the list rows that stand apart from all chosen before."""
    return f"list_reduce(list_transform(rows, lambda x: [x]), lambda acc, e: CASE WHEN len(acc) < {k} AND len(list_filter(acc, lambda c: {near})) = 0 THEN list_concat(acc, e) ELSE acc END)"


_BINS = f"v AS ({_BRNG}), f AS (SELECT asset_id, min(t) AS first FROM v GROUP BY asset_id), b AS (SELECT asset_id, first + floor((t - first) / 10) * 10 AS start_s, count(*) AS n FROM v JOIN f USING (asset_id) GROUP BY ALL), l AS (SELECT asset_id, list({{'start_s': start_s, 'n': n}} ORDER BY n DESC, start_s) AS rows FROM b GROUP BY asset_id)"


@_query("T5_suggest_periods", f"WITH {FRAMES}, {_BINS}, g AS (SELECT asset_id, {_greedy('3', 'abs(c.start_s - e[1].start_s) <= 20')} AS c FROM l) SELECT asset_id, i.i AS rank, c[i.i].start_s AS start_s, c[i.i].n AS n FROM g, unnest(range(1, len(c) + 1)) AS i(i)")
def _(spark, d):
    return B.suggest_periods(B.brng_violations(frames(spark, d)), length_s=20.0)


_KINDED = f"v AS (SELECT *, ['content', 'border', 'other'][frame_idx % 3 + 1] AS kind, [0, 2, 1][frame_idx % 3 + 1] AS priority FROM ({_BRNG})), l AS (SELECT asset_id, list({{'frame_idx': frame_idx, 't': t, 'score': score, 'pct': pct, 'kind': kind, 'priority': priority}} ORDER BY priority, score DESC, frame_idx) AS rows FROM v GROUP BY asset_id)"
_ROWS = "asset_id, i.i AS rank, " + ", ".join(f"all_of[i.i].{c} AS {c}" for c in ("frame_idx", "t", "score", "pct", "kind", "priority"))


@_query("T3_diverse_top_k", f"WITH {FRAMES}, {_KINDED}, g AS (SELECT asset_id, rows, {_greedy('5', 'abs(c.t - e[1].t) < 10')} AS c FROM l), h AS (SELECT asset_id, list_concat(c, list_filter(rows, lambda x: NOT list_contains(c, x))[1:5 - len(c)]) AS all_of FROM g) SELECT {_ROWS} FROM h, unnest(range(1, len(all_of) + 1)) AS i(i)")
def _(spark, d):
    kind = F.element_at(F.array(F.lit("content"), F.lit("border"), F.lit("other")), (F.col("frame_idx") % 3 + 1).cast("int"))
    return B.diverse_top_k(B.brng_violations(frames(spark, d)).withColumn("kind", kind))


_FAILED = f"v AS ({_VIOLATIONS}), l AS (SELECT asset_id, tag, list({{'frame_idx': frame_idx, 't': t, 'value': value, 'threshold': threshold, 'off': abs(value - threshold)}} ORDER BY abs(value - threshold) DESC, frame_idx) AS rows FROM v GROUP BY asset_id, tag)"
_PICKED = "asset_id, tag, i.i AS rank, " + ", ".join(f"c[i.i].{c} AS {c}" for c in ("frame_idx", "t", "value", "threshold", "off"))


@_query("T4_failure_highlights", f"WITH {FRAMES}, {_FAILED}, g AS (SELECT asset_id, tag, {_greedy('5', 'abs(c.t - e[1].t) < 4')} AS c, count(*) OVER (PARTITION BY asset_id) AS tags FROM l) SELECT {_PICKED} FROM g, unnest(range(1, CASE WHEN tags <= 2 THEN len(c) ELSE least(3, len(c)) END + 1)) AS i(i)")
def _(spark, d):
    return B.failure_highlights(V.threshold_violations(frames(spark, d), THRESHOLDS))


@_query("J11_assign_period", f"WITH {FRAMES}, {_PERIODS}, v AS ({_BRNG}) SELECT v.asset_id, v.frame_idx, v.t, min(p.period_no) AS period_no FROM v LEFT JOIN periods p ON p.asset_id = v.asset_id AND p.start_s <= v.t AND v.t < p.start_s + p.duration_s GROUP BY ALL")
def _(spark, d):
    own = frames(spark, d)
    return I.assign_period(B.brng_violations(own).select("asset_id", "frame_idx", "t"), _periods(own))


_SUMMARY = f"summary AS (SELECT p.asset_id, p.period_no, count(*) AS frames, count(*) FILTER (WHERE BRNG > 0.01) AS violations, {_r('count(*) FILTER (WHERE BRNG > 0.01) * 100.0 / count(*)')}::DOUBLE AS pct, max(BRNG) AS max_brng, round(avg(BRNG), 9) AS avg_brng FROM frames f JOIN periods p ON f.asset_id = p.asset_id AND f.t >= p.start_s AND f.t < p.start_s + p.duration_s GROUP BY ALL)"


@_query("A10_brng_period_summary", f"WITH {FRAMES}, {_PERIODS}, {_SUMMARY} SELECT asset_id, period_no, frames, violations, pct, max_brng, round(avg_brng, 6) AS avg_brng FROM summary")
def _(spark, d):
    own = frames(spark, d)
    return B.brng_period_summary(own, _periods(own)).withColumn("avg_brng", F.round("avg_brng", 6))


@_query("J17_period_overlap", f"WITH {FRAMES}, {_PERIODS}, q AS (SELECT asset_id, period_no, start_s * 2 AS start_s, duration_s FROM periods) SELECT p.asset_id, p.period_no AS period_p, q.period_no AS period_q, least(p.start_s + p.duration_s, q.start_s + q.duration_s) - greatest(p.start_s, q.start_s) AS overlap_s FROM periods p JOIN q ON p.asset_id = q.asset_id AND least(p.start_s + p.duration_s, q.start_s + q.duration_s) > greatest(p.start_s, q.start_s)")
def _(spark, d):
    own = frames(spark, d)
    return I.period_overlap(_periods(own), _periods(own, 40.0, 10.0))


_VALIDATED = "SELECT p.asset_id, p.period_no, p.start_s, p.duration_s, sum(CASE WHEN s.asset_id IS NULL THEN 0 ELSE least(p.start_s + p.duration_s, s.end_s) - greatest(p.start_s, s.start_s) END) AS black_s FROM periods p LEFT JOIN segments s ON s.asset_id = p.asset_id AND least(p.start_s + p.duration_s, s.end_s) > greatest(p.start_s, s.start_s) GROUP BY ALL"


@_query("T7_validate_periods", f"WITH {FRAMES}, {_PERIODS}, {_SEGMENTS}, o AS ({_VALIDATED}) SELECT *, black_s <= 0.25 * duration_s AS valid FROM o")
def _(spark, d):
    own = frames(spark, d)
    return B.validate_periods(_periods(own), V.black_segments(own))


@_query("T8_shift_periods")
def _(spark, d):
    own = frames(spark, d)
    assets = own.groupBy("asset_id").agg((F.max("t") + 10).alias("duration_s"), F.lit(2.0).alias("first_s"))
    return B.shift_periods(_periods(own), V.black_segments(own), assets)


_EVEN = "e AS (SELECT asset_id, max(t) AS len, CAST(asset_id % 3 * 4 AS DOUBLE) AS content, CASE WHEN asset_id % 2 = 0 THEN 10.0 END AS bars FROM frames GROUP BY asset_id), f AS (SELECT asset_id, greatest(content, coalesce(bars, 0)) + 10 AS first, CASE WHEN asset_id % 5 = 1 THEN 55 WHEN asset_id % 5 = 2 THEN 75 ELSE len END - 30 AS last FROM e), g AS (SELECT *, last - first AS room, CASE WHEN last - first >= 36 THEN 3 WHEN last - first >= 12 THEN CAST(least(3, floor((last - first) / 12)) AS INT) ELSE 1 END AS n FROM f WHERE last > first), even AS (SELECT asset_id, CAST(unnest(range(n)) AS INT) AS period_no, first, room, n FROM g), spaced AS (SELECT asset_id, period_no, first + period_no * greatest(0, room - 12) / greatest(1, n - 1) AS start_s, least(12, room) AS duration_s FROM even)"


def _even_assets(spark: SparkSession, d: str) -> DataFrame:
    length = F.when(F.col("asset_id") % 5 == 1, 55.0).when(F.col("asset_id") % 5 == 2, 75.0).otherwise(F.max("t"))
    own = frames(spark, d).groupBy("asset_id").agg(F.max("t").alias("m"), length.alias("duration_s"))
    return own.select("asset_id", "duration_s", (F.col("asset_id") % 3 * 4.0).alias("content_start_s"), F.when(F.col("asset_id") % 2 == 0, 10.0).alias("bars_end_s"))


@_query("T6_even_periods", f"WITH {FRAMES}, {_EVEN} SELECT * FROM spaced")
def _(spark, d):
    return I.even_periods(_even_assets(spark, d), 3, 12.0)


@_query("T6_hinted_periods", f"WITH {FRAMES}, {_EVEN}, h AS (SELECT DISTINCT asset_id, r AS rank, CAST(8 + (r * 7 + asset_id) % 11 * 5 AS DOUBLE) AS t FROM frames, (VALUES (1), (2), (3), (4), (5)) v(r)), near AS (SELECT h.asset_id, greatest(g.first, h.t - 6) AS start_s, g.last, row_number() OVER (PARTITION BY h.asset_id ORDER BY rank) AS r FROM h JOIN g USING (asset_id) WHERE h.t >= g.first), good AS (SELECT *, count(*) OVER (PARTITION BY asset_id) AS k FROM near WHERE r <= 3 AND start_s + 12 <= last) SELECT asset_id, CAST(r - 1 AS INT) AS period_no, start_s, CAST(12 AS DOUBLE) AS duration_s FROM good WHERE k = 3 UNION ALL SELECT * FROM spaced WHERE asset_id NOT IN (SELECT asset_id FROM good WHERE k = 3)")
def _(spark, d):
    own = _even_assets(spark, d)
    hints = own.select("asset_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).withColumn("t", 8 + (F.col("rank") * 7 + F.col("asset_id")) % 11 * 5.0)
    return I.even_periods(own, 3, 12.0, hints=hints)


@_query("T10_sample_evenly", f"WITH {FRAMES}, l AS (SELECT asset_id, max(frame_idx) AS last FROM frames GROUP BY asset_id), p AS (SELECT DISTINCT asset_id, CAST(floor(k * last / 19) AS BIGINT) AS frame_idx FROM l, (SELECT unnest(range(20)) AS k)) SELECT asset_id, frame_idx, f.t FROM p JOIN frames f USING (asset_id, frame_idx)")
def _(spark, d):
    return B.sample_evenly(frames(spark, d), 20)


@_query("T10_sample_targeted")
def _(spark, d):
    own = frames(spark, d)
    segments = _periods(own).where("asset_id % 9 != 4 or period_no < 2").select("asset_id", "period_no", "start_s", (F.col("start_s") + F.col("duration_s")).alias("end_s"), F.lit(360).alias("total_frames"), F.lit(24.0).alias("fps"))
    return B.sample_targeted(segments, B.brng_violations(own).where("asset_id % 4 != 3"), first=100, least=20, fill=25, most=40)


_SIDE_FLAGS = {
    "l": "k = 2 AND f % 2 = 0 OR k = 3 AND f % 3 <> 0 OR k = 4 AND f % 10 = 0 OR k = 5 AND f % 9 = 0 OR k = 6 AND f % 5 = 0",
    "u": "k = 3 AND f % 6 = 1 OR k = 4 AND f % 10 = 5",
    "c": "k = 1 AND f % 5 = 0 OR k = 2 AND f % 20 = 0 OR k = 4 AND f % 8 = 0",
    "n": "k = 0 AND f % 4 = 0",
}
_SCALED = "pct / CASE asset_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 100 END"
_MARK = "asset_id, frame_idx, " + _SCALED + " AS pct, " + ", ".join(f"({x}) AS {c}" for c, x in _SIDE_FLAGS.items()) + ", CAST(CASE WHEN k = 5 THEN 30 + f % 30 WHEN k = 6 AND f % 2 = 0 THEN 12 END AS DOUBLE) AS s"
_MARKED = f"v AS ({_BRNG}), kept AS (SELECT *, asset_id % 7 AS k, frame_idx AS f FROM v), marked AS (SELECT {_MARK} FROM kept)"
_SIDE_SQL = ", ".join(f"{x} AS {s}_pct, {y} AS {s}_score, CASE WHEN {x} > 50 THEN 10 WHEN {x} > 20 THEN 5 ELSE 0 END AS {s}_px" for s, x, y in (("left", "100.0 * count(*) FILTER (WHERE l) / count(*)", "avg(s)"), ("right", "0.0::DOUBLE", "NULL::DOUBLE"), ("top", "100.0 * count(*) FILTER (WHERE u) / count(*)", "NULL::DOUBLE"), ("bottom", "0.0::DOUBLE", "NULL::DOUBLE")))
_PATTERNS = f"""sides AS (SELECT asset_id, count(*) AS n, 100.0 * count(*) FILTER (WHERE l OR u) / count(*) AS edge_pct, 100.0 * count(*) FILTER (WHERE c) / count(*) AS continuous_pct, 100.0 * count(*) FILTER (WHERE n) / count(*) AS linear_pct, {_SIDE_SQL}, CAST(bool_or(l) AS INT) + CAST(bool_or(u) AS INT) AS n_edges FROM marked GROUP BY asset_id),
patterns AS (SELECT *, linear_pct > 20 OR continuous_pct > 15 OR edge_pct > 30 AND continuous_pct > 0 OR edge_pct > 60 AND continuous_pct = 0 OR continuous_pct > 10 AND n_edges >= 2 OR coalesce(left_score, 0) > 40 AS adjust FROM sides)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    own = B.brng_violations(frames(spark, d)).selectExpr("*", "asset_id % 7 AS k", "frame_idx AS f").selectExpr(*[f"({x}) AS {c}" for c, x in _SIDE_FLAGS.items()], "asset_id", "frame_idx", f"{_SCALED} AS pct", "CAST(CASE WHEN k = 5 THEN 30 + f % 30 WHEN k = 6 AND f % 2 = 0 THEN 12 END AS DOUBLE) AS s")
    edges = F.array_compact(F.array(F.when(F.col("l"), "left"), F.when(F.col("u"), "top")))
    return own.select("asset_id", "frame_idx", "pct", edges.alias("edges"), F.col("c").alias("continuous"), F.col("n").alias("linear"), F.when(F.col("s").isNotNull(), F.create_map(F.lit("left"), "s")).alias("scores"))


@_query("A14_violation_assessment", f"""WITH {FRAMES}, {_MARKED}, {_PATTERNS}, o AS (SELECT asset_id, avg(pct) AS avg_pct, max(pct) AS max_pct FROM marked GROUP BY asset_id)
SELECT asset_id, n, avg_pct, max_pct, edge_pct, linear_pct, concat_ws('; ', CASE WHEN avg_pct >= 1 THEN printf('Average BRNG: %.2f%%', avg_pct) WHEN avg_pct >= 0.1 THEN printf('Average BRNG: %.2f%% (low-level)', avg_pct) ELSE printf('Average BRNG: %.3f%% (minimal)', avg_pct) END,
 CASE WHEN edge_pct > 70 THEN printf('%.0f%% of violations at frame edges', edge_pct) WHEN edge_pct > 40 THEN printf('%.0f%% edge violations, %.0f%% content area', edge_pct, 100 - edge_pct) WHEN edge_pct > 0 THEN printf('Violations primarily in content area (%.0f%%)', 100 - edge_pct) END,
 CASE WHEN linear_pct > 20 THEN printf('linear blanking patterns detected (%.0f%%)', linear_pct) END) AS assessment FROM o JOIN patterns USING (asset_id)""")
def _(spark, d):
    own = _marked(spark, d)
    return B.violation_assessment(own, B.violation_patterns(own))


@_query("A12_violation_patterns", f"WITH {FRAMES}, {_MARKED}, {_PATTERNS} SELECT * FROM patterns")
def _(spark, d):
    return B.violation_patterns(_marked(spark, d))


# --- Interval algebra ----------------------------------------------------------------------------------------------------------------

_MERGED = """o AS (SELECT *, max(end_s) OVER (PARTITION BY asset_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
c AS (SELECT *, sum(CASE WHEN start_s - before <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM o),
merged AS (SELECT asset_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_spans FROM c GROUP BY asset_id, g)"""
_SPANS = "spans AS (SELECT DISTINCT o_custkey % 50 AS asset_id, CAST(o_orderkey % 1000 AS DOUBLE) AS start_s, CAST(o_orderkey % 1000 + o_orderkey % 7 AS DOUBLE) AS end_s FROM orders)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("asset_id"), (F.col("o_orderkey") % 1000).cast("double").alias("start_s"), (F.col("o_orderkey") % 1000 + F.col("o_orderkey") % 7).cast("double").alias("end_s")).distinct()


@_query("W19_merge_spans", f"WITH {_SPANS}, {_MERGED} SELECT * FROM merged")
def _(spark, d):
    return I.merge_spans(_spans(spark, d), 5.0)


@_query("A18_coverage_fraction", f"WITH {_SPANS}, {_MERGED.replace('<= 5', '<= 0')}, t AS (SELECT asset_id, sum(end_s - start_s) AS covered_s FROM merged GROUP BY asset_id) SELECT asset_id, covered_s, covered_s / 1007.0::DOUBLE AS fraction FROM t")
def _(spark, d):
    own = _spans(spark, d)
    return I.coverage_fraction(own, own.select("asset_id").distinct().withColumn("duration_s", F.lit(1007.0)))


_TWO = "a AS (SELECT * FROM spans WHERE end_s - start_s >= 4), b AS (SELECT * FROM spans WHERE end_s - start_s = 1)"


@_query("J9_spans_overlap", f"WITH {_SPANS}, {_TWO} SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.asset_id = b.asset_id AND a.start_s <= b.end_s + 1 AND b.start_s <= a.end_s + 1)")
def _(spark, d):
    own = _spans(spark, d)
    return I.spans_overlap(own.where("end_s - start_s >= 4"), own.where("end_s - start_s = 1"), 1.0)


@_query("J10_overlapping_methods", f"WITH {_SPANS}, {_TWO} SELECT b.* FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.asset_id = b.asset_id AND a.start_s <= b.end_s AND b.start_s <= a.end_s) OR NOT EXISTS (SELECT 1 FROM a WHERE a.asset_id = b.asset_id)")
def _(spark, d):
    own = _spans(spark, d)
    return I.overlapping_methods(own.where("end_s - start_s >= 4"), own.where("end_s - start_s = 1"))


@_query("J15_bars_agreement", f"WITH {_SPANS}, a AS (SELECT asset_id, max(end_s) AS a FROM spans WHERE asset_id % 3 <> 0 GROUP BY asset_id), b AS (SELECT asset_id, max(start_s) AS b FROM spans WHERE asset_id % 5 <> 0 GROUP BY asset_id) SELECT asset_id, CASE WHEN a IS NULL THEN 'second only' WHEN b IS NULL THEN 'first only' WHEN abs(a - b) <= 1 THEN 'agree' ELSE 'differ' END AS verdict FROM a FULL JOIN b USING (asset_id)")
def _(spark, d):
    own = _spans(spark, d)
    return V.bars_agreement(own.where("asset_id % 3 != 0").groupBy("asset_id").agg(F.max("end_s").alias("end_s")), own.where("asset_id % 5 != 0").groupBy("asset_id").agg(F.max("start_s").alias("end_s")))


# --- Audio ---------------------------------------------------------------------------------------------------------------------------


@_query("A5_clipping_summary", f"WITH {CHANNELS} SELECT asset_id, count(*) AS total, count(*) FILTER (WHERE peak_level >= -0.5) AS clipped, {_r('count(*) FILTER (WHERE peak_level >= -0.5) * 100.0 / count(*)')}::DOUBLE AS pct, max(peak_level) AS max_peak, max(flat_factor) AS max_flat FROM channels GROUP BY asset_id")
def _(spark, d):
    return A.clipping_summary(channels(spark, d))


_MEANS = "o AS (SELECT asset_id, ch, rms_level, row_number() OVER (PARTITION BY asset_id, ch ORDER BY frame_idx) AS i FROM channels WHERE rms_level IS NOT NULL), n AS (SELECT asset_id, min(m) AS n FROM (SELECT asset_id, ch, max(i) AS m FROM o GROUP BY ALL) GROUP BY asset_id), means AS (SELECT asset_id, ch, avg(rms_level) AS mean_rms FROM o JOIN n USING (asset_id) WHERE i <= n GROUP BY ALL)"


@_query("J12_channel_pairs", f"WITH {CHANNELS}, {_MEANS}, p AS (SELECT a.asset_id, a.ch AS ch_a, b.ch AS ch_b, a.mean_rms - b.mean_rms AS diff FROM means a JOIN means b ON a.asset_id = b.asset_id AND a.ch < b.ch) SELECT asset_id, ch_a, ch_b, {_r('abs(diff)')} AS diff_db, CASE WHEN abs(diff) < 1 THEN 'Balanced' WHEN abs(diff) < 3 THEN 'Slight imbalance' WHEN abs(diff) < 6 THEN 'Moderate imbalance' ELSE 'Significant imbalance' END AS label, CASE WHEN diff > 0 THEN ch_a WHEN diff < 0 THEN ch_b END AS louder FROM p")
def _(spark, d):
    return A.channel_pairs(A.channel_means(channels(spark, d)))


@_query("A6_channel_imbalance", f"""WITH {CHANNELS}, {_MEANS}, n2 AS (SELECT asset_id, count(*) AS channels, string_agg(CAST(ch AS VARCHAR), ',' ORDER BY ch) FILTER (WHERE mean_rms < -60) AS quiet FROM means GROUP BY asset_id), p AS (SELECT a.asset_id, a.ch AS ch_a, b.ch AS ch_b, round(abs(a.mean_rms - b.mean_rms), 6) AS diff FROM means a JOIN means b ON a.asset_id = b.asset_id AND a.ch < b.ch),
w AS (SELECT asset_id, arg_max(ch_a, (diff, -ch_a, -ch_b)) AS worst_a, arg_max(ch_b, (diff, -ch_a, -ch_b)) AS worst_b, max(diff) AS worst_db FROM p GROUP BY asset_id), l AS (SELECT *, CASE WHEN channels = 1 THEN 'Mono' WHEN worst_db < 1 THEN 'Balanced' WHEN worst_db < 3 THEN 'Slight imbalance' WHEN worst_db < 6 THEN 'Moderate imbalance' WHEN worst_db IS NOT NULL THEN 'Significant imbalance' END AS label FROM n2 LEFT JOIN w USING (asset_id))
SELECT asset_id, channels, label, worst_a, worst_b, worst_db, CASE WHEN label = 'Significant imbalance' THEN coalesce(quiet, '') ELSE '' END AS silent FROM l""")
def _(spark, d):
    return A.channel_imbalance(channels(spark, d))


def _median_sql(c: str) -> str:
    return f"(SELECT e, list(v) OVER w AS before FROM (SELECT asset_id, ch, frame_idx, asset_id * 10000000 + ch * 1000000 + frame_idx AS e, {c} AS v FROM rms WHERE {c} IS NOT NULL) WINDOW w AS (PARTITION BY asset_id, ch ORDER BY frame_idx ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"


_DROPOUTS = f"""rms AS (SELECT *, asset_id * 10000000 + ch * 1000000 + frame_idx AS e FROM channels WHERE rms_level IS NOT NULL),
m AS (SELECT r.*, CASE WHEN len(a.before) = 7 THEN list_sort(a.before)[4] END AS median_rms, CASE WHEN len(b.before) = 7 THEN list_sort(b.before)[4] END AS md, CASE WHEN len(c.before) = 7 THEN list_sort(c.before)[4] END AS rd, CASE WHEN len(z.before) = 7 THEN list_sort(z.before)[4] END AS zc
 FROM rms r JOIN {_median_sql('rms_level')} a USING (e) JOIN {_median_sql('max_difference')} b USING (e) JOIN {_median_sql('rms_difference')} c USING (e) JOIN {_median_sql('zero_crossings_rate')} z USING (e)),
candidates AS (SELECT asset_id, ch, frame_idx, t, rms_level, median_rms, CASE WHEN md > 0 AND max_difference < 0.1 * md THEN 1 ELSE 0 END AS c1, CASE WHEN rd > 0 AND rms_difference < 0.1 * rd THEN 1 ELSE 0 END AS c2, CASE WHEN zc > 0 AND zero_crossings_rate > 3 * zc THEN 1 ELSE 0 END AS c3 FROM m WHERE median_rms >= -55 AND median_rms - rms_level >= 40)"""


@_query("W7_dropout_candidates", f"WITH {CHANNELS}, {_DROPOUTS} SELECT asset_id, ch, frame_idx, t, rms_level, median_rms, c1 + c2 + c3 AS n FROM candidates")
def _(spark, d):
    return A.dropout_candidates(channels(spark, d)).withColumn("n", F.size("corroborating")).drop("corroborating")


_EVENTS = f"""{_DROPOUTS}, ev0 AS (SELECT *, sum(CASE WHEN t - before <= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id, ch ORDER BY t) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY asset_id, ch ORDER BY t) AS before FROM candidates)),
ev1 AS (SELECT asset_id, ch, min(t) AS start_s, max(t) AS end_s, min(rms_level) AS worst_rms, max(median_rms) AS median_rms, max(c1) AS c1, max(c2) AS c2, max(c3) AS c3 FROM ev0 GROUP BY asset_id, ch, g),
ev2 AS (SELECT *, c1 + c2 + c3 AS k FROM ev1 WHERE end_s - start_s <= 2 OR c1 + c2 + c3 >= 2),
events3 AS (SELECT asset_id, ch, start_s, end_s, worst_rms, median_rms, concat_ws('+', CASE WHEN c1 = 1 THEN 'Max_difference' END, CASE WHEN c2 = 1 THEN 'RMS_difference' END, CASE WHEN c3 = 1 THEN 'Zero_crossings_rate' END) AS corroborating, CASE WHEN k >= 2 THEN 'high' WHEN k = 1 THEN 'medium' ELSE 'low' END AS confidence FROM ev2 e WHERE NOT (k = 1 AND c3 = 1) OR EXISTS (SELECT 1 FROM ev2 o WHERE o.asset_id = e.asset_id AND o.ch <> e.ch AND o.c1 + o.c2 > 0 AND e.start_s <= o.end_s + 0.5 AND o.start_s <= e.end_s + 0.5))"""


@_query("W8_dropout_events", f"WITH {CHANNELS}, {_EVENTS} SELECT * FROM events3")
def _(spark, d):
    out = A.dropout_events(A.dropout_candidates(channels(spark, d)), gap=0.5)
    return out.withColumn("corroborating", F.array_join("corroborating", "+"))


@_query("J8_cross_channel_support", f"WITH {CHANNELS}, {_EVENTS} SELECT * FROM events3 e WHERE EXISTS (SELECT 1 FROM events3 o WHERE o.asset_id = e.asset_id AND o.ch <> e.ch AND (o.corroborating LIKE '%difference%') AND e.start_s <= o.end_s + 0.5 AND o.start_s <= e.end_s + 0.5)")
def _(spark, d):
    events = A.dropout_events(A.dropout_candidates(channels(spark, d)), gap=0.5)
    return I.cross_channel_support(events).withColumn("corroborating", F.array_join("corroborating", "+"))


def _windows_sql(view: str, keys: str, count: str = "floor") -> str:
    """wins: a row of `view` for each full window of 30 seconds, every half window, that it belongs to."""
    on = " AND ".join(f"s.{k} = d.{k}" for k in keys.split(", "))
    return f"""stepped AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {view}),
dts AS (SELECT {keys}, max(CASE WHEN i = 1 THEN t END) - max(CASE WHEN i = 0 THEN t END) AS d FROM stepped GROUP BY {keys}),
sized AS (SELECT s.*, greatest(1, CAST({count}(30 / CASE WHEN d.d > 0 THEN d.d ELSE 0.1 END) AS INT)) AS size FROM stepped s JOIN dts d ON {on}),
opened AS (SELECT *, unnest(range(0, n - size + 1, greatest(1, size // 2))) AS a FROM sized),
wins AS (SELECT *, CAST(a // greatest(1, size // 2) AS INT) AS win FROM opened WHERE i >= a AND i < a + size)"""


@_query("W9_hopping_windows", f"WITH {TIMECODE}, {_windows_sql('timecode', 'asset_id, ch')} SELECT asset_id, ch, win, count(*) AS n FROM wins GROUP BY ALL")
def _(spark, d):
    return A.hopping_windows(timecode(spark, d), ["asset_id", "ch"]).groupBy("asset_id", "ch", "win").agg(F.count("*").alias("n"))


_ASTATS = f"""{TIMECODE}, {_windows_sql('timecode', 'asset_id, ch', 'round_even0')},
stats AS (SELECT asset_id, ch, win, min(t) AS start_s, max(t) AS end_s, avg(rms_level) AS rm, stddev_samp(rms_level) AS rs, avg(crest_factor) AS cm, stddev_samp(crest_factor) AS cs, avg(zero_crossings_rate) AS zm, stddev_samp(zero_crossings_rate) AS zs, avg(entropy) AS em, stddev_samp(entropy) AS es FROM wins GROUP BY ALL),
astats AS (SELECT asset_id, ch, 'astats (ch' || ch || ')' AS criterion, win, start_s, end_s, CASE WHEN rs < 0.5 AND cs < 0.1 AND zs < 0.005 AND es < 0.02 THEN 'high' ELSE 'medium' END AS confidence FROM stats
 WHERE rm BETWEEN -30 AND -10 AND rs < 1 AND cm BETWEEN 1.55 AND 2.25 AND cs < 0.3 AND zm BETWEEN 0.05 AND 0.1 AND zs < 0.02 AND em BETWEEN 0.6 AND 0.8 AND es < 0.05)""".replace("round_even0(30 / CASE WHEN d.d > 0 THEN d.d ELSE 0.1 END)", "round_even(30 / CASE WHEN d.d > 0 THEN d.d ELSE 0.1 END, 0)")


@_query("W11_astats_timecode", f"WITH {_ASTATS} SELECT * FROM astats")
def _(spark, d):
    return A.astats_timecode(timecode(spark, d))


@_query("W11_label_channels", f"WITH {_ASTATS} SELECT a.asset_id, a.ch, a.win, CASE WHEN EXISTS (SELECT 1 FROM astats b WHERE b.asset_id = a.asset_id AND b.ch <> a.ch AND a.start_s <= b.end_s AND b.start_s <= a.end_s) THEN 'both (ch' || a.ch || ')' ELSE 'ch' || a.ch END AS channel FROM astats a")
def _(spark, d):
    return A.label_channels(A.astats_timecode(timecode(spark, d))).select("asset_id", "ch", "win", "channel")


_R128 = f"""{LOUDNESS}, {_windows_sql('loudness', 'asset_id')},
whole AS (SELECT asset_id, arg_max(r128_i, frame_idx) AS i FROM loudness WHERE r128_i < -1 GROUP BY asset_id),
stats AS (SELECT asset_id, win, min(t) AS start_s, max(t) AS end_s, avg(r128_m) AS mm, coalesce(stddev_samp(r128_m), 0) AS ms, median(r128_m) AS md, min(r128_m) AS lowest, median(r128_lra) AS lra, avg(r128_lra_high) AS hm, coalesce(stddev_samp(r128_lra_high), 0) AS hs,
 list(r128_m ORDER BY frame_idx) FILTER (WHERE r128_m IS NOT NULL) AS lm, list(r128_s ORDER BY frame_idx) FILTER (WHERE r128_s IS NOT NULL) AS ls FROM wins GROUP BY ALL),
more AS (SELECT s.*, w.i, list_aggregate(list_transform(range(1, least(len(lm), len(ls)) + 1), lambda k: abs(lm[k] - ls[k])), 'median') AS gap FROM stats s LEFT JOIN whole w USING (asset_id)),
r128 AS (SELECT asset_id, 'R128-A (stable mix at TC level)' AS criterion, 'n/a (mix-based)' AS channel, win, start_s, end_s, CASE WHEN ms < 1 THEN 'high' ELSE 'medium' END AS confidence FROM more WHERE ms < 2 AND mm > -25 AND lra < 8.5
 UNION ALL SELECT asset_id, 'R128-B (TC + silence)', 'one channel', win, start_s, end_s, CASE WHEN hs < 0.5 THEN 'high' ELSE 'medium' END FROM more WHERE mm IS NOT NULL AND hm BETWEEN -30 AND -10 AND hs < 2 AND abs(md - i) > 20 AND lra > 13
 UNION ALL SELECT asset_id, 'R128-C (TC + program audio)', 'one channel', win, start_s, end_s, CASE WHEN gap > 2 THEN 'high' ELSE 'medium' END FROM more WHERE gap > 1.5 AND ms > 8 AND hm BETWEEN -30 AND -24 AND hs < 3 AND lowest > -60),
runs AS (SELECT *, sum(CASE WHEN start_s - before <= 45 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id, criterion ORDER BY start_s) AS g FROM (SELECT *, lag(end_s) OVER (PARTITION BY asset_id, criterion ORDER BY start_s) AS before FROM r128)),
lasting AS (SELECT asset_id, criterion, channel, win, start_s, end_s, confidence FROM (SELECT *, count(*) OVER (PARTITION BY asset_id, criterion, g) AS k FROM runs) WHERE k >= 6),
joined AS (SELECT *, sum(CASE WHEN start_s <= before + 30 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id, criterion ORDER BY start_s) AS g FROM (SELECT *, max(end_s) OVER (PARTITION BY asset_id, criterion ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lasting)),
found AS (SELECT asset_id, criterion, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_spans, arg_min(channel, start_s) AS channel, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE arg_min(confidence, start_s) END AS confidence FROM joined GROUP BY asset_id, criterion, g)"""


@_query("W10_r128_timecode", f"WITH {_R128} SELECT * FROM r128")
def _(spark, d):
    return A.r128_timecode(loudness(spark, d))


@_query("W12_filter_consecutive", f"WITH {_R128} SELECT * FROM lasting")
def _(spark, d):
    return A.filter_consecutive(A.r128_timecode(loudness(spark, d)))


@_query("W13_merge_detections", f"WITH {_R128} SELECT * FROM found")
def _(spark, d):
    return A.merge_detections(A.filter_consecutive(A.r128_timecode(loudness(spark, d))))


_REFINED = f"""regions AS (SELECT * FROM found UNION ALL SELECT asset_id, 'late', max(t) * 0.75 + 1, max(t), 1, '', '' FROM loudness GROUP BY asset_id),
seq AS (SELECT asset_id, t, r128_m, row_number() OVER (PARTITION BY asset_id ORDER BY frame_idx) - 1 AS i FROM loudness),
step AS (SELECT asset_id, greatest(1, CAST(floor(1 / (max(CASE WHEN i = 1 THEN t END) - max(CASE WHEN i = 0 THEN t END))) AS INT)) AS ahead FROM seq GROUP BY asset_id),
mids AS (SELECT s.asset_id, s.i, s.t, coalesce((SELECT median(x.r128_m) FROM seq x WHERE x.asset_id = s.asset_id AND x.i >= s.i AND x.i < s.i + p.ahead) BETWEEN -45 AND -8, false) AS ok FROM seq s JOIN step p USING (asset_id)),
begun AS (SELECT r.*, (SELECT min(i) FROM mids m WHERE m.asset_id = r.asset_id AND m.t >= r.start_s) AS j FROM regions r),
reached AS (SELECT b.*, coalesce((SELECT max(i) + 1 FROM mids m WHERE m.asset_id = b.asset_id AND m.i < b.j AND NOT m.ok), 0) AS k FROM begun b)"""


@_query("W14_refine_start", f"WITH {_R128}, {_REFINED} SELECT r.asset_id, r.criterion, m.t AS start_s, r.end_s FROM reached r JOIN mids m ON m.asset_id = r.asset_id AND m.i = r.k")
def _(spark, d):
    own = loudness(spark, d)
    found = A.merge_detections(A.filter_consecutive(A.r128_timecode(own))).select("asset_id", "criterion", "start_s", "end_s")
    late = own.groupBy("asset_id").agg((F.max("t") * 0.75 + 1).alias("start_s"), F.max("t").alias("end_s")).select("asset_id", F.lit("late").alias("criterion"), "start_s", "end_s")
    return A.refine_start(found.unionByName(late), own)


@_query("W18_timecode_consensus")
def _(spark, d):
    r128 = A.merge_detections(A.filter_consecutive(A.r128_timecode(loudness(spark, d)))).drop("n_spans")
    lasting = A.filter_consecutive(A.astats_timecode(timecode(spark, d)), A.ASTATS_WINDOWS)
    found = A.merge_detections(A.label_channels(lasting)).drop("n_spans")
    assets = loudness(spark, d).select("asset_id", (F.col("asset_id") % 5 != 1).alias("astats_available")).distinct()
    return A.timecode_consensus(found.where("asset_id % 5 != 1").unionByName(r128), assets)


@_query("F10_single_audio_stream", f"WITH {CHANNELS}, s AS (SELECT DISTINCT asset_id, CASE WHEN asset_id % 6 = 0 THEN NULL ELSE asset_id % 3 END AS n FROM channels) SELECT asset_id, count(*) AS n FROM channels JOIN s USING (asset_id) WHERE s.n IS NULL OR s.n <= 1 GROUP BY asset_id")
def _(spark, d):
    own = channels(spark, d)
    streams = own.select("asset_id").distinct().withColumn("audio_streams", F.when(F.col("asset_id") % 6 != 0, F.col("asset_id") % 3))
    return A.single_audio_stream(own, streams).groupBy("asset_id").agg(F.count("*").alias("n"))


@_query("W15_majority_smooth", f"WITH {CHANNELS} SELECT asset_id, ch, frame_idx, avg(CAST(peak_level > -5 AS INT)) OVER (PARTITION BY asset_id, ch ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) > 0.5 AS smooth FROM channels")
def _(spark, d):
    return A.majority_smooth(channels(spark, d).withColumn("flag", F.col("peak_level") > -5), "flag").select("asset_id", "ch", "frame_idx", "smooth")


@_query("W16_tc_subregions")
def _(spark, d):
    return A.tc_subregions(channels(spark, d).withColumn("flag", F.col("peak_level") > -5), "flag", 1.0)


_SPIKES = """s AS (SELECT user_id % 20 AS asset_id, event_id AS f, value AS v, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 20) AS n FROM events),
h AS (SELECT *, greatest(51, n // 20) // 2 AS half FROM s),
p AS (SELECT h.*, i + o.o AS place FROM h, unnest(CASE WHEN i = 0 AND n = 1 THEN range(-half, half + 1) WHEN i = 0 THEN range(-half, 1) WHEN i = n - 1 THEN range(0, half + 1) ELSE [0] END) AS o(o)),
m AS (SELECT *, v - quantile_cont(v, 0.5) OVER (PARTITION BY asset_id ORDER BY place RANGE BETWEEN half PRECEDING AND half FOLLOWING) AS dev FROM p),
d AS (SELECT * FROM m WHERE place = i),
k AS (SELECT asset_id, quantile_cont(abs(dev), 0.5) AS mad, stddev_pop(dev) AS sd FROM d GROUP BY asset_id),
x AS (SELECT d.*, i - lag(i) OVER (PARTITION BY asset_id ORDER BY i) AS gap FROM d JOIN k USING (asset_id) WHERE CASE WHEN mad > 0 THEN mad ELSE sd END > 0 AND dev > 3 * CASE WHEN mad > 0 THEN mad ELSE sd END),
g AS (SELECT *, count(*) FILTER (WHERE gap IS NULL OR gap > 2) OVER (PARTITION BY asset_id ORDER BY i) AS run FROM x)"""


@_query("W24_spike_detection", f"WITH {_SPIKES} SELECT asset_id, min(f) AS first_idx, max(f) AS last_idx, max(dev) AS peak FROM g GROUP BY asset_id, run HAVING count(*) <= 2")
def _(spark, d):
    series = table(spark, d, "events").select((F.col("user_id") % 20).alias("asset_id"), F.col("event_id").alias("frame_idx"), F.col("value"))
    return A.spike_detection(series)


# --- Arrays --------------------------------------------------------------------------------------------------------------------------


_TONES = """c AS (SELECT label AS asset_id, vec_id AS k, embedding::DOUBLE[] AS x, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings),
l AS (SELECT asset_id, k, coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i])) >= 0.05, false) AS same FROM c),
r AS (SELECT asset_id, k, count(*) FILTER (WHERE NOT same) OVER (PARTITION BY asset_id ORDER BY k) AS run FROM l)"""


@_query("W21_tone_spans", f"WITH {_TONES} SELECT asset_id, min(k) * 250.0::DOUBLE AS start_ms, (max(k) + 1) * 250.0::DOUBLE AS end_ms FROM r GROUP BY asset_id, run HAVING max(k) > min(k) AND (max(k) + 1 - min(k)) * 250 >= 500")
def _(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("label").alias("asset_id"), F.col("vec_id").alias("chunk_no"), F.col("embedding").alias("samples"))
    return A.tone_spans(chunks, tolerance=0.05, least_ms=500.0)


def _ssim(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select(F.col("label").alias("asset_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("luma"))
    return S.ssim_to_reference(own, [float(k) / 64 for k in range(64)], 8, 8, 1.0)


_BOX = "flatten(list_transform(range(0, 7), lambda a: list_transform(range(0, 7), lambda b: (o.i + a) * 8 + o.j + b)))"
_SSIM = f"""o AS (SELECT i.i AS i, j.j AS j FROM unnest([0, 1]) AS i(i), unnest([0, 1]) AS j(j)),
k AS (SELECT label AS asset_id, vec_id AS frame_idx, o.i, o.j, list_transform({_BOX}, lambda p: embedding[p + 1]::DOUBLE) AS x, list_transform({_BOX}, lambda p: p / 64.0::DOUBLE) AS y FROM embeddings, o),
m AS (SELECT asset_id, frame_idx, list_avg(x) AS mx, list_avg(y) AS my, list_var_samp(x) AS vx, list_var_samp(y) AS vy, (list_sum(list_transform(range(1, 50), lambda p: x[p] * y[p])) - 49 * list_avg(x) * list_avg(y)) / 48 AS c FROM k),
scores AS (SELECT asset_id, frame_idx, avg(((2 * mx * my + 0.0001) * (2 * c + 0.0009)) / ((mx * mx + my * my + 0.0001) * (vx + vy + 0.0009))) AS score FROM m GROUP BY asset_id, frame_idx)"""


@_query("W22_ssim_to_reference", f"WITH {_SSIM} SELECT asset_id, frame_idx, round(score, 6) AS score FROM scores")
def _(spark, d):
    return _ssim(spark, d).withColumn("score", F.round("score", 6))


@_query("W23_ssim_runs", f"WITH {_SSIM}, s AS (SELECT asset_id, frame_idx, score > 0 AS ok, lead(frame_idx) OVER w AS next, row_number() OVER w - row_number() OVER (PARTITION BY asset_id, score > 0 ORDER BY frame_idx) AS run FROM scores WINDOW w AS (PARTITION BY asset_id ORDER BY frame_idx)) SELECT asset_id, min(frame_idx) AS first_idx, max_by(next, frame_idx) AS end_idx FROM s WHERE ok GROUP BY asset_id, run HAVING max(next) IS NOT NULL AND arg_max_null(next, frame_idx) > min(frame_idx)")
def _(spark, d):
    return S.ssim_runs(_ssim(spark, d), 0.0, all_runs=True)


# --- Metadata and fixity -------------------------------------------------------------------------------------------------------------

_META = "meta AS (SELECT p_partkey AS asset_id, 'mediainfo' AS tool, 'Video' AS section, unnest(['Brand', 'Size', 'Type']) AS field, unnest([p_brand, CAST(p_size AS VARCHAR), p_type]) AS value FROM part)"


def _meta(spark: SparkSession, d: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value")) for n, c in (("Brand", "p_brand"), ("Size", "p_size"), ("Type", "p_type"))])
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.lit("mediainfo").alias("tool"), F.lit("Video").alias("section"), F.explode(items).alias("x")).select("asset_id", "tool", "section", "x.*")


def _spec(spark: SparkSession) -> DataFrame:
    rows = [("mediainfo", "Video", "Brand", ["Brand#1", "Brand#2", "Brand#13"]), ("mediainfo", "Video", "Size", [str(k) for k in range(1, 26)]), ("mediainfo", "Video", "Codec", ["FFV1"]), ("mediainfo", "Video", "Type", [""])]
    return spark.createDataFrame(rows, "tool string, section string, field string, accepted array<string>")


_SIZES = "(" + ", ".join(f"'{k}'" for k in range(1, 26)) + ")"
_ACCEPTED = f"CASE field WHEN 'Brand' THEN value IN ('Brand#1', 'Brand#2', 'Brand#13') WHEN 'Size' THEN value IN {_SIZES} END"


@_query("J1_check_spec", f"WITH {_META} SELECT asset_id, field, value AS actual FROM meta WHERE NOT ({_ACCEPTED})")
def _(spark, d):
    return M.check_spec(_meta(spark, d), _spec(spark)).select("asset_id", "field", "actual")


@_query("J2_validate_profile", f"WITH {_META}, c AS (SELECT asset_id, count(*) FILTER (WHERE {_ACCEPTED}) AS matches, count(*) FILTER (WHERE NOT ({_ACCEPTED}) OR field = 'Type') AS mismatches FROM meta WHERE asset_id % 3 <> 0 OR field <> 'Brand' GROUP BY asset_id) SELECT asset_id, 'Video' AS section, matches, mismatches, CAST(1 + CAST(asset_id % 3 = 0 AS INT) AS BIGINT) AS missing, false AS valid FROM c")
def _(spark, d):
    own = _meta(spark, d)
    return M.validate_profile(own.where("asset_id % 3 != 0 or field != 'Brand'"), own.select("asset_id").distinct(), _spec(spark))


@_query("J2_validate_lists", "SELECT p_partkey AS asset_id, 'Audio' AS section, CAST(p_brand = 'Brand#13' OR p_size < 20 AND p_partkey % 2 = 0 AS BIGINT) AS matches, CAST(NOT (p_brand = 'Brand#13' OR p_size < 20 AND p_partkey % 2 = 0) AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS missing, p_brand = 'Brand#13' OR p_size < 20 AND p_partkey % 2 = 0 AS valid FROM part")
def _(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.lit("exiftool").alias("tool"), F.lit("Audio").alias("section"), F.lit("CodecID").alias("field"), F.lit(None).cast("string").alias("value"), F.when(F.col("p_brand") == "Brand#13", F.array(F.lit("V_MS"), F.lit("A_FLAC"), F.lit("x"))).when((F.col("p_size") < 20) & (F.col("p_partkey") % 2 == 0), F.array(F.lit("A_FLAC"), F.lit("V_MS"))).otherwise(F.array(F.lit("A_FLAC"))).alias("values"))
    spec = spark.createDataFrame([("exiftool", "Audio", "CodecID", ["A_FLAC", "V_MS"]), ("exiftool", "Audio", "Title", [""])], "tool string, section string, field string, accepted array<string>")
    return M.validate_profile(own, own.select("asset_id").distinct(), spec)


@_query("J3_check_presence", "WITH x AS (SELECT p_partkey AS asset_id, p_partkey % 3 = 0 AS gone, p_partkey % 3 = 1 AS blank, p_partkey % 5 AS e, p_type AS name FROM part) SELECT asset_id, 'title' AS field, CASE WHEN gone THEN 'not found' ELSE 'empty' END AS problem FROM x WHERE gone OR blank UNION ALL SELECT asset_id, 'ENCODER_SETTINGS', 'not found' FROM x WHERE e < 3 UNION ALL SELECT asset_id, 'format_name', 'differs' FROM x WHERE NOT contains(replace(name, ',', ' '), 'STEEL')")
def _(spark, d):
    k = F.col("p_partkey")
    own = table(spark, d, "part")
    title = own.where("p_partkey % 3 != 0").select(k.alias("asset_id"), F.lit("title").alias("field"), F.when(k % 3 == 1, " ").otherwise("a").alias("value"))
    name = own.select(k.alias("asset_id"), F.lit("format_name").alias("field"), F.replace(F.col("p_type"), F.lit(" "), F.lit(",")).alias("value"))
    assets = own.select(k.alias("asset_id"), F.when(k % 5 < 3, ".MKV").otherwise("mxf").alias("extension"))
    return M.check_presence(title.unionByName(name), assets, ["title", "ENCODER_SETTINGS"], {"format_name": "STEEL"})


_POLICY = [(0, "and", "size", "Video", "Size", ">", "10"), (0, "and", "brand", "Video", "Brand", "!=", "Brand#13"), (1, "or", "small", "Video", "Size", "<=", "5"), (1, "or", "codec", "Video", "Codec", "exists", None)]
_OUTCOMES = "g AS (SELECT p_partkey AS asset_id, 0 AS group_id, p_size > 10 AND p_brand <> 'Brand#13' AS passed FROM part UNION ALL SELECT p_partkey, 1, p_size <= 5 FROM part)"


def _policy(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(_POLICY, "group_id int, group_op string, rule string, tracktype string, field string, operator string, value string")
    own = _meta(spark, d)
    return M.check_policy(own, own.select("asset_id").distinct(), rules)


@_query("J5_check_policy", f"WITH {_OUTCOMES} SELECT * FROM g")
def _(spark, d):
    return _policy(spark, d)


@_query("A23_policy_verdict", f"WITH {_OUTCOMES} SELECT asset_id, count(*) FILTER (WHERE NOT passed) AS fails, CASE WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END AS verdict FROM g GROUP BY asset_id")
def _(spark, d):
    return M.policy_verdict(_policy(spark, d))


@_query("F9_valid_filename", "SELECT c_custkey AS asset_id, CASE WHEN c_custkey % 3 = 0 THEN 'extension' WHEN NOT regexp_full_match(c_name, '(?i)Customer#[0-9]{9}') THEN 'section 1' END AS reason FROM customer")
def _(spark, d):
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, ".mov").otherwise(".MKV"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), M.filename_reason(name, [("regex", r"Customer#[0-9]{9}")], "mkv").alias("reason"))


@_query("A19_fixity_verdict", "SELECT doc_id AS asset_id, CASE WHEN doc_id % 4 = 0 THEN 'sha256' ELSE 'md5' END AS algorithm, CASE WHEN doc_id % 4 = 0 THEN sha256(text) ELSE md5(text) END AS checksum, CASE WHEN doc_id % 7 = 0 THEN 'differ' ELSE 'match' END AS verdict FROM documents")
def _(spark, d):
    own = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.lit("2024-01-31").cast("date").alias("file_date"), F.when(F.col("doc_id") % 4 == 0, "sha256").otherwise("md5").alias("algorithm"), F.when(F.col("doc_id") % 4 == 0, F.sha2("text", 256)).otherwise(F.md5("text")).alias("checksum"))
    now = own.select("asset_id", "algorithm", F.when(F.col("asset_id") % 7 == 0, F.md5("checksum")).otherwise(F.upper("checksum")).alias("checksum"))
    return M.fixity_verdict(own, now)


@_query("J14_verify_stream_hash", "SELECT doc_id AS asset_id, s.stream, CASE WHEN doc_id % 5 = 0 AND s.stream = 'audio' THEN 'missing' WHEN doc_id % 3 = 0 THEN 'algorithm mismatch' ELSE 'match' END AS verdict FROM documents, (VALUES ('video'), ('audio')) s(stream)")
def _(spark, d):
    now = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.explode(F.array(F.lit("video"), F.lit("audio"))).alias("stream"), F.md5("text").alias("hash"))
    stored = now.where("not (asset_id % 5 = 0 and stream = 'audio')").withColumn("algorithm", F.when(F.col("asset_id") % 3 == 0, "sha256").otherwise("md5"))
    return M.verify_stream_hash(stored, now)


@_query("A17_validator_summary", "SELECT user_id % 20 AS asset_id, count(*) FILTER (WHERE event_id % 5 <> 0 AND event_id % 7 = 0) AS errors, count(*) FILTER (WHERE event_id % 5 = 0) AS clusters, count(*) FILTER (WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 = 0) AS warnings, CASE WHEN count(*) FILTER (WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0) > 0 THEN 'file is valid' END AS verdict, count(*) FILTER (WHERE event_id % 5 <> 0 AND event_id % 7 = 0) > 0 AS invalid FROM events GROUP BY ALL")
def _(spark, d):
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("WRN0C2: Unexpected Cluster at "), F.col("event_id").cast("string"))).when(F.col("event_id") % 7 == 0, "ERR201: bad element").when(F.col("event_id") % 11 == 0, "WRN801: odd").otherwise("file is valid")
    return M.validator_summary(table(spark, d, "events").select((F.col("user_id") % 20).alias("asset_id"), F.col("event_id").alias("line_no"), line.alias("line")))


@_query("U5_merge_profiles", "WITH i AS (SELECT DISTINCT p_brand AS name, p_type AS body FROM part), e AS (SELECT * FROM i WHERE length(name) > 7), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY body) - CASE WHEN length(name) > 7 THEN 0 ELSE 1 END AS k FROM i) SELECT * FROM e UNION ALL SELECT CASE k WHEN 0 THEN name WHEN 1 THEN name || ' (imported)' ELSE name || ' (imported ' || k || ')' END, body FROM k")
def _(spark, d):
    one = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("body")).distinct()
    return M.merge_profiles(one.where("length(name) > 7"), one)


@_query("P14_encoder_settings", "SELECT p_partkey AS asset_id, p_brand AS device, p_type || ',' || p_size AS settings FROM part")
def _(spark, d):
    text = F.concat(F.col("p_brand"), F.lit(": "), F.col("p_type"), F.lit(", "), F.col("p_size").cast("string"), F.lit(" ; "))
    own = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.explode(P.split_encoder_settings(text)).alias("device", "settings"))
    return own.select("asset_id", "device", F.array_join("settings", ",").alias("settings"))


# --- Scalar functions ----------------------------------------------------------------------------------------------------------------


@_query("P1_metric_name", "SELECT p_partkey AS asset_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '.y' ELSE 'mse' END AS metric FROM part")
def _(spark, d):
    key = F.concat(F.lit("lavfi.psnr."), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, ".y").otherwise(".mse"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), P.metric_name(key).alias("metric"))


_CLOCK = "clock AS (SELECT o_orderkey AS k, o_orderkey % 24 AS h, o_orderkey % 60 AS m, o_orderkey // 7 % 60 AS s, o_orderkey % 30 AS f FROM orders)"


def _clock(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), (k % 24).alias("h"), (k % 60).alias("m"), (F.floor(k / 7) % 60).alias("s"), (k % 30).alias("f"))


@_query("P5_timecode_to_frames", f"WITH {_CLOCK} SELECT k, CASE WHEN k % 11 = 0 THEN 0 ELSE ((h * 60 + m) * 60 + s) * 30 + f - CASE WHEN k % 2 = 0 THEN 2 * (h * 60 + m - (h * 60 + m) // 10) ELSE 0 END END AS frames, k % 11 <> 0 AND k % 2 = 0 AS drop_frame FROM clock")
def _(spark, d):
    tc = F.when(F.col("k") % 11 == 0, "bad").otherwise(F.format_string("%02d:%02d:%02d%s%02d", "h", "m", "s", F.when(F.col("k") % 2 == 0, ";").otherwise(":"), "f"))
    return _clock(spark, d).select("k", P.timecode_to_frames(tc).alias("x")).select("k", "x.*")


@_query("P6_hms_to_seconds", f"WITH {_CLOCK} SELECT k, CASE WHEN k % 11 <> 0 THEN CAST(h * 3600 + m * 60 + s + 0.5 AS DOUBLE) END AS t FROM clock")
def _(spark, d):
    text = F.when(F.col("k") % 11 == 0, "soon").otherwise(F.format_string("%d:%02d:%02d.5", "h", "m", "s"))
    return _clock(spark, d).select("k", P.hms_to_seconds(text).alias("t"))


@_query("P7_format_elapsed", "WITH n AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey * 2.5 + 0.5) AS BIGINT) AS n FROM orders) SELECT k, CASE WHEN n >= 36000 THEN printf('%d:%02d:%02d.%d', n // 36000, n // 600 % 60, n // 10 % 60, n % 10) ELSE printf('%d:%02d.%d', n // 600, n // 10 % 60, n % 10) END AS tenths, printf('%d:%02d', k // 240, k // 4 % 60) AS seconds FROM n")
def _(spark, d):
    t = F.col("o_orderkey") * 0.25
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), P.format_elapsed(t).alias("tenths"), P.format_elapsed(t, "seconds").alias("seconds"))


@_query("P8_parse_duration_tag", f"WITH {_CLOCK} SELECT k, CAST(CASE WHEN k % 2 = 0 THEN k ELSE h * 3600 + m * 60 + s + 0.25 END AS DOUBLE) AS duration_s FROM clock")
def _(spark, d):
    own = F.when(F.col("k") % 2 == 0, F.col("k").cast("string"))
    return _clock(spark, d).select("k", P.parse_duration_tag(own, F.format_string("%02d:%02d:%02d.25", "h", "m", "s")).alias("duration_s"))


@_query("P10_imbalance_label", "SELECT c_custkey AS asset_id, CASE WHEN abs(c_acctbal) < 1000 THEN 'Balanced' WHEN abs(c_acctbal) < 3000 THEN 'Slight imbalance' WHEN abs(c_acctbal) < 6000 THEN 'Moderate imbalance' ELSE 'Significant imbalance' END AS label FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), P.characterize_imbalance(F.col("c_acctbal") / 1000).alias("label"))


@_query("P11_wildcard_names", "SELECT c_custkey AS asset_id, c_custkey BETWEEN 100 AND 999 AS fits FROM customer")
def _(spark, d):
    name = F.concat(F.lit("TAPE_"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), name.rlike(f"^{P.wildcard_to_regex('TAPE_###')}$").alias("fits"))


@_query("P12_hash_algorithm", "SELECT doc_id AS asset_id, CASE doc_id % 3 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha256' END AS algorithm FROM documents")
def _(spark, d):
    own = F.when(F.col("doc_id") % 3 == 0, F.md5("text")).when(F.col("doc_id") % 3 == 1, F.sha2("text", 256)).otherwise("none")
    return table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), P.hash_algorithm(own).alias("algorithm"))


@_query("P13_byte_offset_timecode", "WITH n AS (SELECT o_orderkey AS k, o_orderkey % 1000 * 90 AS f FROM orders) SELECT k, printf('%02d:%02d:%02d:%02d', f // 90000, f // 1500 % 60, f // 25 % 60, f % 25) AS tc FROM n")
def _(spark, d):
    at = P.byte_offset_seconds(F.col("o_orderkey") % 1000, F.lit(1000), F.lit(3600))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), P.seconds_to_timecode(at, 25.0).alias("tc"))


@_query("P15_normalize_field", "SELECT p_partkey AS asset_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE CAST(p_size AS VARCHAR) END AS value FROM part")
def _(spark, d):
    many = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand", "p_type", "p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.array_join(P.normalize_field(many, F.array(F.col("p_size").cast("string"))), "|").alias("value"))


@_query("P16_apply_defaults", f"WITH {_META} SELECT asset_id, field, value FROM meta WHERE field IN ('Brand', 'Size') UNION ALL SELECT DISTINCT asset_id, 'Codec' AS field, '' AS value FROM meta")
def _(spark, d):
    own = _meta(spark, d)
    return M.apply_defaults(own, own.select("asset_id").distinct(), ["Brand", "Size", "Codec"])


@_query("P17_yes_no_to_bool", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag FROM orders")
def _(spark, d):
    said = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "NO").otherwise("perhaps")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), P.yes_no_to_bool(said).alias("flag"))


_SCORE = "round(CASE WHEN n > 0 THEN least(0.8, 0.2 + 0.06 * n) * 0.7 ELSE 0 END + CASE WHEN ms > 0 THEN 0.09 ELSE 0 END + CASE WHEN n > 0 AND ms > 0 THEN 0.15 ELSE 0 END, 3)::DOUBLE"


@_query("P18_dropped_sample_score", f"WITH n AS (SELECT event_id, event_id % 20 AS n, event_id % 3 AS ms FROM events), s AS (SELECT event_id, {_SCORE} AS score FROM n) SELECT *, CASE WHEN score = 0 THEN 'clean' WHEN score < 0.4 THEN 'warning' ELSE 'critical' END AS status FROM s")
def _(spark, d):
    return table(spark, d, "events").select("event_id", P.dropped_sample_score(F.col("event_id") % 20, F.col("event_id") % 3).alias("x")).select("event_id", "x.*")


@_query("P19_brng_diagnosis", "WITH c AS (SELECT c_custkey AS asset_id, c_acctbal / 100 AS pct, c_custkey % 30 / 10.0 AS top, c_custkey % 4 AS b, c_custkey % 3 AS c, c_custkey % 2 = 0 AS area FROM customer) SELECT asset_id, CASE WHEN NOT area THEN CASE WHEN pct < 10 AND top < 0.1 THEN 'Video appears broadcast-compliant' WHEN pct < 50 AND top < 1 THEN 'Minor BRNG violations - likely acceptable' WHEN top > 2 THEN 'Significant BRNG violations requiring correction' ELSE 'Moderate BRNG violations detected' END WHEN b > c THEN 'BRNG violations primarily in border areas - active content appears broadcast-safe' WHEN c > 0 THEN CASE WHEN pct > 50 THEN 'Significant BRNG violations in active picture area - requires correction' ELSE 'BRNG violations detected in active picture area - review recommended' END ELSE 'Video appears broadcast-compliant with properly detected borders' END AS diagnosis FROM c")
def _(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("asset_id"), B.brng_diagnosis(F.col("c_acctbal") / 100, k % 30 / 10.0, k % 4, k % 3, k % 2 == 0).alias("diagnosis"))


_AREA = "area AS (SELECT p_partkey AS asset_id, CAST(p_size % 8 AS INT) AS x, CAST(p_size % 5 AS INT) AS y, 700 AS w, CAST(486 - p_size % 5 AS INT) AS h FROM part)"


def _area(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_size") % 8).alias("x"), (F.col("p_size") % 5).alias("y"), F.lit(700).alias("w"), (486 - F.col("p_size") % 5).alias("h"))


@_query("P20_border_regions", f"WITH {_AREA} SELECT asset_id, 'left' AS side, 0 AS x, 0 AS y, x AS w, 486 AS h FROM area WHERE x > 0 UNION ALL SELECT asset_id, 'right', x + w, 0, 720 - x - w, 486 FROM area UNION ALL SELECT asset_id, 'top', 0, 0, 720, y FROM area WHERE y > 0")
def _(spark, d):
    return _area(spark, d).select("asset_id", F.explode(P.border_regions("x", "y", "w", "h", 720, 486)).alias("r")).select("asset_id", "r.*")


@_query("P20_wide_border_regions", f"WITH {_AREA} SELECT asset_id, 'left' AS side, 0 AS x, 0 AS y, x AS w, 486 AS h FROM area WHERE x > 10 UNION ALL SELECT asset_id, 'right', x + w, 0, 720 - x - w, 486 FROM area WHERE 720 - x - w > 10 UNION ALL SELECT asset_id, 'top', 0, 0, 720, y FROM area WHERE y > 10 UNION ALL SELECT asset_id, 'bottom', 0, y + h, 720, 486 - y - h FROM area WHERE 486 - y - h > 10")
def _(spark, d):
    return _area(spark, d).select("asset_id", F.explode(P.border_regions("x", "y", "w", "h", 720, 486, least=10)).alias("r")).select("asset_id", "r.*")


@_query("P20_simple_area", "SELECT p_partkey AS asset_id, CASE WHEN p_size > 16 THEN 8 ELSE 0 END AS x, CASE WHEN p_size > 16 THEN 8 ELSE 0 END AS y, CASE WHEN p_size > 16 THEN p_size - 16 ELSE p_size END AS w, CASE WHEN p_size > 16 THEN p_size + 84 ELSE p_size + 100 END AS h FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), P.simple_area(F.col("p_size"), F.col("p_size") + 100, 8).alias("a")).select("asset_id", "a.*")


@_query("P26_sort_keys", "WITH x AS (SELECT o_orderkey AS k, CAST(o_orderkey % 24 AS INT) AS h, CAST(o_orderkey % 60 AS INT) AS s, o_orderkey % 7 = 0 AS bad, CAST(o_orderkey % 5 AS INT) AS p FROM orders) SELECT k, CASE WHEN bad THEN 9999 ELSE h END AS hours, CASE WHEN bad THEN 99 ELSE 5 END AS minutes, CASE WHEN bad THEN 99 ELSE s END AS seconds, CASE WHEN bad THEN 99 WHEN k % 3 = 0 THEN 0 ELSE 2500 END AS fraction, CASE WHEN p = 4 THEN 99 ELSE p END AS place FROM x")
def _(spark, d):
    k = F.col("o_orderkey")
    time = F.when(k % 7 == 0, F.when(k % 2 == 0, "").otherwise("1:2")).otherwise(F.concat(F.format_string("%02d:05:%02d", k % 24, k % 60), F.when(k % 3 == 0, "").otherwise(".25")))
    kind = F.element_at(F.array(*[F.lit(f"{p}_x") for p in P.PROFILES], F.lit("other")), (k % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("k"), P.timestamp_sort_key(time).alias("t"), P.profile_sort_key(kind).alias("place")).select("k", "t.*", "place")


@_query("P8_av_durations", "WITH x AS (SELECT l_orderkey AS asset_id, (l_partkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS INT) AS i, CASE WHEN l_linenumber % 2 = 0 THEN 'audio' ELSE 'video' END AS kind, CASE WHEN l_quantity >= 10 THEN l_quantity + 0.5 WHEN l_quantity >= 5 THEN 3600 + l_quantity END AS s, CASE WHEN l_quantity % 3 = 1 THEN 48000 END AS r FROM lineitem) SELECT asset_id, CAST(arg_min(s, i) FILTER (WHERE kind = 'video' AND s IS NOT NULL) AS DOUBLE) AS video_s, CAST(arg_min(s, i) FILTER (WHERE kind = 'audio' AND s IS NOT NULL) AS DOUBLE) AS audio_s, CAST(coalesce(arg_min(r, i) FILTER (WHERE kind = 'audio' AND r IS NOT NULL), 0) AS INT) AS sample_rate FROM x GROUP BY asset_id")
def _(spark, d):
    q = F.col("l_quantity")
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), ((F.col("l_partkey") * 8 + F.col("l_linenumber")) * 64 + q.cast("int")).alias("index"), F.when(F.col("l_linenumber") % 2 == 0, "audio").otherwise("video").alias("codec_type"), F.when(q >= 10, (q + 0.5).cast("string")).when(q < 5, "N/A").alias("duration"), F.when(q < 5, None).otherwise(F.format_string("01:00:%02d.000000000", q.cast("int"))).alias("tag_duration"), F.when(q % 3 == 1, "48000").alias("sample_rate"))
    return R.av_durations(own)


@_query("F11_skip_head_bars", f"WITH {FRAMES} SELECT asset_id, frame_idx FROM frames WHERE t <= 40 AND (asset_id % 3 = 0 OR t >= asset_id % 20)")
def _(spark, d):
    own = frames(spark, d)
    ends = own.where("asset_id % 3 != 0").select("asset_id", (F.col("asset_id") % 20).cast("double").alias("bars_end_s")).distinct()
    return I.skip_head_bars(I.time_range(own, None, 40.0), ends).select("asset_id", "frame_idx")


@_query("P21_expand_borders", f"WITH {_AREA} SELECT asset_id, x + 5 AS x, y + 3 AS y, least(w - 7, 720 - x - 5) AS w, least(h - 3, 486 - y - 3) AS h FROM area")
def _(spark, d):
    return _area(spark, d).select("asset_id", P.expand_borders("x", "y", "w", "h", {"left": 5, "top": 3, "right": 2}, 720, 486).alias("a")).select("asset_id", "a.*")


@_query("P22_ltc_in_band", f"WITH {CHANNELS} SELECT asset_id, ch, frame_idx, coalesce(rms_level BETWEEN -24 AND -20 AND max_difference BETWEEN 100 AND 105 AND zero_crossings_rate BETWEEN 7 AND 8 AND rms_difference BETWEEN 80 AND 83, false) AS inside FROM channels")
def _(spark, d):
    bands = {"rms": (-24.0, -20.0), "crest": (100.0, 105.0), "zcr": (7.0, 8.0), "entropy": (80.0, 83.0)}
    return channels(spark, d).select("asset_id", "ch", "frame_idx", P.ltc_in_band("rms_level", "max_difference", "zero_crossings_rate", "rms_difference", bands).alias("inside"))


@_query("P23_floor_neg_inf", "SELECT event_id, CAST(CASE WHEN event_id % 10 = 0 THEN -120 ELSE event_id % 7 END AS DOUBLE) AS level FROM events")
def _(spark, d):
    level = F.when(F.col("event_id") % 10 == 0, F.lit(float("-inf"))).otherwise((F.col("event_id") % 7).cast("double"))
    return table(spark, d, "events").select("event_id", P.floor_neg_inf(level).alias("level"))


@_query("P25_display_labels", "SELECT event_id, printf('%.2f%%', (event_id % 400) / 4.0) AS pct, 'Pass ' || upper(left(event_type, 1)) || lower(substr(event_type, 2)) AS label FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", P.format_percentage(F.col("event_id") % 400, F.lit(400)).alias("pct"), P.humanize_label(F.concat(F.lit("pass_"), F.col("event_type"))).alias("label"))


# --- Reports over several checks -----------------------------------------------------------------------------------------------------

_NOISE = "CASE WHEN l_suppkey % 3 = 0 AND l_orderkey % 10 < 4 OR l_suppkey % 3 = 1 AND l_orderkey % 10 = 0 THEN 0 WHEN (l_orderkey % 10 < 2) = (l_suppkey % 2 = 0) THEN 2 * l_quantity ELSE l_quantity END"
_PLANES = f"""planes AS (SELECT l_suppkey AS asset_id, CAST(l_linenumber % 3 AS INT) AS channel, CAST(l_orderkey % 10 + 1 AS INT) AS bit, CAST({_NOISE} AS DOUBLE) AS value FROM lineitem WHERE l_suppkey % 7 <> 0 OR l_linenumber % 3 <> 2),
seen AS (SELECT asset_id, channel, bit, count(*) AS frames, count(*) FILTER (WHERE value = 0) AS zeros, avg(value) AS average, max(value) AS max FROM planes WHERE bit <= 4 GROUP BY ALL),
planesum AS (SELECT a.asset_id, CAST(c AS INT) AS channel, CAST(b AS INT) AS bit, CASE WHEN coalesce(frames, 0) = 0 THEN 'no_data' WHEN zeros = frames THEN 'empty' ELSE 'active' END AS status, coalesce(frames, 0) AS frames, round(zeros * 100.0 / frames, 1)::DOUBLE AS zero_pct, round(average, 6) AS average, round(max, 6) AS max
 FROM (SELECT DISTINCT asset_id FROM planes) a, (SELECT unnest(range(3)) AS c), (SELECT unnest(range(1, 5)) AS b) LEFT JOIN seen s ON s.asset_id = a.asset_id AND s.channel = c AND s.bit = b)"""


def _planes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").where("l_suppkey % 7 != 0 or l_linenumber % 3 != 2")
    return own.select(F.col("l_suppkey").alias("asset_id"), (F.col("l_linenumber") % 3).cast("int").alias("channel"), (F.col("l_orderkey") % 10 + 1).cast("int").alias("bit"), F.expr(_NOISE).cast("double").alias("value"))


@_query("A8_bitplane_summary", f"WITH {_PLANES} SELECT * FROM planesum")
def _(spark, d):
    return V.bitplane_summary(_planes(spark, d))


@_query("A8_bitplane_verdict", f"WITH {_PLANES}, b AS (SELECT asset_id, bit, round(avg(value), 6) AS a FROM planes WHERE bit <= 4 GROUP BY ALL), o AS (SELECT asset_id, (max(CASE WHEN bit = 1 THEN a END) + max(CASE WHEN bit = 2 THEN a END)) / 2 AS low, (max(CASE WHEN bit = 3 THEN a END) + max(CASE WHEN bit = 4 THEN a END)) / 2 AS high FROM b GROUP BY asset_id), s AS (SELECT asset_id, bool_or(status = 'empty') AS hollow, bool_or(status = 'active') AS act FROM planesum GROUP BY asset_id) SELECT asset_id, CASE WHEN hollow AND NOT act THEN 'truncated' WHEN hollow THEN 'partial_truncation' ELSE 'valid' END AS status, CASE WHEN low >= high THEN 'expected' WHEN low < high THEN 'unexpected' END AS order_check, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN round(low, 4) END AS avg_9th_10th, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN round(high, 4) END AS avg_7th_8th FROM s LEFT JOIN o USING (asset_id)")
def _(spark, d):
    return V.bitplane_verdict(_planes(spark, d)).withColumns({c: F.round(c, 4) for c in ("avg_9th_10th", "avg_7th_8th")})


_ACTIVE = "active AS (SELECT asset_id, period_no, pct / (1 + asset_id % 4) AS pct FROM summary WHERE period_no < 2)"


def _full_active(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = frames(spark, d)
    full = B.brng_period_summary(own, _periods(own))
    return full, full.where("period_no < 2").select("asset_id", "period_no", (F.col("pct") / (1 + F.col("asset_id") % 4)).alias("pct"))


@_query("A11_border_fraction", f"WITH {FRAMES}, {_PERIODS}, {_SUMMARY}, {_ACTIVE}, f AS (SELECT asset_id, sum(pct) AS f FROM summary GROUP BY asset_id), a AS (SELECT asset_id, sum(pct) AS a FROM active GROUP BY asset_id) SELECT asset_id, CASE WHEN f > 0 THEN {_r('greatest(0, least(1, (f - coalesce(a, 0)) / f))')} ELSE 0 END AS fraction FROM f LEFT JOIN a USING (asset_id)")
def _(spark, d):
    return B.border_fraction(*_full_active(spark, d))


@_query("J16_period_compare", f"WITH {FRAMES}, {_PERIODS}, {_SUMMARY}, {_ACTIVE} SELECT s.asset_id, s.period_no, CASE WHEN s.pct > a.pct + 5 AND a.pct < 30 THEN 'border_violations' WHEN a.pct > 10 THEN 'content_violations' ELSE 'minimal' END AS verdict FROM summary s JOIN active a ON s.asset_id = a.asset_id AND s.period_no = a.period_no")
def _(spark, d):
    return B.period_compare(*_full_active(spark, d))


@_query("A13_diagnostic_counts", f"""WITH x AS (SELECT user_id % 20 AS asset_id, event_id AS f, 0 AS i, CASE WHEN event_id % 3 = 0 THEN 'Edge artifacts' WHEN event_id % 3 = 1 THEN 'Linear blanking patterns' ELSE 'Odd' END AS d FROM events UNION ALL SELECT user_id % 20, event_id, 1, 'Edge artifacts' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT user_id % 20, event_id, 2, 'Sub-black detected' FROM events WHERE event_id % 11 = 0 UNION ALL SELECT user_id % 20, event_id, 3, 'Another' FROM events WHERE event_id % 13 = 0),
c AS (SELECT asset_id, d AS diagnostic, count(*) AS n, min(f * 10 + i) AS first FROM x GROUP BY ALL), w AS (SELECT user_id % 20 AS asset_id, count(*) AS whole FROM events GROUP BY ALL)
SELECT asset_id, diagnostic, n, {_r('n * 100.0 / whole')}::DOUBLE AS pct, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY CASE diagnostic WHEN 'Sub-black detected' THEN 1 WHEN 'Edge artifacts' THEN 3 WHEN 'Linear blanking patterns' THEN 4 ELSE 9 END, first) AS INT) AS rank, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, first) = 1 AS dominant FROM c JOIN w USING (asset_id)""")
def _(spark, d):
    e = F.col("event_id")
    found = F.array_compact(F.array(F.when(e % 3 == 0, "Edge artifacts (left, top)").when(e % 3 == 1, "Linear blanking patterns").otherwise("Odd"), F.when(e % 5 == 0, "Edge artifacts (top)"), F.when(e % 11 == 0, "Sub-black detected"), F.when(e % 13 == 0, "Another"), F.when(e % 7 == 0, "Border adjustment recommended")))
    return B.diagnostic_counts(table(spark, d, "events").select((F.col("user_id") % 20).alias("asset_id"), e.alias("frame_idx"), found.alias("diagnostics")))


@_query("A20_excluded_channels", f"WITH {CHANNELS}, f AS (SELECT DISTINCT asset_id, ch, asset_id % 3 = 0 AND ch = 1 AS silent, asset_id % 4 = 0 AND ch = 2 OR asset_id = 3 AND ch = 1 AS timecode FROM channels) SELECT asset_id, ch, concat_ws('+', CASE WHEN silent THEN 'silent' END, CASE WHEN timecode THEN 'timecode' END) AS reasons FROM f WHERE (silent OR timecode) AND asset_id % 12 <> 0")
def _(spark, d):
    own = channels(spark, d).select("asset_id", "ch").distinct()
    covered = F.when((F.col("asset_id") % 4 == 0) & (F.col("ch") == 2) | (F.col("asset_id") == 3) & (F.col("ch") == 1), 0.8).otherwise(0.5)
    return A.excluded_channels(own.where("asset_id % 3 = 0 and ch = 1"), own.withColumn("fraction", covered), own.groupBy("asset_id").agg(F.count("*").alias("channels")))


_RUNS = """b AS (SELECT asset_id, count(*) AS n, max(pct) AS worst, 100.0 * count(*) FILTER (WHERE l OR u) / count(*) AS edge FROM marked WHERE asset_id % 11 <> 0 GROUP BY asset_id),
a AS (SELECT asset_id, count(*) AS n, max(pct) AS worst, 100.0 * count(*) FILTER (WHERE (l OR u) AND (asset_id % 4 <> 1 OR frame_idx % 20 = 0)) / count(*) AS edge FROM marked WHERE asset_id % 3 <> 0 OR frame_idx % 10 < asset_id % 10 + 1 GROUP BY asset_id)"""


@_query("A22_meaningful_improvement", f"WITH {FRAMES}, {_MARKED}, {_RUNS} SELECT asset_id, CASE WHEN b.n IS NULL OR a.n IS NULL THEN false WHEN a.n < 0.8 * b.n OR a.worst < 0.8 * b.worst THEN true WHEN a.edge > 50 THEN asset_id % 5 <> 0 ELSE b.edge > 0 AND a.edge < 0.7 * b.edge END AS improved FROM b FULL JOIN a USING (asset_id)")
def _(spark, d):
    own = _marked(spark, d)
    one = lambda df, edge, width: df.groupBy("asset_id").agg(F.count("*").alias("n"), F.max("pct").alias("worst_pct"), (F.count_if(edge) * 100.0 / F.count("*")).alias("edge_pct")).select("*", width.alias("width"), F.lit(480).alias("height"))
    at_edge, k = F.size("edges") > 0, F.col("asset_id")
    before = one(own.where("asset_id % 11 != 0"), at_edge, F.when(k % 5 != 1, 700))
    after = one(own.where("asset_id % 3 != 0 or frame_idx % 10 < asset_id % 10 + 1"), at_edge & ((k % 4 != 1) | (F.col("frame_idx") % 20 == 0)), F.when(k % 5 == 0, 700).otherwise(690))
    return B.meaningful_improvement(before, after)


@_query("A24_tc_channel_summary", "WITH r AS (SELECT DISTINCT o_custkey % 50 AS asset_id, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE o_orderkey % 2 + 1 END AS ch FROM orders) SELECT asset_id, CASE WHEN count(*) > 1 THEN 'Both channels' ELSE 'Channel ' || min(ch) END AS label FROM r GROUP BY asset_id")
def _(spark, d):
    ch = F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(F.col("o_orderkey") % 2 + 1)
    return A.tc_channel_summary(table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("asset_id"), ch.alias("ch")))


@_query("A25_head_bars_end", f"WITH {_SPANS}, {_TWO}, u AS (SELECT asset_id, end_s FROM a WHERE start_s < 300 UNION ALL SELECT asset_id, end_s FROM b WHERE start_s < 10) SELECT asset_id, max(end_s) AS bars_end_s FROM u GROUP BY asset_id")
def _(spark, d):
    own = _spans(spark, d)
    return V.head_bars_end(own.where("end_s - start_s >= 4 and start_s < 300"), own.where("end_s - start_s = 1"))


_SAID = "CASE asset_id % 4 WHEN 0 THEN 'BRNG violations primarily in border areas - active content appears broadcast-safe' WHEN 1 THEN 'Significant BRNG violations in active picture area - requires correction' WHEN 2 THEN 'BRNG violations detected in active picture area - review recommended' ELSE 'Video appears broadcast-compliant' END"


@_query("A26_method_correlation", f"WITH {FRAMES}, {_MARKED}, {_PATTERNS}, x AS (SELECT asset_id, asset_id % 4 = 0 AS border, asset_id % 4 = 1 AS content, adjust OR edge_pct > 50 AS edgy, edge_pct FROM patterns WHERE asset_id % 9 <> 0) SELECT asset_id, CASE WHEN border AND edgy THEN 'both_border' WHEN content AND NOT edgy AND edge_pct < 30 THEN 'both_content' WHEN content AND edgy THEN 'content_and_border' WHEN border AND NOT edgy AND edge_pct < 30 THEN 'border_and_content' WHEN edge_pct > 50 THEN 'likely_border' WHEN edge_pct < 20 THEN 'likely_content' ELSE 'mixed' END AS agreement FROM x")
def _(spark, d):
    patterns = B.violation_patterns(_marked(spark, d))
    return B.method_correlation(patterns.select("asset_id", F.expr(_SAID).alias("diagnosis")).where("asset_id % 9 != 0"), patterns)


@_query("J4_check_encoder_settings", "SELECT p_partkey AS asset_id, 'deck' AS device, 'differs' AS problem, p_brand || ',' || p_size AS actual FROM part WHERE NOT (p_brand = 'Brand#13' AND p_size = 7) UNION ALL SELECT p_partkey, 'tbc', 'absent', '' FROM part")
def _(spark, d):
    settings = F.create_map(F.lit("deck"), F.array("p_brand", F.col("p_size").cast("string")))
    return M.check_encoder_settings(table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), settings.alias("settings")), {"deck": ["Brand#13", "7"], "tbc": ["on"]})


@_query("J7_suppress_in_bars", f"WITH {CHANNELS} SELECT asset_id, ch, frame_idx FROM channels WHERE rms_level = -95 AND NOT (asset_id % 5 <> 0 AND t BETWEEN 2 AND 6)")
def _(spark, d):
    own = channels(spark, d)
    bars = own.select("asset_id").distinct().withColumn("start_s", F.lit(2.0)).withColumn("end_s", F.when(F.col("asset_id") % 5 != 0, 5.0))
    return I.suppress_in_bars(own.where("rms_level = -95"), bars).select("asset_id", "ch", "frame_idx")


@_query("T9_replace_low_value_periods", f"WITH {FRAMES}, {_PERIODS}, p AS (SELECT *, CASE WHEN (asset_id + period_no) % 4 = 0 THEN 'content_violations' WHEN (asset_id + period_no) % 4 = 1 THEN 'border_violations' ELSE 'minimal' END AS verdict, CAST(asset_id % 3 + 4 * period_no AS DOUBLE) AS active_pct FROM periods), q AS (SELECT *, CASE verdict WHEN 'content_violations' THEN 100 WHEN 'border_violations' THEN 50 ELSE 0 END + active_pct AS score FROM p), c AS (SELECT asset_id, r AS rank, CAST(35 + 8 * r AS DOUBLE) AS start_s, CAST(4 AS DOUBLE) AS duration_s FROM (SELECT DISTINCT asset_id FROM frames), (VALUES (1), (2), (3), (4)) v(r)), f AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY rank) AS i FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.asset_id = c.asset_id AND NOT (c.start_s + c.duration_s < p.start_s OR c.start_s > p.start_s + p.duration_s))), l AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY period_no) AS i FROM q WHERE score < 5) SELECT asset_id, period_no, start_s, duration_s FROM q WHERE score >= 5 UNION ALL SELECT l.asset_id, l.period_no, coalesce(f.start_s, l.start_s), coalesce(f.duration_s, l.duration_s) FROM l LEFT JOIN f ON l.asset_id = f.asset_id AND l.i = f.i")
def _(spark, d):
    own = frames(spark, d)
    candidates = own.select("asset_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("asset_id", "rank", (35.0 + 8 * F.col("rank")).alias("start_s"), F.lit(4.0).alias("duration_s"))
    k = (F.col("asset_id") + F.col("period_no")) % 4
    verdict = F.when(k == 0, "content_violations").when(k == 1, "border_violations").otherwise("minimal")
    return B.replace_low_value_periods(_periods(own).select("*", verdict.alias("verdict"), (F.col("asset_id") % 3 + 4.0 * F.col("period_no")).alias("active_pct")), candidates)


@_query("T9_settle_periods")
def _(spark, d):
    own = frames(spark, d)
    assets = own.groupBy("asset_id").agg((F.max("t") + 10).alias("duration_s"), F.lit(2.0).alias("first_s"))
    candidates = own.select("asset_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("asset_id", "rank", (35.0 + 8 * F.col("rank")).alias("start_s"), F.lit(4.0).alias("duration_s"))
    judged = _periods(own).select("*", F.lit("minimal").alias("verdict"), (F.col("asset_id") % 3 + 4.0 * F.col("period_no")).alias("active_pct"))
    return B.settle_periods(judged, candidates, V.black_segments(own, min_s=1.0), assets)


_SIDES = {"left": "l_linenumber", "right": "l_quantity % 9", "top": "l_quantity % 4", "bottom": "l_orderkey % 5"}


@_query("T11_border_median", "SELECT l_suppkey AS asset_id, " + ", ".join(f"CAST(trunc(quantile_cont(CAST({e} AS DOUBLE), 0.5)) AS INT) AS {s}_px" for s, e in _SIDES.items()) + " FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return B.border_median(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset_id"), *[F.expr(e).alias(s) for s, e in _SIDES.items()]))


@_query("U6_merge_signal_flow", "WITH a AS (SELECT p_brand AS device, max(p_type) AS a FROM part WHERE p_size < 20 GROUP BY p_brand), b AS (SELECT p_brand AS device, min(p_type) AS b FROM part WHERE p_size >= 20 AND length(p_brand) > 7 GROUP BY p_brand) SELECT device, coalesce(b, a) AS settings FROM a FULL JOIN b USING (device)")
def _(spark, d):
    own = table(spark, d, "part")
    return M.merge_signal_flow(own.where("p_size < 20").groupBy(F.col("p_brand").alias("device")).agg(F.max("p_type").alias("settings")), own.where("p_size >= 20 and length(p_brand) > 7").groupBy(F.col("p_brand").alias("device")).agg(F.min("p_type").alias("settings")))


@_query("A16_dropped_sample_summary", f"WITH s AS (SELECT user_id % 20 AS asset_id, count(*) FILTER (WHERE event_id % 9 = 0 AND user_id % 4 <> 0) AS n, CAST(250 * (user_id % 20 % 3) AS DOUBLE) AS ms FROM events GROUP BY user_id % 20), o AS (SELECT asset_id, n AS spikes, ms AS diff_ms, round(n / 48000.0::DOUBLE, 9) AS loss_s, {_SCORE} AS score FROM s) SELECT *, CASE WHEN score = 0 THEN 'clean' WHEN score < 0.4 THEN 'warning' ELSE 'critical' END AS status FROM o")
def _(spark, d):
    own = table(spark, d, "events").select((F.col("user_id") % 20).alias("asset_id"), "event_id")
    durations = own.select("asset_id").distinct().select("asset_id", F.lit(100.0).alias("video_s"), (100.0 - 0.25 * (F.col("asset_id") % 3)).alias("audio_s"))
    return A.dropped_sample_summary(own.where("event_id % 9 = 0 and asset_id % 4 != 0"), durations)


@_query("W3_detect_bars_guided")
def _(spark, d):
    own = frames(spark, d)
    assets = own.select("asset_id").distinct()
    span = lambda df, a, b: df.select("asset_id", F.lit(a).alias("start_s"), F.lit(b).alias("end_s"))
    return V.detect_bars_guided(own, span(assets.where("asset_id % 3 = 0"), 10.0, 25.0), span(assets, 10.0, 18.0).unionByName(span(assets, 16.0, 30.0)))


@_query("W17_refine_gaps")
def _(spark, d):
    own = channels(spark, d).withColumn("flag", F.col("peak_level") > -5)
    regions = A.tc_subregions(own, "flag", 1.0).withColumn("confidence", F.when(F.col("start_s") % 2 == 0, "high").otherwise("medium"))
    return A.refine_gaps(regions, own, "flag", gap=10.0, margin=2.0, hole_s=1.0)


QUERIES |= files.QUERIES
ORACLE_SQL |= files.ORACLE_SQL
