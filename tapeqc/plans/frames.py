"""The driver's tables seen as frames, channels, metadata and arrays: the same SQL text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = """SELECT l_suppkey AS asset_id,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS frame_idx,
  CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS x
FROM lineitem"""

_KINDS = """SELECT *, frame_idx % 97 AS k, (asset_id % 2 = 0 AND frame_idx BETWEEN 100 AND 180) AS bars, (frame_idx % 97 < 40 AND frame_idx % 13 <> 5) AS black FROM base"""

METRICS = {
    "YMIN": "CASE WHEN bars THEN 4 WHEN black THEN 2 + q % 5 ELSE 10 + q END",
    "YLOW": "CASE WHEN bars THEN 40 WHEN black THEN 40 + q ELSE 98 + q END",
    "YAVG": "300 + 2 * q + d",
    "YHIGH": "CASE WHEN bars THEN 500 WHEN black THEN 60 + q ELSE 120 + 4 * q END",
    "YMAX": "CASE WHEN bars THEN 820 + q WHEN black THEN 200 + q ELSE 640 + 7 * q END",
    "UMIN": "CASE WHEN k BETWEEN 60 AND 75 THEN 50 + q ELSE 150 + q END",
    "UAVG": "480 + 8 * d",
    "UMAX": "CASE WHEN k BETWEEN 60 AND 75 THEN 890 + q ELSE 700 + q END",
    "VMIN": "CASE WHEN k BETWEEN 60 AND 75 THEN 60 + d ELSE 150 + d END",
    "VAVG": "500 - 3 * x",
    "VMAX": "CASE WHEN k BETWEEN 60 AND 75 THEN 905 + x ELSE 700 + x END",
    "SATMAX": "CASE WHEN bars THEN 300 + q ELSE 80 + 11 * q END",
    "SATMIN": "d",
    "HUEMED": "(17 * q + 31 * d) % 360",
    "YDIF": "CASE WHEN bars THEN 2 WHEN k BETWEEN 80 AND 88 THEN q % 2 ELSE 1 + q % 7 END",
    "UDIF": "CASE WHEN k BETWEEN 80 AND 88 THEN 0 ELSE 1 + d END",
    "VDIF": "CASE WHEN k BETWEEN 80 AND 88 THEN 0 ELSE 1 + x END",
    "TOUT": "d / 1000.0",
    "BRNG": "d / 250.0",
}

FRAMES = f"base AS ({BASE}), kinds AS ({_KINDS}), frames AS (SELECT asset_id, frame_idx, frame_idx * CAST(0.125 AS DOUBLE) AS t, {', '.join(f'CAST({e} AS DOUBLE) AS {m}' for m, e in METRICS.items())} FROM kinds)"

CHANNELS = """numbered AS (SELECT user_id % 20 AS asset_id, CAST(event_id % 2 + 1 AS INT) AS ch, event_id AS e,
  CAST(row_number() OVER (PARTITION BY user_id % 20, event_id % 2 ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx FROM events),
channels AS (SELECT asset_id, ch, frame_idx, frame_idx * CAST(0.25 AS DOUBLE) AS t,
  CAST(CASE WHEN frame_idx % 29 = 3 THEN NULL WHEN frame_idx % 23 IN (11, 12) THEN -95 ELSE -20 - e % 7 - 2 * (ch - 1) END AS DOUBLE) AS rms_level,
  CAST(CASE WHEN frame_idx % 23 = 11 THEN 1 ELSE 100 + e % 9 END AS DOUBLE) AS max_difference,
  CAST(CASE WHEN frame_idx % 46 = 11 THEN 1 ELSE 80 + e % 5 END AS DOUBLE) AS rms_difference,
  CAST(CASE WHEN frame_idx % 23 = 12 THEN 90 ELSE 7 + e % 3 END AS DOUBLE) AS zero_crossings_rate,
  CAST(e % 40 AS DOUBLE) / -4.0 AS peak_level, CAST(e % 3 AS DOUBLE) AS flat_factor FROM numbered)"""

LOUDNESS = """mixed AS (SELECT user_id % 20 AS asset_id, event_id AS e, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx FROM events),
kinds AS (SELECT *, asset_id % 4 AS kind, frame_idx % 160 >= 120 AS quiet FROM mixed),
loudness AS (SELECT asset_id, frame_idx, frame_idx * CAST(2.5 AS DOUBLE) AS t,
  CAST(CASE WHEN frame_idx % 23 = 7 THEN NULL WHEN quiet THEN -70 WHEN kind = 0 AND asset_id % 8 = 0 THEN -20 - e % 3 WHEN kind = 0 THEN -20 - 2 * (e % 3) WHEN kind = 1 THEN -20 - e % 3 WHEN kind = 2 THEN -15 - 25 * (e % 2) ELSE -35 - e % 20 END AS DOUBLE) AS r128_m,
  CAST(CASE WHEN frame_idx % 29 = 5 THEN NULL WHEN kind = 2 THEN -27 ELSE -21 END AS DOUBLE) AS r128_s,
  CAST(CASE WHEN kind = 0 THEN 5 + e % 3 WHEN kind = 1 THEN 15 + e % 2 ELSE 10 END AS DOUBLE) AS r128_lra,
  CAST(CASE WHEN kind = 0 THEN -12 WHEN kind = 1 THEN -20 - e % 2 WHEN kind = 2 THEN -27 - e % 3 ELSE -40 END AS DOUBLE) AS r128_lra_high,
  CAST(CASE WHEN frame_idx % 7 = 3 THEN NULL WHEN frame_idx % 11 = 4 THEN 0 WHEN kind = 1 THEN -46 ELSE -22 END AS DOUBLE) AS r128_i FROM kinds)"""

TIMECODE = """counted AS (SELECT user_id % 20 AS asset_id, CAST(event_id % 2 + 1 AS INT) AS ch, event_id AS e, CAST(row_number() OVER (PARTITION BY user_id % 20, event_id % 2 ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx FROM events),
carried AS (SELECT *, (asset_id % 4 = 0 OR asset_id % 4 = 1 AND ch = 1 OR asset_id % 4 = 2) AND frame_idx % 90 < 70 AS tc, CASE WHEN asset_id % 4 = 2 THEN 3 ELSE 1 END AS loose FROM counted),
timecode AS (SELECT asset_id, ch, frame_idx, frame_idx * CAST(2.5 AS DOUBLE) AS t,
  CAST(CASE WHEN frame_idx % 31 = 9 THEN NULL WHEN tc THEN -21 - loose * (e % 3) / 4.0 ELSE -70 END AS DOUBLE) AS rms_level,
  CAST(CASE WHEN tc THEN 1.75 + loose * (e % 3) / 32.0 ELSE 5 END AS DOUBLE) AS crest_factor,
  CAST(CASE WHEN frame_idx % 37 = 4 THEN NULL WHEN tc THEN 0.0703125 + loose * (e % 3) / 512.0 ELSE 0.25 END AS DOUBLE) AS zero_crossings_rate,
  CAST(CASE WHEN tc THEN 0.6875 + loose * (e % 3) / 128.0 ELSE 0.25 END AS DOUBLE) AS entropy FROM carried)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from(spark: SparkSession, sf_dir: str, source: str, ctes: str, name: str) -> DataFrame:
    return spark.sql(f"WITH {ctes.replace(f'FROM {source}', 'FROM {source}')} SELECT * FROM {name}", source=table(spark, sf_dir, source))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, frame_idx, t and the video metrics: lineitem as frames of its suppliers."""
    return _from(spark, sf_dir, "lineitem", FRAMES, "frames")


def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, frame_idx, t and the mix' loudness: events as frames of twenty assets, some with timecode of each kind."""
    return _from(spark, sf_dir, "events", LOUDNESS, "loudness")


def timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, ch, frame_idx, t and the four metrics that tell timecode: events as two channels of twenty assets."""
    return _from(spark, sf_dir, "events", TIMECODE, "timecode")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, ch, frame_idx, t and the audio metrics: events as two channels of twenty assets."""
    return _from(spark, sf_dir, "events", CHANNELS, "channels")
