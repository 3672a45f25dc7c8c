"""Medians over sliding windows of any width, all windows of a block of values at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values that a block judges at least; with windows wider than that, as many as a window holds.
BLOCK = 8192


def sliding_medians(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The median (the mean of the middle two) of values[low:high] for each pair of bounds; NaN where there are none.

    The values' ranks are cut into bit-planes, each of which leaves the values in the order of the bits above; a window's k-th least is found by
    counting, plane by plane, how many of its values have a 0 there: log n steps over all windows together.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    now = np.empty(n, dtype=np.int64)
    now[order] = np.arange(n)
    size = high - low
    wanted = np.concatenate([(size - 1) // 2, size // 2])
    left, right = np.concatenate([low, low]), np.concatenate([high, high])
    rank = np.zeros(len(wanted), dtype=np.int64)
    for bit in range(max(1, n - 1).bit_length() - 1, -1, -1):
        ones = now >> bit & 1
        zeros = np.concatenate([[0], np.cumsum(1 - ones)])
        a, b = zeros[left], zeros[right]
        up = wanted >= b - a
        wanted = np.where(up, wanted - (b - a), wanted)
        left, right = np.where(up, zeros[-1] + left - a, a), np.where(up, zeros[-1] + right - b, b)
        rank += up << bit
        now = np.concatenate([now[ones == 0], now[ones == 1]])
    found = np.append(values[order], np.nan)[np.where(np.concatenate([size, size]) > 0, np.minimum(rank, n), n)]
    with np.errstate(invalid="ignore"):
        return (found[: len(size)] + found[len(size) :]) / 2


def running_median(series: DataFrame, value: str, width: int, share: int, out: str, place: str = "_place") -> DataFrame:
    """series (asset_id, frame_idx, ...) with `place`, a row's number in its asset, and `out`: the median of `value` over a window around each row.

    The window is the larger of `width` and one in `share` of the asset's rows, made odd; beyond the ends the first and the last value go on. Nulls do not
    count. Blocks of an asset's rows are judged with a halo of half a window on both sides, so a row is copied three times at most.
    """
    by = Window.partitionBy("asset_id")
    own = series.withColumn("_i", F.row_number().over(by.orderBy("frame_idx")) - 1).withColumn("_n", F.count("*").over(by))
    own = own.withColumn("_half", F.floor(F.greatest(F.lit(width), F.floor(F.col("_n") / share)) / 2).cast("int"))
    own = own.withColumn("_size", F.greatest(F.lit(BLOCK), 2 * F.col("_half") + 1))
    first, last = (F.floor(F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.col("_i") + side * F.col("_half"))) / F.col("_size")) for side in (-1, 1))
    dealt = own.withColumn("_block", F.explode(F.sequence(first, last)))
    names, schema = series.columns, series.withColumns({place: F.lit(0).cast("long"), out: F.lit(0.0)}).schema

    def judge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        i, x = rows["_i"].to_numpy(), rows[value].to_numpy(zero_copy_only=False).astype(float)
        n, half, size, block = (int(rows[c][0].as_py()) for c in ("_n", "_half", "_size", "_block"))
        before, after = half if i[0] == 0 else 0, half if i[-1] == n - 1 else 0
        x = np.concatenate([np.full(before, x[0]), x, np.full(after, x[-1])])
        there = ~np.isnan(x)
        count = np.concatenate([[0], np.cumsum(there)])
        mine = np.flatnonzero(i // size == block)
        low, high = count[np.maximum(0, mine + before - half)], count[np.minimum(len(x), mine + before + half + 1)]
        median = sliding_medians(x[there], low, high) if there.any() else np.full(len(mine), np.nan)
        return rows.select(names).take(pa.array(mine)).append_column(place, pa.array(i[mine], pa.int64())).append_column(out, pa.array(median, mask=np.isnan(median)))

    return dealt.groupBy("asset_id", "_block").applyInArrow(judge, schema)
