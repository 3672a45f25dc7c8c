"""Structural similarity of frames to a reference picture."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .intervals import islands


def _box_sums(a: np.ndarray, box: int) -> np.ndarray:
    """Sums over all full boxes of each picture (pictures x height x width), from running sums down and across."""
    sums = np.zeros((len(a), a.shape[1] + 1, a.shape[2] + 1))
    np.cumsum(np.cumsum(a, axis=1), axis=2, out=sums[:, 1:, 1:])
    return sums[:, box:, box:] - sums[:, :-box, box:] - sums[:, box:, :-box] + sums[:, :-box, :-box]


def ssim(pictures: np.ndarray, reference: np.ndarray, span: float, box: int = 7) -> np.ndarray:
    """Mean structural similarity of each picture (pictures x height x width) to a reference, over full boxes, with sample covariances."""
    shift = reference.mean()  # near 0, squares lose fewer digits
    x, y = pictures - shift, (reference - shift)[None]
    n, c1, c2 = box * box, (0.01 * span) ** 2, (0.03 * span) ** 2
    sx, sy = _box_sums(x, box), _box_sums(y, box)
    va = (_box_sums(x * x, box) - sx * sx / n) / (n - 1)
    vb = (_box_sums(y * y, box) - sy * sy / n) / (n - 1)
    cov = (_box_sums(x * y, box) - sx * sy / n) / (n - 1)
    ma, mb = sx / n + shift, sy / n + shift
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean(axis=(1, 2))


#: Values of pictures that are compared together.
_TOGETHER = 1 << 20


def ssim_to_reference(frames: DataFrame, reference: list[float], width: int, height: int, span: float = 255.0) -> DataFrame:
    """asset_id, frame_idx, score of frames (asset_id, frame_idx, luma: width x height values) against one reference picture; a picture of another size or with a null has no score."""
    picture, size = np.asarray(reference, dtype=float).reshape(height, width), width * height
    step = max(1, _TOGETHER // size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, step) for whole in batches for k in range(0, whole.num_rows, step)):
            luma = b["luma"]
            lengths = pc.fill_null(pc.list_value_length(luma), -1).to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(lengths == size)
            values = luma.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, height, width)
            out = np.full(b.num_rows, np.nan)
            if len(fit):
                out[fit] = ssim(values, picture, span)
            yield pa.RecordBatch.from_arrays([b["asset_id"], b["frame_idx"], pa.array(out, mask=np.isnan(out))], names=["asset_id", "frame_idx", "score"])

    own = frames.select("asset_id", "frame_idx", "luma")
    return own.mapInArrow(score, StructType([*own.schema.fields[:2], StructField("score", DoubleType())]))


def ssim_runs(scores: DataFrame, threshold: float = 0.7, least: int = 0, all_runs: bool = False) -> DataFrame:
    """asset_id, first_idx, end_idx: runs of samples (asset_id, frame_idx, score) over the threshold, up to the first sample below, of more than `least` frames.

    The search stops after an asset's first run, be it too short, unless all_runs. A run that no sample ends is none.
    """
    w = Window.partitionBy("asset_id").orderBy("frame_idx")
    own = scores.withColumn("ok", F.col("score") > threshold).withColumn("next", F.lead("frame_idx").over(w)).withColumn("_b", F.lag("ok").over(w))
    runs = islands(own, ["asset_id"], ["frame_idx"], F.col("ok") != F.col("_b")).where("ok")
    one = runs.groupBy("asset_id", "island").agg(F.min("frame_idx").alias("first_idx"), F.max_by("next", "frame_idx").alias("end_idx"))
    if not all_runs:
        one = one.groupBy("asset_id").agg(F.min_by(F.struct("first_idx", "end_idx"), "first_idx").alias("x")).select("asset_id", "x.*")
    return one.where(F.col("end_idx") - F.col("first_idx") > least).select("asset_id", "first_idx", "end_idx")
