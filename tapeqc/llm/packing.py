"""Packing token pieces into sequences of fixed length by patterns.

Documents are cut only where they are longer than a sequence. The histogram of the pieces' lengths, one count for each length, is all that the
driver sees: patterns of two or three lengths that fill a sequence are enumerated over coarse bins of lengths, how often to repeat each
is fitted to the histogram by non-negative least squares and rounded down, and what no pattern takes is packed best fit first, into the
gaps that patterns leave and then into new sequences. The plan is a list of runs (a pattern of lengths, how many sequences): pieces of a length are
numbered in a distributed way and find their sequence and offset by number.

Defined results: a null or empty text is the end id alone; rows that repeat are packed each; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import with_offsets
from .shared import written
from .words import encoder

#: Runs of a plan that are broadcast, some 50 bytes each; a longer table is joined by shuffles.
BROADCAST_RUNS = 200_000
PIECES = pa.schema({"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary()})


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): the ids of each text and `end_id`, cut every `length` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                rows = []
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"], strict=True):
                    ids = np.append(encode.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                    rows += [(doc_id, p, s, min(length, len(ids) - s), ids[s : s + length].tobytes()) for p, s in enumerate(range(0, len(ids), length))]
                yield pa.RecordBatch.from_pydict(dict(zip(PIECES.names, map(list, zip(*rows, strict=True)), strict=True)), PIECES)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def nnls(patterns: np.ndarray, wanted: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The x >= 0 that minimises |A x - wanted|, A counting each bin in each pattern (rows of `patterns`: bins, -1 for none).

    Active sets as Lawson and Hanson (1974) keep them: at most as many patterns as bins are in use.
    """
    bins, n = len(wanted), len(patterns)
    a = np.zeros((bins, n))
    for column in patterns.T:
        used = column >= 0
        np.add.at(a, (column[used], np.flatnonzero(used)), 1.0)
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    limit = 1e-9 * max(1.0, float(np.abs(wanted).max(initial=0))) * 10
    for _ in range(rounds):
        gain = a.T @ (wanted - a @ x)
        gain[active] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= limit:
            break
        active[k] = True
        while True:
            own = np.flatnonzero(active)
            best = np.linalg.lstsq(a[:, own], wanted, rcond=None)[0]
            if best.min() > 1e-12:
                x[:] = 0
                x[own] = best
                break
            low = best <= 1e-12
            steps = x[own][low] / np.maximum(x[own][low] - best[low], 1e-300)
            x[own] += float(steps.min()) * (best - x[own])
            gone = own[x[own] <= 1e-10]
            if not len(gone):
                gone = own[low][[int(np.argmin(steps))]]
            x[gone], active[gone] = 0, False
            if not active.any():
                break
    return x


class _Counts:
    """Pieces left of each length."""

    def __init__(self, histogram: dict[int, int]):
        self.left = dict(histogram)
        self.lengths = sorted(k for k, n in histogram.items() if n)

    def largest(self, most: int, least: int = 1) -> int | None:
        k = bisect_left(self.lengths, most + 1) - 1
        return self.lengths[k] if k >= 0 and self.lengths[k] >= least else None

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.lengths[bisect_left(self.lengths, length)]


def plan(histogram: dict[int, int], length: int = 2048, bins: int = 128) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in a sequence, how many such sequences) that hold every piece of the histogram once.

    >>> plan({6: 2, 4: 1, 2: 3}, length=10, bins=5)
    [((6, 2, 2), 1), ((6, 4), 1), ((2,), 1)]
    """
    width = -(-length // bins)
    bins = -(-length // width)
    counts, runs = _Counts({k: n for k, n in histogram.items() if k < length}), []
    if histogram.get(length):
        runs.append(((length,), histogram[length]))
    wanted = np.zeros(bins)
    for k, n in counts.left.items():
        wanted[-(-k // width) - 1] += n
    pairs = [(a, bins - a - 2, -1) for a in range(bins) if a >= bins - a - 2 >= 0]
    triples = [(a, b, bins - a - b - 3) for a in range(bins) for b in range(a + 1) if b >= bins - a - b - 3 >= 0]
    patterns = np.array(pairs + triples, dtype=np.int64).reshape(-1, 3)
    fitted = np.floor(nnls(patterns, wanted) + 1e-9).astype(np.int64) if len(patterns) else []
    for pattern, repeats in sorted(((tuple(p), int(n)) for p, n in zip(patterns.tolist(), fitted, strict=True) if n), reverse=True):
        while repeats:
            run, space = [], length
            for k, b in enumerate(x for x in pattern if x >= 0):
                last = k == (1 if pattern[2] < 0 else 2)
                found = counts.largest(space if last else min(space, (b + 1) * width), b * width + 1)
                if found is None:
                    break
                run.append(found)
                space -= found
            if not last or found is None:
                break
            n = min([repeats, *(counts.left[x] // run.count(x) for x in run)])
            if not n:
                break
            for x in run:
                counts.take(x, n)
            runs.append((tuple(run), n))
            repeats -= n
    return runs[:1] * (length in histogram and bool(histogram[length])) + _best_fit(runs[bool(histogram.get(length)) :], counts, length)


def _best_fit(runs: list[tuple[tuple[int, ...], int]], counts: _Counts, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs the pieces left, longest first, each where the gap left is smallest; else into a new sequence."""
    open_runs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(run: tuple[int, ...], n: int) -> None:
        gap = length - sum(run)
        if gap not in open_runs:
            open_runs[gap] = []
            insort(gaps, gap)
        open_runs[gap].append((run, n))

    for run, n in runs:
        put(run, n)
    while counts.lengths:
        x = counts.lengths[-1]
        k = bisect_left(gaps, x)
        if k < len(gaps):
            gap = gaps[k]
            run, have = open_runs[gap].pop()
            fit = min(gap // x, counts.left[x])
            n = min(have, counts.left[x] // fit)
            if have > n:
                open_runs[gap].append((run, have - n))
            if not open_runs[gap]:
                del open_runs[gap]
                del gaps[k]
        else:
            run, fit = (), min(length // x, counts.left[x])
            n = counts.left[x] // fit
        put(run + (x,) * fit, n)
        counts.take(x, n * fit)
    return [r for gap in gaps for r in open_runs[gap]]


def pack(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, start, length and others) with sequence_id and offset: its sequence and its place there, gapless from 0.

    Only the histogram of lengths, at most `length` rows, and the plan's runs, whose number depends on it alone, pass through the driver.
    """
    spark = pieces.sparkSession
    order = [c for c in ("doc_id", "piece", "start") if c in pieces.columns]
    ranked = with_offsets(pieces.withColumn("_one", F.lit(1)), ["length"], order, {"_rank": "_one"}).drop("_one")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, seen, first = [], dict.fromkeys(histogram, 0), 0
    for run, n in plan(histogram, length):
        offset = 0
        for x in dict.fromkeys(run):
            times = run.count(x)
            rows.append((x, seen[x], seen[x] + times * n, times, first, offset))
            seen[x] += times * n
            offset += times * x
        first += n
    table = spark.createDataFrame(rows, "length long, _from long, _to long, _times long, _first long, _at long")
    small = F.broadcast(table) if len(rows) <= BROADCAST_RUNS else table
    found = ranked.join(small, (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(table["length"])
    inside = F.col("_rank") - F.col("_from")
    return found.select(*pieces.columns, (F.col("_first") + F.floor(inside / F.col("_times"))).cast("long").alias("sequence_id"), (F.col("_at") + (inside % F.col("_times")) * F.col("length")).cast("long").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(places, ids): the pieces' places (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and the pieces with their ids."""
    whole = token_pieces(docs, tokenizer, length, end_id)
    small = written(whole.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(small, length), whole
