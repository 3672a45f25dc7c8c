"""Near-duplicate embeddings by lattice hashing.

Each table projects unit vectors at random to 8 dimensions and rounds to the nearest point of the E8 lattice; a vector also probes the cells
of the neighbouring lattice points that are nearest to it. Vectors that meet in a cell are compared in double precision, in blocks of
a bounded number of vectors. A pair that meets several times counts in the first place where it meets, so that links are counted
without listing pairs; cells give their members' links as stars, one row a vector.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing and keep their own id; so do vectors of
another dimension than the others' with those. Equal vectors are compared once and link with each other. Repeated rows are vectors of their own;
null ids are kept as null and come last as representatives; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocked
from .graph import components
from .shared import spread_join, written

#: Vectors of one cell that a block holds.
BLOCK = 512


def _d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        off = x[odd] - near[odd]
        at = np.abs(off).argmax(axis=1)
        near[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 + 1/2, for each row (Conway and Sloane 1982)."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([0.5 if signs >> k & 1 else -0.5 for k in range(8)])
        if bin(signs).count("1") % 2 == 0:
            out.append(v)
    return np.array(out)


_NEIGHBOURS = _shortest()


class LatticeTables:
    """Cells of unit vectors in `tables` random projections; `scale`: lattice units for each unit of projected distance."""

    def __init__(self, dimension: int, tables: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dimension])
        self.tables, self.probes = tables, probes
        self.planes = rng.standard_normal((tables, dimension, 8)) * scale
        self.shifts = rng.random((tables, 8)) * 2
        self.salts = rng.integers(-(1 << 62), 1 << 62, tables)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell numbers, vectors x tables x (own cell, then probed cells)."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            x = unit @ self.planes[t] + self.shifts[t]
            own = nearest_e8(x)
            gain = (x - own) @ _NEIGHBOURS.T
            best = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
            points = np.concatenate([own[:, None, :], own[:, None, :] + _NEIGHBOURS[best]], axis=1)
            codes = np.ascontiguousarray((2 * points).astype(np.int8)).view(np.int64)[..., 0]
            out[:, t] = (codes ^ self.salts[t]) * np.int64(-7046029254386353131)
        return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimension)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def usable(column: str) -> Column:
    """Whether a vector is not null, zero, or holding a null or non-finite component."""
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tables: int = 8, probes: int = 8, scale: float = 0.8, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors (vec_id, embedding)."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.withColumn("ok", usable("v")).withColumn("node", F.when(F.col("ok"), F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(3), "v")))))
    members = written(own.select("vec_id", "node"), "vector-nodes")
    classes = own.where("ok").groupBy("node").agg(F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes, "vector-classes")
    found = written(_links(classes, threshold, lambda d: LatticeTables(d, tables, probes, scale, seed)), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b is not null").select("a", "b"))
    ids = members.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    nodes = ids.join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = written(nodes, "vector-nodes-linked")
    lows = written(nodes.groupBy("component").agg(F.min("low").alias("component_low"), F.count("*").alias("n")), "vector-components")
    nodes = spread_join(nodes, lows, "component", "n").select("node", "component_low", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.col("copies").alias("n"))
    out = spread_join(members, written(nodes, "vector-nodes-told"), "node", "n")
    component = F.coalesce("component_low", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _by_dimension(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.RecordBatch | pa.Table]]:
    """The rows whose vectors have one dimension, for each there is."""
    column = rows["v"].combine_chunks() if isinstance(rows, pa.Table) else rows["v"]
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    found = np.unique(sizes).tolist()
    for d in found:
        yield d, rows if len(found) == 1 else rows.take(pa.array(np.flatnonzero(sizes == d)))


def _links(classes: DataFrame, threshold: float, lattices: Callable[[int], LatticeTables]) -> DataFrame:
    """a, b, n: how many copies of linked vectors a cell counts for a (b null), and for each linked vector of a cell a link to another (n 0).

    Vectors of all dimensions go together; each dimension has projections and cells of its own.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = cache(lattices)
        for whole in batches:
            for d, b in (x for k in range(0, whole.num_rows, 2000) for x in _by_dimension(whole.slice(k, 2000))):
                cells = lattice(d).cells(_unit(_matrix(b["v"], d)))
                n, width = cells.shape[0], cells.shape[1] * cells.shape[2]
                home = np.tile(np.arange(cells.shape[2]) == 0, cells.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1)), pa.array(np.tile(home, n)), b["node"].take(pa.array(np.repeat(np.arange(n), width)))], names=["cell", "home", "node"])

    cells = written(classes.select("node", "v").mapInArrow(spread, "cell long, home boolean, node string").distinct(), "lattice-cells")
    counts = cells.groupBy("cell").agg(F.count("*").alias("_n"), F.max("home").alias("_home")).where("_n > 1 and _home").drop("_home")
    rows = blocked(cells, "cell", "node", counts, BLOCK).join(classes.select("node", "copies", "v"), "node")
    dealt = rows.repartition("cell", "_i", "_j").sortWithinPartitions("cell", "_i", "_j", "node")
    out = pa.schema({"a": pa.string(), "b": pa.string(), "n": pa.int64()})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = cache(lattices)
        for d, group in (x for together in _groups(batches) for x in _by_dimension(together)):
            a, b, n = _cell_links(group, threshold, lattice(d), d)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], schema=out)

    return dealt.mapInArrow(compare, "a string, b string, n long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows that agree in (cell, _i, _j), which follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("cell", "_i", "_j")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _cell_links(group: pa.Table, threshold: float, lattice: LatticeTables, dimension: int) -> tuple[list, list, list]:
    v = _matrix(group["v"].combine_chunks(), dimension)
    unit = _unit(v)
    home, block = group["home"].to_numpy(), group["_block"].to_numpy()
    i, j, cell = group["_i"][0].as_py(), group["_j"][0].as_py(), group["cell"][0].as_py()
    if i == j:
        lo, hi = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        lo, hi = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-9)
        lo, hi = left[lo], right[hi]
    keep = home[lo] | home[hi]
    lo, hi = lo[keep], hi[keep]
    exact = (v[lo] * v[hi]).sum(axis=1) / (np.sqrt((v[lo] ** 2).sum(axis=1)) * np.sqrt((v[hi] ** 2).sum(axis=1))) if len(lo) else np.zeros(0)
    lo, hi = lo[exact >= threshold], hi[exact >= threshold]
    if not len(lo):
        return [], [], []
    names, copies = group["node"].to_pylist(), group["copies"].to_numpy()
    swap = np.array([names[a] > names[b] for a, b in zip(lo, hi, strict=True)])
    lo, hi = np.where(swap, hi, lo), np.where(swap, lo, hi)
    used, back = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    cells = lattice.cells(unit[used])
    own, probed = cells[:, :, 0], cells[:, :, 1:]
    links = np.zeros(len(names), dtype=np.int64)
    for k in range(0, len(lo), 20_000):
        a, b = back[k : k + 20_000][: len(lo[k : k + 20_000])], back[len(lo) + k : len(lo) + k + 20_000]
        same = own[a] == own[b]
        from_b = (probed[b] == own[a][:, :, None]).any(axis=2)
        from_a = (probed[a] == own[b][:, :, None]).any(axis=2)
        met = same | from_b | from_a
        first = met.argmax(axis=1)
        at = np.arange(len(a))
        place = np.where((same | from_b)[at, first], own[a][at, first], own[b][at, first])
        here = np.flatnonzero(place == cell)
        np.add.at(links, lo[k : k + 20_000][here], copies[hi[k : k + 20_000][here]])
        np.add.at(links, hi[k : k + 20_000][here], copies[lo[k : k + 20_000][here]])
    root = np.arange(len(names))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    joined = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            joined.append((names[a], names[b]))
    some = np.flatnonzero(links).tolist()
    return [names[k] for k in some] + [a for a, _ in joined], [None] * len(some) + [b for _, b in joined], links[some].tolist() + [0] * len(joined)
