"""Nearest neighbours by a forest of hash prefixes.

Each tree writes a vector as a long string of bits, the sides of random hyperplanes on which it lies, and keeps the strings of all rows in one
sorted order. The trees are range-partitioned tables: rows that share a long prefix stand together, in blocks of at most `block_rows`, however dense
their neighbourhood is. A query is itself a row, so that the sort takes it in every tree to the block of the strings that share the longest prefix
with its own; there it is compared with the whole block, which covers all its prefixes longer than the block's ends show.

Then queries ascend in all trees at once. With c the k-th best cosine so far, p the chance that one hyperplane does not part vectors with that
cosine, and prefixes of x bits, (1 - p^x)^trees is the chance that no tree has shown a vector as near. A query asks, in each tree whose block does not
cover it, for all blocks of its prefix at the longest x at which that chance is at most `miss`: the level where an ascent bit by bit would stop at the latest.
Nothing caps the candidates; at x = 0 a query is compared with every vector. Queries travel to blocks, and each block is compared with its
queries by one matrix product.

Blocks hold vectors in bytes with a bound on what that changes in a cosine; whatever the bounds leave open among the best is computed on the original
vectors in double precision. Equal vectors are one node of the forest.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part; a query finds only vectors of its own
dimension. A query's own row is left out, other rows of the same id or vector are not. Ties go to the smaller id, null last. Fewer than k
candidates give fewer rows; an empty table gives none; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lattice import usable
from .shared import written

#: Bits of a string: enough to part any two vectors that are not all but equal, whatever the table's size.
BITS = 60
#: Queries that are compared with a block at once.
ASKING = 1024

_STRINGS = pa.schema({"d": pa.int32(), "tree": pa.int32(), "string": pa.int64(), "node": pa.int64(), "asks": pa.bool_(), "q8": pa.binary(), "scale": pa.float32(), "off": pa.float32()})
_NEAR = pa.list_(pa.struct({"node": pa.int64(), "low": pa.float32(), "high": pa.float32()}))
_BLOCKS = pa.schema({"part": pa.int32(), "no": pa.int32(), "d": pa.int32(), "tree": pa.int32(), "lo": pa.int64(), "hi": pa.int64(), "nodes": pa.binary(), "q8s": pa.binary(), "scales": pa.binary(), "offs": pa.binary(), "query": pa.int64(), "string": pa.int64(), "depth": pa.int32(), "q8": pa.binary(), "scale": pa.float32(), "off": pa.float32(), "near": _NEAR})
_BLOCKS_DDL = "part int, no int, d int, tree int, lo long, hi long, nodes binary, q8s binary, scales binary, offs binary, query long, string long, depth int, q8 binary, scale float, off float, near array<struct<node: long, low: float, high: float>>"


@lru_cache(maxsize=8)
def _planes(dimension: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, trees * BITS))


def hash_strings(v: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """rows x trees numbers of BITS bits, the string's first bit the highest."""
    sides = np.zeros((len(v), trees, 64), dtype=bool)
    sides[:, :, 64 - BITS :] = (v @ _planes(v.shape[1], trees, seed) > 0).reshape(len(v), trees, BITS)
    return np.packbits(sides, axis=2).view(">i8")[:, :, 0].astype(np.int64)


def in_bytes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as signed bytes, each row's scale, and how far the scaled bytes lie from the vector."""
    scale = np.abs(unit).max(axis=1) / 127
    q8 = np.rint(unit / scale[:, None]).astype(np.int8)
    off = np.sqrt(((q8 * scale[:, None] - unit) ** 2).sum(axis=1))
    return q8, scale.astype(np.float32), (off + 1e-6).astype(np.float32)


def _bits_shared(a: np.ndarray, b: int) -> np.ndarray:
    """The length of the longest common prefix of each string with b."""
    _, exponent = np.frexp((a ^ np.int64(b)).astype(np.float64))  # rounding can only make the prefix look shorter by one
    return BITS - exponent


def best_open(q: tuple, own: np.ndarray, b: tuple, nodes: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, column, low, high) of the nodes of a block that may be among a query's k best: bounds of their cosines.

    q and b: (q8, scale, off) of queries and block. A node whose upper bound is below the query's `floor`, or below the k-th best
    lower bound here, is out; so is the query's own node.
    """
    (x, sx, ox), (y, sy, oy) = q, b
    s = (x.astype(np.float32) @ y.astype(np.float32).T) * (sx[:, None] * sy[None, :])
    err = ox[:, None] + oy[None, :] + ox[:, None] * oy[None, :] + np.float32(1e-5)
    low = s - err
    low[own[:, None] == nodes[None, :]] = -np.inf
    if low.shape[1] > k:
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, -k])
    keep = (s + err >= floor[:, None]) & (low > -np.inf)
    i, j = np.nonzero(keep)
    return i, j, low[i, j], (s + err)[i, j]


def _near(i: np.ndarray, n: int, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """A list for each of n queries of the structs of _NEAR; i ascends."""
    offsets = np.searchsorted(i, np.arange(n + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(nodes), pa.array(low.astype(np.float32)), pa.array(high.astype(np.float32))], fields=list(_NEAR.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), items, type=_NEAR)


def _strings(nodes: DataFrame, trees: int, seed: int) -> DataFrame:
    """A row for each node (node, v, asks) and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            sizes = b["v"].value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                some = b.filter(pa.array(sizes == d))
                v = np.asarray(some["v"].flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
                unit = v / np.abs(v).max(axis=1)[:, None]  # first, lest squares overflow
                unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
                strings, (q8, scale, off) = hash_strings(unit, trees, seed), in_bytes(unit)
                n, at = len(v), pa.array(np.tile(np.arange(len(v)), trees))
                packed = pa.array([x.tobytes() for x in q8], pa.binary())
                cols = [pa.array(np.full(n * trees, d, dtype=np.int32)), pa.array(np.repeat(np.arange(trees, dtype=np.int32), n)), pa.array(strings.T.ravel()), some["node"].take(at), some["asks"].take(at), packed.take(at), pa.array(scale).take(at), pa.array(off).take(at)]
                yield pa.RecordBatch.from_arrays(cols, schema=_STRINGS)

    return nodes.select("node", "v", "asks").mapInArrow(run, "d int, tree int, string long, node long, asks boolean, q8 binary, scale float, off float")


def _block(rows: pa.Table, no: int, k: int) -> Iterator[pa.RecordBatch]:
    """A row that holds the block, and one for each query in it with what it finds there."""
    d, tree, part = (rows[c][0].as_py() for c in ("d", "tree", "part"))
    q8 = np.frombuffer(b"".join(rows["q8"].to_pylist()), dtype=np.int8).reshape(-1, d)
    scale, off, nodes, strings, asks = (rows[c].to_numpy() for c in ("scale", "off", "node", "string", "asks"))
    lo, hi = int(strings[0]), int(strings[-1])
    fields = {"part": part, "no": no, "d": d, "tree": tree, "lo": lo, "hi": hi}
    held = {"nodes": nodes.astype("<i8").tobytes(), "q8s": q8.tobytes(), "scales": scale.tobytes(), "offs": off.tobytes()}
    yield pa.RecordBatch.from_pylist([fields | held], schema=_BLOCKS)
    at = np.flatnonzero(asks)
    for some in (at[x : x + ASKING] for x in range(0, len(at), ASKING)):
        i, j, low, high = best_open((q8[some], scale[some], off[some]), nodes[some], (q8, scale, off), nodes, k, np.full(len(some), -np.inf, dtype=np.float32))
        depth = np.maximum(_bits_shared(strings[some], lo), _bits_shared(strings[some], hi)) + 1
        cols = {"query": pa.array(nodes[some]), "string": pa.array(strings[some]), "depth": pa.array(depth.astype(np.int32)), "q8": rows["q8"].combine_chunks().take(pa.array(some)), "scale": pa.array(scale[some]), "off": pa.array(off[some]), "near": _near(i, len(some), nodes[j], low, high)}
        cols |= {c: pa.array([x] * len(some), _BLOCKS.field(c).type) for c, x in fields.items()}
        yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(len(some), f.type)) for f in _BLOCKS], schema=_BLOCKS)


def _descended(strings: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The forest's blocks (query null), and what each query finds in each tree's block of its longest prefixes (nodes null).

    depth: from prefixes of so many bits on, the block holds every string that shares the query's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        no, n, last = 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b[c].to_numpy() for c in ("d", "tree")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[lo])
                while lo < hi:
                    if held and (key != last or n == block_rows):
                        yield from _block(pa.Table.from_batches(held), no, k)
                        held, no, n = [], no + 1, 0
                    some = b.slice(lo, min(hi - lo, block_rows - n))
                    held.append(some)
                    lo, n, last = lo + some.num_rows, n + some.num_rows, key
        if held:
            yield from _block(pa.Table.from_batches(held), no, k)

    order = ["d", "tree", "string", "node"]
    dealt = strings.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(run, _BLOCKS_DDL)


def _kth(near: DataFrame, k: int) -> DataFrame:
    """query, found (how many nodes, up to k), kth (the k-th best lower bound)."""
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low"), "node"))).where(F.col("_r") <= k)
    return best.groupBy("query").agg(F.count("*").alias("found"), F.min("low").alias("kth"))


def _ascended(blocks: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """query, node, low, high: what queries (query, d, tree, string, x, q8, scale, off, kth) find in all blocks of their prefixes of x bits."""
    levels = sorted(r.x for r in asking.select("x").distinct().collect())  # at most BITS + 1
    prefix = lambda c: F.expr(f"shiftright({c}, {BITS} - x)")
    ends = blocks.select("part", "no", "d", "tree", "lo", "hi", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("x"))
    ends = ends.select("part", "no", "d", "tree", "x", F.explode(F.array_distinct(F.array(prefix("lo"), prefix("hi")))).alias("prefix"))
    pairs = asking.withColumn("prefix", prefix("string")).join(ends, ["d", "tree", "x", "prefix"]).select("part", "no", "query", "q8", "scale", "off", "kth")
    parts = pairs.groupBy("part", "no").agg(F.count("*").alias("_n")).select("part", "no", F.ceil(F.col("_n") / ASKING).cast("int").alias("_parts"))
    dealt = pairs.join(parts, ["part", "no"]).withColumn("_salt", F.pmod(F.xxhash64("query"), F.col("_parts")))
    asks = dealt.groupBy("part", "no", "_salt").agg(F.collect_list(F.struct("query", "q8", "scale", "off", "kth")).alias("asks"))
    sent = blocks.select("part", "no", "d", "nodes", "q8s", "scales", "offs").join(asks, ["part", "no"]).drop("part", "no", "_salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(n, 1) for whole in batches for n in range(whole.num_rows)):
            d, a = b["d"][0].as_py(), b["asks"].flatten()
            nodes, scale, off = (np.frombuffer(b[c][0].as_buffer(), dtype=t) for c, t in (("nodes", "<i8"), ("scales", "<f4"), ("offs", "<f4")))
            q8 = np.frombuffer(b["q8s"][0].as_buffer(), dtype=np.int8).reshape(-1, d)
            query, x_scale, x_off, floor = (a.field(c).to_numpy(zero_copy_only=False) for c in ("query", "scale", "off", "kth"))
            x = np.frombuffer(b"".join(a.field("q8").to_pylist()), dtype=np.int8).reshape(-1, d)
            i, j, low, high = best_open((x, x_scale, x_off), query, (q8, scale, off), nodes, k, floor)
            yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(nodes[j]), pa.array(low.astype(np.float32)), pa.array(high.astype(np.float32))], names=["query", "node", "low", "high"])

    return sent.mapInArrow(run, "query long, node long, low float, high float")


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def neighbours(nodes: DataFrame, k: int, trees: int, miss: float, seed: int, block_rows: int) -> DataFrame:
    """query, node, score: for each node (node, v, asks) that asks, the other nodes that may be among its k nearest found, with exact cosines."""
    blocks = written(_descended(_strings(nodes, trees, seed), k, block_rows), "ann-forest")
    held, found = blocks.where("query is null"), blocks.where("query is not null")
    own = found.select("query", F.explode("near").alias("n")).select("query", "n.*").groupBy("query", "node").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    own = written(own, "ann-first")
    p = 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("kth").cast("double")))) / F.lit(float(np.pi))
    level = F.floor(F.log(F.lit(1 - miss ** (1 / trees))) / F.log(p))
    level = F.when((F.coalesce(F.col("found"), F.lit(0)) < k) | (p <= 0), 0).when(p >= 1, BITS).otherwise(F.least(F.lit(BITS), level)).cast("int")
    asking = found.select("query", "d", "tree", "string", "depth", "q8", "scale", "off").join(_kth(own, k), "query", "left")
    asking = asking.withColumn("x", level).where((F.col("x") < F.col("depth")) & ((F.col("x") > 0) | (F.col("tree") == 0)))
    asking = asking.withColumn("kth", F.when(F.col("found") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).cast("float"))
    asking = written(asking.select("query", "d", "tree", "string", "x", "q8", "scale", "off", "kth"), "ann-asking")
    more = _ascended(held, asking, k)
    both = own.union(more.select("query", "node", "low", "high")).groupBy("query", "node").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    both = written(both, "ann-bounds")
    last = both.join(_kth(both, k), "query").where((F.col("found") < k) | (F.col("high") >= F.col("kth"))).select("query", "node")
    vectors = nodes.select("node", "v")
    exact = last.join(vectors, "node").join(vectors.select(F.col("node").alias("query"), F.col("v").alias("u")), "query")
    return exact.select("query", "node", _cosine("u", "v").alias("score"))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, trees: int = 16, miss: float = 0.05, seed: int = 5, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` (vec_id, embedding) that the forest finds for each row where `queries` holds."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    own = own.where(usable("v")).withColumn("key", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(3), "v"))))
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    nodes = own.groupBy("key").agg(F.first("v").alias("v"), F.max("asks").alias("asks"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    # Of equal vectors, a query needs the k smallest ids besides its own.
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("vec_id"), "row"))
    rows = own.select("key", "vec_id", "row").withColumn("_p", place).where(F.col("_p") <= k + 1).join(nodes.select("key", "node"), "key")
    rows = written(rows.groupBy("node").agg(F.collect_list(F.struct("vec_id", "row")).alias("rows")), "ann-copies")
    near = neighbours(nodes.select("node", "v", "asks"), k, trees, miss, seed, block_rows)
    each = near.join(rows, "node").select("query", "score", F.explode("rows").alias("r")).select(F.col("query").alias("node"), "score", "r.vec_id", "r.row")
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    others = each.withColumn("_p", best).where(F.col("_p") <= k).groupBy("node").agg(F.collect_list(F.struct("score", "vec_id", "row")).alias("others"))
    same = nodes.where("asks").select("node", _cosine("v", "v").alias("_s")).join(rows, "node").select("node", F.expr("transform(rows, r -> struct(_s as score, r.vec_id as vec_id, r.row as row))").alias("same"))
    lists = same.join(others, "node", "left").select("node", F.concat("same", F.coalesce("others", F.expr("array()").cast("array<struct<score: double, vec_id: long, row: long>>"))).alias("all"))
    asked = own.where("asks").select("key", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row")).join(nodes.select("key", "node"), "key").join(lists, "node")
    found = asked.select("query_id", "query_row", F.explode("all").alias("r")).where(F.col("r.row") != F.col("query_row"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("r.score"), F.asc_nulls_last("r.vec_id"), "r.row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))
