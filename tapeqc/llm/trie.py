"""The prefix trie of conversations as balanced parentheses, a shard of consecutive paths at a time.

A conversation is its turns in order, a path from the root; conversations that begin alike share nodes. Paths are range-partitioned in
order of their turns' digests, so that every subtree is a run of consecutive paths, and each task writes its run as shard files: the
trie's parentheses as bits (a node opens before its children and closes after them), range min-max blocks of their excess, and per node, in
the order of opening, its path's digest, weight, least member and members. From these, findclose gives a node's subtree, the rank of pairs "()" its
leaves, and cumulative arrays the sums below it.

Neighbouring shards share the spine of nodes above the place where they part: each holds them in part. The manifest names every shard's first
and last spine; what neighbours hold twice is told from these, summed over shards, and handed to the shards' readers, so that a node comes from
the first shard that holds it, with its whole numbers. No row but the spines' passes a second exchange.

Defined results: turns stand by turn, null first, then by the SHA-256 of their role and text; null role and text are empty; repeated rows
are turns of their own; rows without a conv_id take no part; an empty table has no node; other columns are left alone. A conversation's
digests (24 bytes a turn, no texts) are one row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written

#: A shard file is closed when it holds so many nodes; a longer path is a file of its own.
SHARD_NODES = 500_000
#: Parentheses of an excess block.
_BLOCK = 64
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: The least member of a node at which no conversation ends.
_NONE = np.iinfo(np.int64).max
_FILE = pa.schema({"weight": pa.int64(), "ends": pa.int64(), "least": pa.int64(), "sha": pa.string()})
_SPINE = pa.struct([("pid", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("weight", pa.int64())])
MANIFEST = pa.schema({"part": pa.int32(), "file_no": pa.int32(), "path": pa.string(), "first": pa.list_(_SPINE), "last": pa.list_(_SPINE)})
_SPINE_DDL = "array<struct<pid:binary,conv_id:bigint,n:bigint,children:bigint,leaves:bigint,saved:bigint,weight:bigint>>"
_NODE = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}


class Parentheses:
    """A tree's balanced parentheses, packed in bits, with the least excess of each block and of each pair of blocks, and so on up."""

    def __init__(self, bits: np.ndarray):
        """bits: one for each parenthesis, 1 where a node opens."""
        self.n = len(bits)
        self.packed = np.packbits(bits, bitorder="little")
        steps = np.zeros(-(-max(self.n, 1) // _BLOCK) * _BLOCK, dtype=np.int8)
        steps[: self.n] = np.where(bits, 1, -1)
        blocks = steps.reshape(-1, _BLOCK).cumsum(axis=1, dtype=np.int32)
        #: The excess before each block, and the least excess within it; above, the least of two each time.
        self.before = np.concatenate([[0], np.cumsum(blocks[:, -1], dtype=np.int64)[:-1]])
        self.least = [blocks.min(axis=1) + self.before]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            self.least.append(np.minimum(low[::2], np.append(low[1::2], low[-1:] if len(low) % 2 else [])).astype(np.int64))
        opens = np.asarray(bits, dtype=bool)
        #: Nodes opened, and pairs "()", before each block; and where the k-th node opens.
        self.opened = np.concatenate([[0], np.add.reduceat(opens, np.arange(0, self.n, _BLOCK), dtype=np.int64).cumsum()]) if self.n else np.zeros(1, dtype=np.int64)
        pairs = opens & ~np.append(opens[1:], True)
        self.pairs = np.concatenate([[0], np.add.reduceat(pairs, np.arange(0, self.n, _BLOCK), dtype=np.int64).cumsum()]) if self.n else np.zeros(1, dtype=np.int64)

    def bits(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The parentheses of a range, 1 where a node opens."""
        hi = self.n if hi is None else min(hi, self.n)
        return np.unpackbits(self.packed[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo]

    def _at(self, places: np.ndarray) -> np.ndarray:
        return self.packed[places >> 3] >> (places & 7).astype(np.uint8) & 1

    def rank(self, places: np.ndarray) -> np.ndarray:
        """For each place, the nodes that open before it."""
        return self._counted(places, self.opened, self._at)

    def leaf_rank(self, places: np.ndarray) -> np.ndarray:
        """For each place, the pairs "()" that begin before it."""
        return self._counted(places, self.pairs, lambda at: self._at(at) & (1 - self._at(np.minimum(at + 1, self.n - 1))))

    def _counted(self, places: np.ndarray, blocks: np.ndarray, one) -> np.ndarray:
        places = np.asarray(places, dtype=np.int64)
        out, start = blocks[places // _BLOCK].copy(), places // _BLOCK * _BLOCK
        for k in range(_BLOCK):
            inside = start + k < places
            if not inside.any():
                break
            out[inside] += one(start[inside] + k)
        return out

    def excess(self, places: np.ndarray) -> np.ndarray:
        """For each place, opened less closed before it."""
        return 2 * self.rank(places) - np.asarray(places, dtype=np.int64)

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where the nodes that open at `opens` close: the first place after which the excess is lower than before them."""
        opens = np.asarray(opens, dtype=np.int64)
        goal, level = self.excess(opens), self.excess(opens) + 1
        out, at = np.full(len(opens), -1, dtype=np.int64), opens + 1
        block = self._scan(out, np.arange(len(opens)), at, level, goal)
        for k in range(len(self.least)):  # up: to the first sibling on the right whose least excess is low enough
            if not len(block):
                break
            which, node = block
            right = node + 1
            found = (node % 2 == 0) & (right < len(self.least[k]))
            found[found] = self.least[k][right[found]] <= goal[which[found]]
            down, place = which[found], right[found]
            for lower in range(k - 1, -1, -1):  # and down, to the left where it is low enough there
                place = 2 * place
                place += self.least[lower][place] > goal[down]
            start = place * _BLOCK
            self._scan(out, down, start, self.before[place], goal[down])
            block = (which[~found], node[~found] // 2) if (~found).any() else ()
        return out

    def _scan(self, out: np.ndarray, which: np.ndarray, at: np.ndarray, level: np.ndarray, goal: np.ndarray) -> tuple:
        """Sets out[which] to the first place from `at` on, in its block, where `level` comes down to `goal`; gives those without, and their blocks."""
        home, level, live = at // _BLOCK, level.copy(), np.arange(len(which))
        left = np.ones(len(which), dtype=bool)
        for k in range(_BLOCK):
            place = at[live] + k
            inside = (place // _BLOCK == home[live]) & (place < self.n)
            live, place = live[inside], place[inside]
            if not len(live):
                break
            level[live] += 2 * self._at(place).astype(np.int64) - 1
            hit = level[live] == goal[live]
            out[which[live[hit]]] = place[hit]
            left[live[hit]] = False
            live = live[~hit]
        return (which[left], home[left]) if left.any() else ()


class Shard:
    """The trie of consecutive paths, its nodes in the order of opening."""

    def __init__(self, bits: np.ndarray, weight: np.ndarray, ends: np.ndarray, least: np.ndarray, sha: list[str | None]):
        """weight: code points of a node's last turn; ends: conversations that end at it, the least of them, and the hash of all."""
        self.tree, self.weight, self.ends, self.sha = Parentheses(bits), weight, ends, sha
        opens = np.flatnonzero(bits)
        closes = self.tree.findclose(opens)
        self.depth = self.tree.excess(opens)
        self.last = np.arange(len(opens)) + (closes - opens + 1) // 2
        self.leaves = self.tree.leaf_rank(closes) - self.tree.leaf_rank(opens)
        below = lambda x: (total := np.concatenate([[0], np.cumsum(x)]))[self.last] - total[:-1]
        self.n = below(ends)
        self.saved = below((self.n - 1) * weight)
        self.parent = np.full(len(opens), -1, dtype=np.int64)
        by_depth, self.conv_id = np.argsort(self.depth, kind="stable"), least.copy()
        levels = np.split(by_depth, np.flatnonzero(np.diff(self.depth[by_depth])) + 1)
        for upper, lower in zip(levels, levels[1:], strict=False):
            self.parent[lower] = upper[np.searchsorted(upper, lower) - 1]
        for lower in levels[:0:-1]:
            np.minimum.at(self.conv_id, self.parent[lower], self.conv_id[lower])
        self.children = np.bincount(self.parent[1:], minlength=len(opens))

    def spine(self, node: int) -> list[int]:
        """The nodes from the root down to a node."""
        out = [node]
        while self.parent[out[-1]] >= 0:
            out.append(int(self.parent[out[-1]]))
        return out[::-1]


def _path_digests(key: bytes) -> list[bytes]:
    out = [b""]
    for k in range(0, len(key), 16):
        out.append(hashlib.blake2b(out[-1] + key[k : k + 16], digest_size=16).digest())
    return out


class _Builder:
    """Takes sorted paths one by one, and gives them as a shard."""

    def __init__(self):
        self.bits, self.weight, self.ends, self.least, self.sha, self.first, self.last = bytearray(), [], [], [], [], None, b""

    def add(self, key: bytes, weights: list[int], n: int, least: int, sha: str) -> None:
        if self.first is None:
            self.first, same = key, -1
        else:
            same, most = 0, min(len(key), len(self.last)) // 16
            while same < most and key[16 * same : 16 * same + 16] == self.last[16 * same : 16 * same + 16]:
                same += 1
            self.bits += b"\0" * (len(self.last) // 16 - same)
        opened = len(key) // 16 - same
        self.bits += b"\1" * opened
        self.weight += [0, *weights][same + 1 :]
        self.ends += [0] * (opened - 1) + [n]
        self.least += [_NONE] * (opened - 1) + [least]
        self.sha += [None] * (opened - 1) + [sha]
        self.last = key

    def close(self) -> pa.Table:
        """The shard's file: a row for each node, the parentheses in the schema's metadata."""
        bits = np.frombuffer(bytes(self.bits) + b"\0" * (len(self.last) // 16 + 1), dtype=np.uint8)
        head = {"bits": np.packbits(bits, bitorder="little").tobytes(), "n": str(len(bits))}
        return pa.table([pa.array(self.weight, pa.int64()), pa.array(self.ends, pa.int64()), pa.array(self.least, pa.int64()), pa.array(self.sha, pa.string())], schema=_FILE.with_metadata(head))


def _shard(table: pa.Table) -> Shard:
    head = table.schema.metadata
    bits = np.unpackbits(np.frombuffer(head[b"bits"], dtype=np.uint8), count=int(head[b"n"]), bitorder="little")
    return Shard(bits, *(table[c].to_numpy() for c in ("weight", "ends", "least")), table["sha"].to_pylist())


def rebuilt(conversations: DataFrame, heads: int = 6, every: int = 100) -> DataFrame:
    """conv_id, key (16 bytes for each turn, of the SHA-256 of its role and text), weights (code points of the texts): each conv_id's turns, the first h of
    them taken from conversation conv_id - conv_id % `every`, h the CRC-32 of the decimal conv_id modulo `heads`."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(conv.alias("conv_id"), F.struct("turn", digest.alias("digest"), F.char_length(text).cast("long").alias("weight")).alias("x"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    given = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    all_turns = F.concat(F.coalesce(F.slice("head", 1, h), F.slice("own", 1, 0)), F.slice("own", h + 1, F.size("own")))
    path = own.join(given, "base", "left").select("conv_id", all_turns.alias("path"))
    return path.select("conv_id", F.unhex(F.array_join(F.transform("path", lambda x: x["digest"]), "")).alias("key"), F.transform("path", lambda x: x["weight"]).alias("weights"))


def _ends(paths: DataFrame) -> DataFrame:
    """least, n, sha: a row for each distinct path, of the conversations that it is. Ids are hashed as they come in order: no group is held."""
    sorted_ids = paths.select(F.sha2("key", 256).alias("pid"), "conv_id").repartition("pid").sortWithinPartitions("pid", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, n, state, out = None, None, 0, None, []
        for b in batches:
            for pid, conv_id in zip(b["pid"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if pid != now:
                    if n:
                        out.append((least, n, state.hexdigest()))
                    now, least, n, state = pid, conv_id, 0, hashlib.sha256()
                state.update(f"{',' if n else ''}{conv_id}".encode())
                n += 1
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(("least", "n", "sha"), x, strict=True)) for x in out])
                out = []
        if n:
            out.append((least, n, state.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(("least", "n", "sha"), x, strict=True)) for x in out])

    return sorted_ids.mapInArrow(run, "least long, n long, sha string")


def write_tries(paths: DataFrame) -> DataFrame:
    """Writes shard files of paths (conv_id, key, weights; conv_ids distinct) into the shared folder and returns the manifest: part, file_no, path, and the first and last spine.

    Files have a name of their own for each attempt, and only those that the manifest names count.
    """
    folder = shared_dir(paths.sparkSession, "tries")
    paths = written(paths, "paths")
    distinct = written(paths.join(_ends(paths), F.col("conv_id") == F.col("least")).select("key", "weights", "least", "n", "sha"), "distinct-paths")
    dealt = distinct.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, file_no, now = 0, 0, _Builder()

        def close() -> pa.RecordBatch:
            path, table = f"{root}/{part:06d}-{file_no:06d}-{uuid.uuid4().hex}.trie", now.close()
            with fs.open_output_stream(path) as f:
                pq.write_table(table, f, compression="zstd")
            shard = _shard(table)
            spines = []
            for key, node in ((now.first, len(now.first) // 16), (now.last, len(now.weight) - 1)):
                values = zip(_path_digests(key), shard.spine(node), strict=True)
                spines.append([{"pid": p, "conv_id": int(shard.conv_id[k]), "n": int(shard.n[k]), "children": int(shard.children[k]), "leaves": int(shard.leaves[k]), "saved": int(shard.saved[k]), "weight": int(shard.weight[k])} for p, k in values])
            return pa.RecordBatch.from_pydict({"part": [part], "file_no": [file_no], "path": [path], "first": [spines[0]], "last": [spines[1]]}, MANIFEST)

        for b in batches:
            part = b["part"][0].as_py() if b.num_rows else part
            for key, weights, least, n, sha in zip(*(b[c].to_pylist() for c in ("key", "weights", "least", "n", "sha")), strict=True):
                if now.weight and len(now.weight) + len(weights) > SHARD_NODES:
                    yield close()
                    file_no, now = file_no + 1, _Builder()
                now.add(key, weights, n, least, sha)
        if now.weight:
            yield close()

    manifest = dealt.mapInArrow(write, f"part int, file_no int, path string, first {_SPINE_DDL}, last {_SPINE_DDL}")
    return written(manifest, "trie-manifest").withColumn("folder", F.lit(folder))


def _shared(a: Column, b: Column) -> Column:
    """How many nodes two spines have in common, the root included."""
    same = F.zip_with(a, b, lambda x, y: x["pid"] == y["pid"])
    return F.coalesce(F.size(F.filter(same, lambda x: x)), F.lit(0))


def merged_spines(manifest: DataFrame) -> DataFrame:
    """The manifest with n_left and n_right, the nodes that a shard has in common with the one before and the one after, and their whole numbers in left and right.

    A node that a shard shares with the one before is counted in both: its weight is saved once more, its parent has a child less, and if the
    shard before ends at it and so takes it for a leaf, it and those above have a leaf less. Everything else adds up. Rows are files and spines.
    """
    order = Window.orderBy("part", "file_no")
    files = manifest.withColumns({"before": F.lag("last").over(order), "after": F.lead("first").over(order)})
    files = files.withColumns({"n_left": _shared(F.col("first"), F.col("before")), "n_right": _shared(F.col("last"), F.col("after"))})
    left = F.slice("first", 1, F.col("n_left"))
    twice = F.col("n_left") == F.coalesce(F.size("before"), F.lit(0))
    weights = F.transform(left, lambda x: x["weight"])
    again = lambda x, i: F.struct(x["pid"].alias("pid"), F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n"), F.when(i < F.col("n_left") - 1, -1).otherwise(0).cast("long").alias("children"), F.when(twice, -1).otherwise(0).cast("long").alias("leaves"), F.aggregate(F.slice(weights, i + 1, F.col("n_left")), F.lit(0).cast("long"), lambda a, w: a + w).alias("saved"), F.lit(0).cast("long").alias("weight"))
    own = F.array_distinct(F.concat(left, F.slice("last", 1, F.col("n_right"))))
    rows = files.select(F.explode(F.concat(own, F.transform(left, again))).alias("x")).select("x.*")
    whole = rows.groupBy("pid").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    places = files.select("part", "file_no", F.explode(F.array(F.struct(F.lit(0).alias("side"), left.alias("s")), F.struct(F.lit(1).alias("side"), F.slice("last", 1, F.col("n_right")).alias("s")))).alias("x")).select("part", "file_no", "x.side", F.posexplode("x.s").alias("depth", "node"))
    found = places.select("part", "file_no", "side", "depth", F.col("node.pid").alias("pid")).join(whole, "pid").groupBy("part", "file_no")
    value = F.struct("depth", "conv_id", "n", "children", "leaves", "saved")
    sides = found.agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == k, value))).alias(side) for k, side in enumerate(("left", "right"))])
    return files.select("folder", "path", "part", "file_no").join(sides, ["part", "file_no"], "left")


def nodes(manifest: DataFrame) -> DataFrame:
    """A row for each node of the trie whose shards a manifest names: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    files = merged_spines(manifest)
    files = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # rows are small, the files that they name are not

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (row for b in batches for row in b.to_pylist()):
            fs, _ = pyarrow.fs.FileSystem.from_uri(file["folder"])
            with fs.open_input_file(file["path"]) as f:
                shard = _shard(pq.read_table(f))
            last = shard.spine(len(shard.n) - 1)
            first = [0]
            while first[-1] + 1 < len(shard.n) and shard.parent[first[-1] + 1] == first[-1]:
                first.append(first[-1] + 1)
            left = file["left"] or []
            for spine, whole in ((last, file["right"] or []), (first, left)):
                for k, x in zip(spine, whole, strict=False):
                    shard.conv_id[k], shard.n[k], shard.children[k], shard.leaves[k], shard.saved[k] = x["conv_id"], x["n"], x["children"], x["leaves"], x["saved"]
            own = np.setdiff1d(np.arange(len(shard.n)), first[: len(left)])
            for k in range(0, len(own), 10_000):
                x = own[k : k + 10_000]
                parents = pa.array(shard.conv_id[shard.parent[x]], mask=shard.parent[x] < 0)
                sha = [_NO_ENDS if shard.sha[i] is None else shard.sha[i] for i in x]
                yield pa.RecordBatch.from_arrays([pa.array(shard.conv_id[x]), pa.array(shard.depth[x]), parents, *(pa.array(c[x].astype(np.int64)) for c in (shard.n, shard.children, shard.leaves, shard.saved)), pa.array(sha, pa.string())], schema=pa.schema(_NODE))

    return files.mapInArrow(read, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
