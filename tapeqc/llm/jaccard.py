"""Exact join of documents whose sets of word shingles are similar, as connected groups.

Documents with equal sets are one set. Shingles are ordered rarest first, by counts over all documents in a sketch of fixed size (any order that is
the same everywhere is right; rare ones first makes lists short). Two sets with Jaccard similarity of at least the threshold share a shingle among
the first of each, its prefix, so the index lists prefix shingles only, with a set's size and the shingle's position.

Set relations save most of the work. First every set of a list is compared with the list's leader, the set that holds the shingle earliest: as many
comparisons as there are sets in lists. What links joins a group, and pairs within a group need no comparison. Then lists that still hold
several groups are walked in blocks, and blocks whose sizes and positions cannot give a link are skipped whole; for two sets that were
compared with the same leader the answers known bound theirs from below and above, which settles most pairs without reading the sets. Only
the rest, if the shingles that both prefixes share allow it, is read and compared.

Defined results: a null or empty text, or one without words, has no set and links with nothing; a text with fewer words than a shingle has one
shingle, all its words. Repeated rows are documents of their own. Null ids are kept; a group's id is its smallest id that is not null. Whole
texts count, of any length; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocked
from .graph import components
from .shared import discard, written

#: Counters of the sketch, one 8-byte number each: what the driver and each task hold of the corpus' counts.
SKETCH = 1 << 18
#: Places that the filter on texts to be read has at most, 8 bytes each.
FILTER = 1 << 21
#: Sets of one list that a block pair holds on each side, and that are skipped together.
BLOCK, _SKIPPED, _TOGETHER = 2048, 64, 48
#: Pairs of one set that a task compares before the set's text is read again.
_MEMBERS = 512
_REMEMBERED = 150_000
#: A shingle whose counter stands so far above the others' has its list dealt over so many tasks.
HOT, SLICES = 20_000, 64


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE, and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word in order: a polynomial of its bytes, taken from running sums over the whole text, then mixed."""
    a = np.frombuffer(text, dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        first = int(starts[k])
        m = max(k + 1, int(np.searchsorted(ends, first + _CHUNK, "right")))
        part = a[first : int(ends[m - 1])]
        up, down = _powers(1 << max(16, len(part).bit_length()))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        out[k:m] = (sums[ends[k:m] - first] - sums[starts[k:m] - first]) * down[starts[k:m] - first]
        k = m
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(29)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of so many words, A-Z lower-cased; empty for a text without words."""
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, t: Fraction) -> np.ndarray | int:
    """The smallest intersection of sets of sizes a and b with which they link."""
    return -(-(t.numerator * (a + b)) // (t.numerator + t.denominator))


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (doc_id, row, size, digest), and rows that count shingles in the sketch (bucket, n)."""
    schema = pa.schema({"doc_id": pa.int64(), "row": pa.int64(), "size": pa.int64(), "digest": pa.binary(), "bucket": pa.int32(), "n": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        empty = lambda n, kind: pa.nulls(n, kind)
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            sets = [shingles(text.as_py(), words) for text in b["text"]]
            sizes, digests = [len(s) for s in sets], [_digest(s) for s in sets]
            counts += np.bincount((np.concatenate(sets) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), empty(n, pa.int32()), empty(n, pa.int64())], schema=schema)
        own = np.flatnonzero(counts)
        for k in range(0, len(own), 20_000):
            some = own[k : k + 20_000]
            n = len(some)
            yield pa.RecordBatch.from_arrays([empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.binary()), pa.array(some.astype(np.int32)), pa.array(counts[some])], schema=schema)

    return docs.mapInArrow(run, "doc_id long, row long, size long, digest binary, bucket int, n long")


def _postings(docs: DataFrame, words: int, t: Fraction, sketch) -> DataFrame:
    """token, digest, size, pos and, of the token's list, lead_pos, lead_size, leader: a row for each prefix shingle that several sets share.

    A task gives the postings of equal sets that it meets again but once, so that copies do not pile up in their shingles' tasks. One
    exchange, by shingle, serves the removal of other repeats and the lists' counts and leaders. Lists that the sketch shows to be long are
    dealt in slices by set, each with a count and a leader of its own; these, a row a slice, are summed, and joined back slice by slice.
    """
    schema = pa.schema({"token": pa.int64(), "slice": pa.int32(), "digest": pa.binary(), "size": pa.int32(), "pos": pa.int32()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        hot = HOT + 2 * counts.mean()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                tokens, slices, digests, sizes, positions = [], [], [], [], []
                for text in b["text"].slice(k, 256):
                    s = shingles(text.as_py(), words)
                    if not len(s) or (digest := _digest(s)) in seen:
                        continue
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    n = len(s) - -(-t.numerator * len(s) // t.denominator) + 1
                    c = counts[(s % np.uint64(SKETCH)).astype(np.int64)]
                    near = np.flatnonzero(c <= np.partition(c, n - 1)[n - 1])
                    first = near[np.lexsort((s[near], c[near]))][:n]
                    tokens.append(s[first].view(np.int64))
                    slices.append(np.where(c[first] > hot, digest[0] % SLICES, -1).astype(np.int32))
                    digests += [digest] * n
                    sizes.append(np.full(n, len(s), dtype=np.int32))
                    positions.append(np.arange(n, dtype=np.int32))
                if digests:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(slices)), pa.array(digests, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(positions))], schema=schema)

    rows = docs.select("text").mapInArrow(run, "token long, slice int, digest binary, size int, pos int").repartition("token", "slice")
    sets = rows.groupBy("token", "slice", "digest").agg(F.first("size").alias("size"), F.first("pos").alias("pos"))
    whole = Window.partitionBy("token", "slice")
    listed = sets.select("*", F.count("*").over(whole).alias("n"), F.min(F.struct("pos", "size", "digest")).over(whole).alias("x")).where("n > 1 OR slice >= 0")
    listed = written(listed, "shared-postings")
    named = ["token", "digest", "size", "pos", F.col("x.pos").alias("lead_pos"), F.col("x.size").alias("lead_size"), F.col("x.digest").alias("leader")]
    sliced = listed.where("slice >= 0")
    if sliced.isEmpty():
        return listed.select(*named)
    tops = sliced.groupBy("token", "slice").agg(F.first("n").alias("n"), F.first("x").alias("x")).groupBy("token").agg(F.sum("n").alias("n"), F.min("x").alias("x"), F.collect_list("slice").alias("slices"))
    tops = tops.where("n > 1").select("token", F.explode("slices").alias("slice"), "x")
    summed = written(listed.where("slice < 0").select(*named).union(sliced.drop("x", "n").join(tops, ["token", "slice"]).select(*named)), "summed-postings")
    discard(listed)
    return summed


def _compare(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """pairs (a, b of digests) with overlap, size_a, size_b and linked, by reading both sets.

    A set's text is that of one row that has it (reps: digest, row, id). A pair brings b's text; a's comes once for each _MEMBERS of its
    pairs. Texts are moved from docs where they are asked for: a broadcast table of at most FILTER places of the rows asked for keeps most
    others where they are, and lets all pass when it is full.
    """
    parts = pairs.groupBy("a").agg(F.count("*").alias("_n")).select("a", F.ceil(F.col("_n") / _MEMBERS).cast("int").alias("_parts"))
    members = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("part"))
    leads = parts.select("a", F.lit(None).cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    asked = members.unionByName(leads).withColumn("digest", F.coalesce("b", "a")).join(reps, "digest").select("row", "id", "a", "b", "part")
    asked = written(asked, "asked-texts")
    place = lambda c: F.pmod(F.col(c), F.lit(FILTER)).cast("int")
    places = asked.select(place("row").alias("_place")).distinct()
    near = docs.withColumn("_place", place("row")).join(F.broadcast(places), "_place", "left_semi")
    texts = near.groupBy("row", F.coalesce("doc_id", F.lit(-1)).alias("id")).agg(F.first("text").alias("text"))  # of rows that repeat, one
    dealt = texts.join(asked, ["row", "id"]).select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    schema = pa.schema({"a": pa.binary(), "b": pa.binary(), "overlap": pa.int32(), "size_a": pa.int32(), "size_b": pa.int32(), "linked": pa.bool_()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, dtype=np.uint64)
        for b in batches:
            rows = []
            for one, other, text in zip(b["a"].to_pylist(), b["b"].to_pylist(), b["text"], strict=True):
                y = shingles(text.as_py(), words)
                if other is None:
                    x = y
                    continue
                n = len(np.intersect1d(x, y, assume_unique=True))
                rows.append((one, other, n, len(x), len(y), n >= least_overlap(len(x), len(y), t)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return dealt.mapInArrow(run, "a binary, b binary, overlap int, size_a int, size_b int, linked boolean")


def _prefixes_allow(pairs: DataFrame, shared: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that may still link by the shingles that their prefixes share.

    Of the shingles that two sets share, those up to the end of the prefix that ends first are in both prefixes; the others are among the rest
    of that set. Shingles that one set alone holds are not in `shared`, nor in two prefixes.
    """
    size, prefix = F.col("size").cast("long"), F.expr(f"size - ceil(size * {t.numerator} / {t.denominator}D - 1e-9) + 1")
    sets = shared.select("digest", "token", size.alias("size")).groupBy("digest").agg(F.collect_list("token").alias("tokens"), F.first("size").alias("size")).withColumn("rest", F.col("size") - prefix)
    of = lambda x: sets.select(F.col("digest").alias(x), F.struct("tokens", "size", "rest").alias(f"s{x}"))
    wide = pairs.join(of("a"), "a").join(of("b"), "b")
    need = F.expr(f"ceil({t.numerator} * (sa.size + sb.size) / {t.numerator + t.denominator}D - 1e-9)")
    return wide.where(F.size(F.array_intersect("sa.tokens", "sb.tokens")) + F.greatest("sa.rest", "sb.rest") >= need).select("a", "b")


def _list_pairs(rows: DataFrame, t: Fraction) -> DataFrame:
    """a, b, known: pairs of sets of different groups that a list leaves open (known false), or that their leader's answers link (true)."""
    out = pa.schema({"a": pa.binary(), "b": pa.binary(), "known": pa.bool_()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            keys = _list_keys(b)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(ends) or held[0] is not b and (_list_keys(held[0])[-1] != keys[0]).any():
                cut = int(ends[-1]) + 1 if len(ends) else 0
                whole = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
                held = [b.slice(cut)]
                yield from _lists(whole, t, out)
        if held:
            yield from _lists(pa.Table.from_batches(held), t, out)

    return rows.mapInArrow(run, "a binary, b binary, known boolean")


def _list_keys(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b[c].to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b[c].to_numpy() for c in ("token", "_i", "_j")], axis=1)


def _lists(rows: pa.Table, t: Fraction, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole lists: those of one length are judged together, long ones are walked alone."""
    if not rows.num_rows:
        return
    keys = _list_keys(rows)
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
    lengths = np.diff(np.concatenate([starts, [len(keys)]]))
    cols = _Columns(rows)
    for n in np.unique(lengths):
        own = starts[lengths == n]
        if n > _TOGETHER:
            for k in own.tolist():
                yield from _walk(cols, np.arange(k, k + n), t, schema)
            continue
        first, second = np.triu_indices(n, 1)
        step = max(1, 200_000 // max(1, len(first)))
        for k in range(0, len(own), step):
            a, b = ((own[k : k + step, None] + x[None, :]).ravel() for x in (first, second))
            met = (cols.i[a] == cols.j[a]) | (cols.block[a] != cols.block[b])
            yield from cols.judged(a[met], b[met], t, schema)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


class _Columns:
    def __init__(self, rows: pa.Table):
        self.size, self.pos, self.over, self.lead_size = (rows[c].to_numpy().astype(np.int64) for c in ("size", "pos", "overlap", "leader_size"))
        self.block, self.i, self.j = (rows[c].to_numpy() for c in ("_block", "_i", "_j"))
        self.part, self.leader, self.names = _codes(rows["part"]), _codes(rows["leader"]), rows["digest"]
        self.rest = self.size - self.pos

    def open(self, a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
        """Whether sizes, positions and groups leave a link between rows a and b open."""
        size = self.size
        enough = np.minimum(self.rest[a], self.rest[b]) >= least_overlap(size[a], size[b], t)
        return enough & (self.part[a] != self.part[b]) & (np.minimum(size[a], size[b]) * t.denominator >= np.maximum(size[a], size[b]) * t.numerator)

    def judged(self, a: np.ndarray, b: np.ndarray, t: Fraction, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The pairs still open, less those that the answers of a common leader rule out; known: those answers link them."""
        keep = self.open(a, b, t)
        a, b = a[keep], b[keep]
        need, size, over = least_overlap(self.size[a], self.size[b], t), self.size, self.over
        same = (self.leader[a] == self.leader[b]) & (over[a] >= 0) & (over[b] >= 0)
        known = same & (over[a] + over[b] - self.lead_size[a] >= need)
        most = np.minimum(over[a], over[b]) + np.minimum(size[a] - over[a], size[b] - over[b])
        keep = ~(same & (most < need))
        a, b, known = a[keep], b[keep], known[keep]
        if len(a):
            one, two = self.names.take(pa.array(a)).to_pylist(), self.names.take(pa.array(b)).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(list(map(min, one, two)), pa.binary()), pa.array(list(map(max, one, two)), pa.binary()), pa.array(known)], schema=schema)


def _walk(cols: _Columns, rows: np.ndarray, t: Fraction, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One long list, or a pair of its blocks: sorted by size and position in runs, of which those that cannot link are skipped whole."""
    i, j, size, rest = cols.i[rows[0]], cols.j[rows[0]], cols.size, cols.rest
    runs = []
    for part in (i, j):
        x = rows[cols.block[rows] == part]
        x = x[np.lexsort((cols.pos[x], size[x]))]
        runs.append([x[k : k + _SKIPPED] for k in range(0, len(x), _SKIPPED)])
    for m, x in enumerate(runs[0]):
        for n, y in enumerate(runs[1]):
            if i == j and n < m:
                continue
            if min(size[x].max(), size[y].max()) * t.denominator < max(size[x].min(), size[y].min()) * t.numerator:
                continue
            if min(rest[x].max(), rest[y].max()) < least_overlap(int(size[x].min()), int(size[y].min()), t):
                continue  # no position in these runs leaves enough shingles
            a, b = (z.ravel() for z in np.meshgrid(x, y, indexing="ij"))
            if i == j and n == m:
                first = np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
                a, b = a[first.ravel()], b[first.ravel()]
            yield from cols.judged(a, b, t, schema)


def similar_groups(docs: DataFrame, words: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, row (a hash of id and text), n_shingles, component_id, kept (one row's hash of each group): a row for each row of docs."""
    t = Fraction(threshold)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("row", F.xxhash64("doc_id", "text"))
    survey = written(_survey(own, words), "shingle-survey")
    members = survey.where("bucket is null").select("doc_id", "row", "size", "digest")
    counts = np.zeros(SKETCH, dtype=np.int64)
    for r in survey.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    sketch = docs.sparkSession.sparkContext.broadcast(counts)

    shared = _postings(own, words, t, sketch)
    reps = members.where("digest is not null").groupBy("digest").agg(F.min(F.struct("row", F.coalesce("doc_id", F.lit(-1)).alias("id"))).alias("x")).select("digest", "x.*")

    need = F.expr(f"ceil({t.numerator} * (size + lead_size) / {t.numerator + t.denominator}D - 1e-9)")
    star = shared.where("digest != leader").where((F.least(F.col("size") - F.col("pos"), F.col("lead_size") - F.col("lead_pos")) >= need) & (F.least("size", "lead_size") * t.denominator >= F.greatest("size", "lead_size") * t.numerator))
    star = star.select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct()
    answers = written(_compare(own, reps, star, words, t), "leader-answers")
    linked = answers.where("linked").select("a", "b")
    parts = components(linked)

    known = answers.groupBy(F.col("b").alias("digest")).agg(F.max(F.struct("overlap", "a", "size_a")).alias("x")).select("digest", "x.overlap", F.col("x.a").alias("leader"), F.col("x.size_a").alias("leader_size"))
    leaders = answers.groupBy(F.col("a").alias("digest")).agg(F.first("size_a").alias("overlap"))
    leaders = leaders.select("digest", "overlap", F.col("digest").alias("leader"), F.col("overlap").alias("leader_size"))
    known = known.join(leaders.select("digest"), "digest", "left_anti").union(leaders.select(known.columns))
    rows = shared.select("token", "digest", "size", "pos").join(parts.withColumnRenamed("node", "digest"), "digest", "left").join(known, "digest", "left")
    rows = rows.select("token", "digest", "size", "pos", F.coalesce("component", "digest").alias("part"), F.coalesce("leader", "digest").alias("leader"), F.coalesce("overlap", F.lit(-1)).alias("overlap"), F.coalesce("leader_size", F.lit(0)).alias("leader_size"))
    rows = written(rows, "list-rows")
    several = rows.groupBy("token").agg(F.count("*").alias("_n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("token", "_n")
    dealt = blocked(rows, "token", "digest", several, BLOCK).repartition("token", "_i", "_j").sortWithinPartitions("token", "_i", "_j", "digest")
    pairs = written(_list_pairs(dealt, t).groupBy("a", "b").agg(F.max("known").alias("known")), "open-pairs")
    left = written(_prefixes_allow(pairs.where("not known").select("a", "b"), shared, t), "left-pairs")
    more = _compare(own, reps, left, words, t).where("linked").select("a", "b")
    nodes = components(linked.union(pairs.where("known").select("a", "b")).union(more))
    discard(shared, answers, rows, pairs, left)

    lows = members.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    lows = lows.join(nodes.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    ends = lows.groupBy("component").agg(F.min("low").alias("component_id"), F.min("best").alias("best"))
    found = lows.select("digest", "component").join(ends, "component").select("digest", "component_id", F.col("best.row").alias("kept_row"), F.col("best.doc_id").alias("kept_id"))
    out = members.join(found, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select("doc_id", "row", F.col("size").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("kept_row")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))).alias("kept"))
