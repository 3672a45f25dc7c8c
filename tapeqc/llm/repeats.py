"""Byte strings that occur more than once in a corpus, by distributed prefix doubling.

Every string of `length` bytes (200) has one sampled position: of the places where a string of half that length begins in it, the one whose
hash is least (the first of equals). It depends on the string alone, so equal strings are sampled at the same place, and about one place in
fifty is a sample. Doubling works on these positions:

- Half-length strings at the samples are named and sorted by Spark; positions get ranks, and those whose string is unique leave.
- Position rank pairs are sorted at growing offsets: a sample's rank beside the rank of the furthest sample that its string reaches, with the distance
  between them. Each round ranks anew strings about twice as long; unique ones leave, and those past the threshold are done.
- A string of `length` bytes within such a longer repeated string is repeated. What is left are the edges of repeats. There, strings of exactly
  `length` bytes meet those of the same first rank: once for each longer repeat (its first position stands for it), and once for each position that
  is still open. Small groups are compared where they meet; groups of more than GROUP positions are sorted and ranked like the pairs before, by
  ranges of their strings' starts, which are cut only where a position's repeats end.

Ranks come from a range sort, whose parts number their own groups; the parts' ends tell where to join them, so that a string with a third
of all positions is dealt over as many tasks as it fills. Names are 128-bit hashes; a text is known by 79 bits of hashes. Equal texts are told
by these, stand for one another in the sorts, and are removed whole.

Defined results: a null text is empty; texts shorter than `length` stay; overlapping occurrences count, in one text too; rows that repeat are texts of
their own, and so are equal texts under different ids; null ids are kept; an empty table gives no row; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written

#: Rounds of doubling at most; more would only leave less to the comparison at the edges.
ROUNDS = 5
#: Positions of one first rank that are compared in one task; groups of more are sorted.
GROUP = 4096
#: Ranges that a range of offsets is cut into, in groups of more.
PIECES = 4
#: Texts that a task remembers, so that it samples copies once.
_SEEN = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _as_long(b: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [b[c].to_numpy(zero_copy_only=False) for c in names]


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def samples(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampled positions of a text, and for each the first and the last start of the strings of `length` bytes that it is the sample of."""
    gram = length // 2
    n, span = len(text) - gram + 1, length - gram + 1
    if n < span:
        return (np.zeros(0, dtype=np.int64),) * 3
    words = np.ndarray((n,), "<u8", text, 0, (1,)) * _MIX
    least = words & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - span + 1], least[span - width :])
    own = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    return own[starts], starts, np.append(starts[1:], len(own)) - 1


# A position is one number: 15 bits of the text's second hash, 32 of the place, and 8 each for how far before it its strings begin, first and last.
def _place(at: np.ndarray) -> np.ndarray:
    return at >> 16 & 0xFFFFFFFF


def _first(at: np.ndarray) -> np.ndarray:
    return _place(at) - (at >> 8 & 0xFF)


def _last(at: np.ndarray) -> np.ndarray:
    return _place(at) - (at & 0xFF)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("doc"), F.crc32(text.cast("binary")).bitwiseAND(0x7FFF).alias("salt"))


def _sampled(texts: DataFrame, length: int) -> DataFrame:
    names = ["hi", "lo", "doc", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, gram, digests, docs, ats, held = set(), length // 2, [], [], [], 0
        for b in batches:
            for text, doc, salt in zip(b["text"], b["doc"].to_pylist(), b["salt"].to_pylist(), strict=True):
                if (doc, salt) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add((doc, salt))
                data = text.as_buffer().to_pybytes()
                place, first, last = samples(data, length)
                digests += [xxhash.xxh3_128_digest(data[p : p + gram]) for p in place.tolist()]
                docs.append(np.full(len(place), doc))
                ats.append(salt << 48 | place << 16 | (place - first) << 8 | place - last)
                held += len(place)
                if held >= 50_000:
                    yield _batch(names, [*np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).T.copy(), np.concatenate(docs), np.concatenate(ats)])
                    digests, docs, ats, held = [], [], [], 0
        if held:
            yield _batch(names, [*np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).T.copy(), np.concatenate(docs), np.concatenate(ats)])

    long_enough = texts.where(F.octet_length("text") >= length).select("text", "doc", "salt")
    return long_enough.mapInArrow(run, "hi long, lo long, doc long, at long")


def rerank(rows: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    """(doc, at, *more, rank, first) of the positions whose name (hi, lo) another position has too; equal names have equal ranks, in the names' order.

    rows: hi, lo, doc, at, more (all long). Equal rows count once. `first`: the first position, by doc and at, of its rank.
    """
    names = ["hi", "lo", "doc", "at", *more]
    table = written(rows.select(*names), "names")
    order = names[:4]
    dealt = table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds = ["part", "place", "single", "opens", *names[2:], "groups", "first_hi", "first_lo", "last_hi", "last_lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, place, tied, part = None, None, 0, False, 0

        def out(columns: list[np.ndarray], places: np.ndarray, single: np.ndarray, opens: np.ndarray, ends: list | None = None) -> pa.RecordBatch:
            n = len(places)
            known = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(places), pa.array(single), pa.array(opens), *(pa.array(c) for c in columns[2:])]
            return pa.RecordBatch.from_arrays([*known, *(pa.nulls(n, pa.int64()) if ends is None else pa.array([x]) for x in ends or [None] * 5)], names=kinds)

        for b in batches:
            if not b.num_rows:
                continue
            part, columns = b["part"][0].as_py(), _as_long(b, names)
            if held is not None:
                columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
            equal = [c[1:] == c[:-1] for c in columns[:4]]
            again = equal[0] & equal[1] & equal[2] & equal[3]
            if again.any():
                columns = [c[np.append(True, ~again)] for c in columns]
            same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
            head = head or (int(columns[0][0]), int(columns[1][0]))
            places = place + np.append(0, np.cumsum(~same))
            before = np.append(tied, same)
            alone = ~before[:-1] & ~same
            take = np.flatnonzero(~alone | (places[:-1] == 0))
            if len(take):
                yield out([c[take] for c in columns], places[take], alone[take], ~before[take])
            held, place, tied = [c[-1:] for c in columns], int(places[-1]), bool(before[-1])
        if held is not None:
            yield out(held, np.array([place]), np.array([not tied]), np.array([not tied]))
            yield out([np.zeros(1, dtype=np.int64)] * len(names), np.array([-1]), np.array([True]), np.array([False]), [place + 1, *head, int(held[0][0]), int(held[1][0])])

    longs = ", ".join(f"{c} long" for c in kinds[4:])
    found = written(dealt.mapInArrow(run, f"part int, place long, single boolean, opens boolean, {longs}"), "ranks")
    discard(table)
    by = Window.orderBy("part")
    # A row for each part of the sort: what is broadcast has as many rows as shuffles have parts.
    parts = found.where("groups IS NOT NULL").select("part", "groups", "first_hi", "first_lo", "last_hi", "last_lo")
    parts = parts.withColumn("left", F.coalesce((F.col("first_hi") == F.lag("last_hi").over(by)) & (F.col("first_lo") == F.lag("last_lo").over(by)), F.lit(False)))
    base = F.sum(F.col("groups") - F.col("left").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("groups")
    parts = parts.select("part", base.alias("base"), "left", F.coalesce(F.lead("left").over(by), F.lit(False)).alias("right"), (F.col("groups") - 1).alias("end"))
    rows = found.where("groups IS NULL").join(F.broadcast(parts), "part")
    goes_on = (F.col("place") == 0) & F.col("left")
    keep = ~F.col("single") | goes_on | (F.col("place") == F.col("end")) & F.col("right")
    return rows.where(keep).select("doc", "at", *more, (F.col("base") + F.col("place")).alias("rank"), (F.col("opens") & ~goes_on).alias("first"))


def _by_text(rows: DataFrame, names: list[str], work, schema: str, order: list[str]) -> DataFrame:
    """work over whole texts' rows at a time: a list of columns, after it the rows' text numbers; it gives a batch or None."""
    sorted_rows = rows.repartition("doc").sortWithinPartitions("doc", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(columns: list[np.ndarray]) -> pa.RecordBatch | None:
            doc, salt = columns[0], columns[1] >> 48
            return work(columns, np.append(0, np.cumsum((doc[1:] != doc[:-1]) | (salt[1:] != salt[:-1]))))

        for b in batches:
            if not b.num_rows:
                continue
            columns = _as_long(b, names)
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            turns = np.flatnonzero(columns[0][1:] != columns[0][:-1])
            cut = int(turns[-1]) + 1 if len(turns) else 0
            if cut and (out := done([c[:cut] for c in columns])) is not None:
                yield out
            held = [c[cut:] for c in columns]
        if held is not None and (out := done(held)) is not None:
            yield out

    return sorted_rows.select(*names).mapInArrow(run, schema)


def _pairs(ranks: DataFrame, limit: int) -> DataFrame:
    """Of each position whose string is not past the limit: its rank, and that of the furthest position that its string reaches, as the name of the string of both."""

    def work(columns: list[np.ndarray], number: np.ndarray) -> pa.RecordBatch | None:
        doc, at, size, rank = columns
        place = (number << 34) + _place(at)
        other = np.searchsorted(place, place + size, side="right") - 1
        take = np.flatnonzero((other > np.arange(len(place))) & (size < limit))
        if not len(take):
            return None
        gap = place[other[take]] - place[take]
        return _batch(["hi", "lo", "doc", "at", "size"], [rank[take], rank[other[take]] << 12 | gap, doc[take], at[take], gap + size[other[take]]])

    return _by_text(ranks, ["doc", "at", "size", "rank"], work, "hi long, lo long, doc long, at long, size long", ["at"])


def _states(levels: list[DataFrame], length: int) -> DataFrame:
    """doc, at, rank (the first), state of each position that has a first rank: 1 if a longer repeat covers all its strings, 2 if that repeat's first position is in
    its text and stands for the others, 3 if it is open. And rows of state 0: in rank, the first and last start of a run of strings within longer repeats.

    A string that lies in no longer repeat meets any equal one: that one's position is open or stands for its repeat, or lies in a repeat that an
    earlier position stands for, and so on down to one that is open or stands. A string in a longer repeat is told by its run.
    """
    rows = [df.select("doc", "at", F.lit(k).cast("long").alias("level"), "rank", "size", F.col("first").cast("long").alias("first")) for k, df in enumerate(levels)]
    every = rows[0]
    for df in rows[1:]:
        every = every.union(df)

    def work(columns: list[np.ndarray], number: np.ndarray) -> pa.RecordBatch | None:
        doc, at, level, rank, size, first = columns
        base, low = number << 34, np.flatnonzero(level == 0)
        place = base + _place(at)
        reach = np.maximum.accumulate(place + size)
        best = np.maximum.accumulate(np.where(place + size == reach, np.arange(len(at)), 0))
        from_, to = (base + _first(at))[low], (base + _last(at))[low] + length
        k = np.searchsorted(place, from_, side="right") - 1
        covered = (k >= 0) & (reach[np.maximum(k, 0)] >= to)
        state = np.where(covered, 1 + first[best[np.maximum(k, 0)]], 3)
        # Runs of starts whose strings lie in longer repeats, those of open positions too.
        chain = np.flatnonzero(size >= length)
        begin, end = place[chain], np.maximum.accumulate((place + size)[chain] - length)
        opens = np.append(True, begin[1:] > end[:-1] + 1)[: len(chain)]
        heads, tails = np.flatnonzero(opens), np.flatnonzero(np.append(opens[1:], True)[: len(chain)])
        own = chain[heads]
        run = (begin[heads] - base[own]) << 32 | end[tails] - base[own]
        return _batch(["doc", "at", "rank", "state"], [np.append(doc[low], doc[own]), np.append(at[low], at[own]), np.append(rank[low], run), np.append(state, np.zeros(len(own), dtype=np.int64))])

    return _by_text(every, ["doc", "at", "level", "rank", "size", "first"], work, "doc long, at long, rank long, state long", ["at", "level"])


def _contexts(texts: DataFrame, contents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (doc, at, rank, state, n) with `bytes`, from the first to the end of the last of a position's strings: read from one text of each content."""
    lists = wanted.groupBy("doc", F.shiftright("at", 48).alias("salt")).agg(F.collect_list(F.struct("at", "rank", "state", "n")).alias("wanted"))
    lists = lists.join(contents.select("doc", "salt", F.col("doc_id").alias("chosen")), ["doc", "salt"])
    chosen = texts.where(F.octet_length("text") >= length).join(lists, ["doc", "salt"]).where(F.col("doc_id").eqNullSafe(F.col("chosen"))).select("text", "doc", "wanted")
    names = ["doc", "at", "rank", "state", "n", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
            for text, doc, wanted in zip(b["text"], b["doc"].to_pylist(), b["wanted"], strict=True):
                x = wanted.values
                at = x.field("at").to_numpy()
                data = text.as_buffer()
                view = memoryview(data)
                pieces = [bytes(view[i:j]) for i, j in zip(_first(at).tolist(), (_last(at) + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), *(x.field(c) for c in names[1:5]), pa.array(pieces, pa.binary())], names=names)

    return chosen.mapInArrow(run, "doc long, at long, rank long, state long, n long, bytes binary")


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """doc, at, first, last: runs of starts of the open positions' strings that another position of their group has too. Groups are whole in one task, many to a comparison."""
    names = ["doc", "at", "rank", "state", "bytes"]
    dealt = contexts.select(*names).repartition("rank").sortWithinPartitions("rank", "doc", "at")

    def compare(rows: list[np.ndarray], pieces: list[bytes]) -> pa.RecordBatch | None:
        doc, at, rank, state = rows
        new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))  # a repeated row has been read twice
        counts = np.where(new, _last(at) - _first(at) + 1, 0)
        digest = xxhash.xxh3_64_intdigest
        names_ = np.fromiter((digest(p[k : k + length]) for p, n in zip(pieces, counts.tolist(), strict=True) for k in range(n)), dtype=np.uint64, count=int(counts.sum()))
        row = np.repeat(np.arange(len(doc)), counts)
        start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + _first(at)[row]
        order = np.lexsort((names_, rank[row]))
        group, name = rank[row][order], names_[order]
        same = (group[1:] == group[:-1]) & (name[1:] == name[:-1])
        repeated = np.zeros(len(row), dtype=bool)
        repeated[order] = np.append(same, False) | np.append(False, same)
        hits = np.flatnonzero(repeated & (state[row] == 3))
        if not len(hits):
            return None
        opens = np.append(True, (np.diff(start[hits]) != 1) | (np.diff(row[hits]) != 0))
        lows, highs = hits[opens], hits[np.append(opens[1:], True)]
        return _batch(["doc", "at", "first", "last"], [doc[row[lows]], at[row[lows]], start[lows], start[highs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces = None, []
        for b in (whole.slice(k, GROUP) for whole in batches for k in range(0, whole.num_rows, GROUP)):
            columns = _as_long(b, names[:4])
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            pieces += b["bytes"].to_pylist()
            turns = np.flatnonzero(held[2][1:] != held[2][:-1])
            if len(turns) and len(pieces) >= GROUP:
                cut = int(turns[-1]) + 1
                if (out := compare([c[:cut] for c in held], pieces[:cut])) is not None:
                    yield out
                held, pieces = [c[cut:] for c in held], pieces[cut:]
        if pieces and (out := compare(held, pieces)) is not None:
            yield out

    return dealt.mapInArrow(run, "doc long, at long, first long, last long")


def _sorted_strings(contexts: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size, by ranges of offsets: how far before its position a string begins, equal for equal strings.

    Of a range, a position has the bytes that all its strings share, and those that they cover. If no other position has the shared bytes, none of its
    strings is repeated; if one has the covered bytes, all are, and the first position of these stands for the others. What is left is cut in PIECES
    and looked at again. So a position has rows for the ends of its repeats only, not one for each of its strings.
    """
    width, nodes, levels = length - length // 2 + 1, None, []
    whole, contexts = width - 1, contexts.select("doc", "at", "bytes")
    while width > 1 and (nodes is None or not nodes.isEmpty()):
        width = -(-width // PIECES)

        # A node is 16 bits each for its least and its greatest offset; its last bit in a name tells the shared bytes (1) from the covered ones.
        def run(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            digest = xxhash.xxh3_128_digest
            for b in (x.slice(k, 4096) for x in batches for k in range(0, x.num_rows, 4096)):
                digests, rows, names = [], [], []
                doc, at = _as_long(b, ["doc", "at"])
                for row, (piece, most, least, own) in enumerate(zip(b["bytes"].to_pylist(), (at >> 8 & 0xFF).tolist(), (at & 0xFF).tolist(), b["nodes"].to_pylist(), strict=True)):
                    for low, end in ((low, n & 0xFFFF) for n in own for low in range(n >> 16, (n & 0xFFFF) + 1, width)):
                        high = min(low + width - 1, end)
                        if low > most or high < least:
                            continue
                        name = (low << 16 | high) << 1
                        if low < high:
                            digests.append(digest(piece[most - low : most - high + length], name | 1))
                            rows.append(row)
                            names.append(name | 1)
                        if low >= least and high <= most:
                            digests.append(digest(piece[most - high : most - low + length], name))
                            rows.append(row)
                            names.append(name)
                if rows:
                    yield _batch(["hi", "lo", "doc", "at", "name"], [*np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).T.copy(), doc[rows], at[rows], np.array(names, dtype=np.int64)])

        if nodes is None:
            asked = contexts.withColumn("nodes", F.array(F.lit(whole).cast("long")))
        else:
            asked = contexts.join(nodes.groupBy("doc", "at").agg(F.collect_list("node").alias("nodes")), ["doc", "at"])
        named = asked.select("doc", "at", "bytes", "nodes").mapInArrow(run, "hi long, lo long, doc long, at long, name long")
        covered = F.col("name").bitwiseAND(1) == 0
        found = rerank(named, ["name"]).groupBy("doc", "at", F.shiftright("name", 1).alias("node"))
        found = found.agg(F.bool_or(covered).alias("covered"), F.bool_or(~covered).alias("shared"), F.bool_or(covered & ~F.col("first")).alias("stood"))
        levels.append(written(found, "offsets"))
        nodes = levels[-1].where("shared AND NOT stood").select("doc", "at", "node")
    every = levels[0]
    for df in levels[1:]:
        every = every.union(df)
    place = F.shiftright("at", 16).bitwiseAND(0xFFFFFFFF)
    return every.where("covered").select("doc", "at", (place - F.col("node").bitwiseAND(0xFFFF)).alias("first"), (place - F.shiftright("node", 16)).alias("last"))


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc, salt (the text's hashes), spans (array of start, end, in bytes): what of each content that holds any is covered by strings of `length` bytes that also start elsewhere. 16 <= length <= 500."""
    if not 16 <= length <= 500:
        raise ValueError(f"length {length}: 16 to 500")
    texts = _texts(docs)
    contents = written(texts.groupBy("doc", "salt").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).cast("long").alias("n_bytes")), "contents")
    limit = length + (length - length // 2)  # strings of this size cover all strings of a position beside them
    levels = [written(rerank(_sampled(texts, length)).withColumn("size", F.lit(length // 2).cast("long")), "ranks-0")]
    while len(levels) <= ROUNDS and not levels[-1].isEmpty():
        levels.append(written(rerank(_pairs(levels[-1], limit), ["size"]), f"ranks-{len(levels)}"))
    states = written(_states(levels, length), "states")
    discard(*levels)
    apart = states.where("state > 1")
    groups = apart.groupBy("rank").agg(F.max("state").alias("open"), F.count("*").alias("n")).where("open = 3 AND n > 1").select("rank", "n")
    contexts = written(_contexts(texts, contents, apart.join(groups, "rank"), length), "contexts")
    runs = _compared(contexts.where(F.col("n") <= GROUP), length)
    if not (large := contexts.where(F.col("n") > GROUP)).isEmpty():
        runs = runs.union(_sorted_strings(large, length))
    covered = states.where("state = 0").select("doc", "at", F.shiftright("rank", 32).alias("first"), F.col("rank").bitwiseAND(0xFFFFFFFF).alias("last"))
    copied = contents.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("doc", F.shiftleft("salt", 48).alias("at"), F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - length).alias("last"))

    def work(columns: list[np.ndarray], number: np.ndarray) -> pa.RecordBatch:
        doc, salt, first, last = columns[0], columns[1] >> 48, *columns[2:]
        base = number << 34
        order = np.argsort(base + first, kind="stable")
        low, high = (base + first)[order], np.maximum.accumulate((base + last)[order] + length)
        opens = np.append(True, low[1:] > high[:-1])
        which = number[order][opens]
        heads = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        spans = pa.StructArray.from_arrays([pa.array(low[opens] - base[order][opens]), pa.array(high[np.append(opens[1:], True)] - base[order][opens])], names=["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(which)).astype(np.int32)), spans)
        return pa.RecordBatch.from_arrays([pa.array(doc[order][opens][heads]), pa.array(salt[order][opens][heads]), lists], names=["doc", "salt", "spans"])

    every = covered.union(runs).union(copied).withColumn("salt", F.shiftright("at", 48))
    spans = written(_by_text(every, ["doc", "at", "first", "last"], work, "doc long, salt long, spans array<struct<start:bigint,end:bigint>>", ["salt"]), "spans")
    discard(contents, states, contexts)
    return spans


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal, start and end in bytes), kept (the remaining bytes): a row for each row of docs (doc_id, text)."""
    found = repeated_spans(docs, length)
    joined = _texts(docs).join(found, ["doc", "salt"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            sizes, spans, kept = [], [], []
            for text, some in zip(b["text"], b["spans"].to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                cuts = [0, *(x for s in some or () for x in (s["start"], s["end"])), len(data)]
                sizes.append(len(data))
                spans.append(some or [])
                kept.append(b"".join(data[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, schema)
