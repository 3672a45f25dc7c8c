"""Mixing sources to target weights, by blocks of words.

Each source's documents stand one after another as one stream of words, cut into blocks of `block_words`. The mix is a row of slots in
`n_shards` output shards: each shard draws how many slots each source gets from a multinomial distribution, and what the draws of all
shards leave over or lack is settled in the last ones, so that every source gets exactly the slots of its target. Sources are as many as there are: they are
numbered by a range sort, and drawn in groups of GROUP, the groups first and then the sources within each, in a task of its own. A source's slots
run through its blocks in a pseudorandom order, a new one after each pass, and are joined with the blocks by index.

Defined results: a null text has no words and is never taken; a null source is a source of its own, the last in order; rows that
repeat are documents of their own; an empty table gives an empty mix; null ids are kept; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered, running, with_offsets
from .shared import discard, written

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that are drawn together; the driver holds a row of shards for each such group.
GROUP = 16_384
_EXPLODED = 4096
#: The column of a mix's tables that numbers its rows; a column of docs by that name means nothing.
ROW = "_mix_row"


def fill_level(sizes: DataFrame, share: float, most: float) -> float | None:
    """The words that a source gets for each unit of its weight, if it stays below `most` times its words; None if no source does.

    sizes: n, weight. In the order of their caps for each unit of weight, sources are full as long as what is left, shared by the weights that are left,
    would be above their cap; the first one that is not sets the level of all after it.
    """
    cap, ratio = (F.col("n") * F.lit(float(most))).alias("cap"), (F.col("n") * F.lit(float(most)) / F.col("weight")).alias("ratio")
    equal = sizes.where("n > 0").select(cap, ratio, "weight").groupBy("ratio").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
    whole = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("weight"))), F.lit(0)).alias("weight")).first()
    placed = running(equal, ["ratio"], {"full": "cap", "gone": "weight"})
    level = (F.lit(float(share) * float(whole.n)) - F.col("full")) / (F.lit(float(whole.weight)) - F.col("gone"))
    first = placed.select("ratio", level.alias("level")).where("level < ratio").agg(F.min(F.struct("ratio", "level")).alias("x")).first().x
    return None if first is None else first.level


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key: four Feistel rounds over the next power of four, walked until below n."""
    n = np.asarray(n, dtype=np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, n).astype(float)) / 2)).astype(np.uint64))
    half = half + ((np.uint64(1) << (np.uint64(2) * half)) < n)  # in case the logarithm was rounded down
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = np.array(i, dtype=np.uint64), np.ones(len(i), dtype=bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            if inverse:
                left, right = right ^ (_mixed(left + k + np.uint64(7919 * (3 - turn))) & m), left
            else:
                left, right = right, left ^ (_mixed(right + k + np.uint64(7919 * turn)) & m)
        x[todo] = (left << h) | right
        todo[todo] = x[todo] >= n[todo]
    return x


def _keys(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(np.asarray(source, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(np.asarray(epoch, dtype=np.uint64) + np.uint64(seed)))


def slots_needed(size: int, target: int, block_words: int, source: int, seed: int) -> tuple[int, int]:
    """How many slots hold the first `target` words of a source's passes, and how many words of the last slot count."""
    blocks, (passes, rest) = -(-size // block_words), divmod(target, size)
    if not rest:
        return passes * blocks, block_words
    tail = size - (blocks - 1) * block_words
    with np.errstate(over="ignore"):
        at = int(permuted(np.array([blocks - 1]), np.array([blocks]), _keys(np.array([source]), np.array([passes]), seed), inverse=True)[0])
    before = at * block_words
    if rest <= before:
        n = -(-rest // block_words)
        return passes * blocks + n, rest - (n - 1) * block_words
    if rest <= before + tail:
        return passes * blocks + at + 1, rest - before
    n = -(-(rest - before - tail) // block_words)
    return passes * blocks + at + 1 + n, rest - before - tail - (n - 1) * block_words


def even_rooms(total: int, n_shards: int) -> np.ndarray:
    """Slots of each shard: as equal as can be."""
    room = np.full(n_shards, total // n_shards, dtype=np.int64)
    room[: total % n_shards] += 1
    return room


def shard_counts(slots: np.ndarray, room: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """Slots of each source (columns) in each shard (rows): multinomial draws, settled so that each column and row has the sum it should."""
    wanted, n_shards = np.array(slots, dtype=np.int64), len(room)
    total = int(wanted.sum())
    if not total:
        return np.zeros((n_shards, len(slots)), dtype=np.int64)
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed)))
    counts = rng.multinomial(room, wanted / total)
    left, out = wanted.copy(), np.zeros_like(counts)
    for k in range(n_shards):
        out[k] = np.minimum(counts[k], left)
        left -= out[k]
    for k in range(n_shards):
        free = int(room[k] - out[k].sum())
        for s in np.flatnonzero(left) if free else ():
            more = min(free, int(left[s]))
            out[k, s] += more
            left[s] -= more
            free -= more
            if not free:
                break
    return out


class Mix:
    """A mix of `docs` (doc_id, text, source): its documents' places, its slots and what it takes of each document.

    weights: a source's weight by its place in code point order, null last; shorter lists repeat. `share` of all words are taken, of no
    source more than `most` times its words. The same seed gives the same mix. numbers: a column of docs that numbers its rows, if there is one.
    """

    def __init__(self, docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 256, n_shards: int = 256, seed: int = 7, numbers: str | None = None):
        self.spark, self.block_words, self.seed, self.most = docs.sparkSession, block_words, seed, int(np.ceil(most))
        row = F.col(numbers) if numbers else F.monotonically_increasing_id()
        three = [F.col("doc_id").cast("long"), F.col("source"), F.col("text")]
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        own = docs.select(three[0].alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(*three).alias("_k"), row.alias(ROW), size.alias("size"))
        self.sizes = written(own, "mix-sizes")  # rows keep their numbers from here on
        found = numbered(self.sizes.groupBy("source").agg(F.sum("size").alias("n")), [F.col("source").isNull(), F.col("source")], "source_no")
        found = found.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
        found = written(found, "mix-numbers")
        level = fill_level(found, share, most)
        cap = F.col("n") * F.lit(float(most))
        aims = found.withColumn("target", cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))).select("source", "source_no", "n", "target")
        self.table = written(self._needed(aims), "mix-sources")
        discard(found)
        group = F.floor(F.col("source_no") / GROUP).alias("group")
        groups = sorted((r.group, r.slots) for r in self.table.groupBy(group).agg(F.sum("slots").alias("slots")).collect())  # one number for GROUP sources
        counts = shard_counts(np.array([n for _, n in groups], dtype=np.int64), even_rooms(sum(n for _, n in groups), n_shards), seed)
        self.total = int(counts.sum())
        rooms = self.spark.createDataFrame([(int(g), counts[:, k].tolist()) for k, (g, _) in enumerate(groups)], "group long, room array<long>")
        self.runs = written(self._drawn(self.table.withColumn("group", group).join(rooms, "group")), "mix-runs")

    def _needed(self, aims: DataFrame) -> DataFrame:
        block_words, seed = self.block_words, self.seed

        def run(batches):
            for b in batches:
                need = [slots_needed(int(n), round(t), block_words, int(k), seed) if n else (0, 0) for n, t, k in zip(b.n, b.target, b.source_no, strict=True)]
                yield pd.DataFrame({"source": b.source, "source_no": b.source_no, "source_size": b.n, "target": b.target, "blocks": -(-b.n // block_words), "slots": [x for x, _ in need], "last_words": [x for _, x in need]})

        return aims.mapInPandas(run, "source string, source_no long, source_size long, target double, blocks long, slots long, last_words long")

    def _drawn(self, sources: DataFrame) -> DataFrame:
        """A row for each shard and source that has slots in it, with the source's numbers: of each group in one task, the group's rooms given."""
        seed = self.seed

        def draw(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("source_no", ignore_index=True)
            counts = shard_counts(rows.slots.to_numpy(), np.asarray(rows.room[0], dtype=np.int64), [seed, int(rows.group[0]) + 1])
            firsts, (shard, k) = np.cumsum(counts, axis=0) - counts, np.nonzero(counts)
            own = rows.iloc[k]
            return pd.DataFrame({"shard": shard.astype("int32"), "source_no": own.source_no.to_numpy(), "first": firsts[shard, k], "n": counts[shard, k], "blocks": own.blocks.to_numpy(), "slots": own.slots.to_numpy(), "last": own.last_words.to_numpy()})

        return sources.select("group", "source_no", "blocks", "slots", "last_words", "room").groupBy("group").applyInPandas(draw, "shard int, source_no long, first long, n long, blocks long, slots long, last long")

    def sources(self) -> DataFrame:
        """source, source_no, source_size, target, blocks, slots, last_words: a row for each source."""
        return self.table

    def slots(self) -> DataFrame:
        """shard, source_no, slot (the source's how manieth), epoch (its how manieth pass), block, last_words: a row for each slot of the mix."""
        numbers = ["shard", "source_no", "blocks", "slots", "last"]
        starts = self.runs.select(*numbers, (F.col("first") + F.col("n") - 1).alias("end"), F.explode(F.expr(f"sequence(first, first + n - 1, {_EXPLODED})")).alias("start"))
        slots = starts.repartition(max(1, self.total // 500_000)).select(*numbers, F.explode(F.expr(f"sequence(start, least(start + {_EXPLODED - 1}, end))")).alias("slot"))
        seed, words = self.seed, self.block_words

        def place(batches):
            for b in batches:
                s, q, blocks = b.source_no.to_numpy(), b.slot.to_numpy(), b.blocks.to_numpy()
                epoch = q // blocks
                with np.errstate(over="ignore"):
                    block = permuted(q % blocks, blocks, _keys(s, epoch, seed))
                yield pd.DataFrame({"shard": b.shard, "source_no": s, "slot": q, "epoch": epoch.astype("int32"), "block": block.astype("int64"), "last_words": np.where(q == b.slots.to_numpy() - 1, b["last"].to_numpy(), words)})

        return slots.mapInPandas(place, "shard int, source_no long, slot long, epoch int, block long, last_words long")

    def pieces(self) -> DataFrame:
        """source_no, block, doc_id, ROW, size, start: for each document a row for each block that it has words in; none: a null block.

        `start` is the document's place in its source's stream, by a hash of id, source and text.
        """
        numbers = self.sources().select("source_no", "source", "source_size", "target")
        own = self.sizes.join(numbers, self.sizes["source"].eqNullSafe(numbers["source"])).select("source_no", "doc_id", "_k", ROW, "size", "source_size", "target")
        placed = with_offsets(own, ["source_no"], ["_k", ROW], {"start": "size"})
        b = self.block_words
        blocks = F.expr(f"if(size > 0, sequence(start div {b}, (start + size - 1) div {b}), null)")
        return placed.select("*", F.explode_outer(blocks).alias("block"))

    def taken(self) -> DataFrame:
        """A row for each piece and each slot that takes it: the pieces' columns and shard, slot, epoch, begin, n_words (words of the document).

        Pieces that no slot takes stay, with null slots and no words.
        """
        p, b = self.pieces(), self.block_words
        joined = p.join(self.slots().hint("merge"), ["source_no", "block"], "left")  # slots grow with the input
        begin = F.greatest(F.lit(0), F.col("block") * b - F.col("start"))
        end = F.least("size", F.col("block") * b + F.col("last_words") - F.col("start"))
        return joined.withColumn("begin", begin).withColumn("n_words", F.when(F.col("slot").isNull(), 0).otherwise(F.greatest(F.lit(0), end - F.col("begin"))).cast("long")).drop("last_words")

    def documents(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: a row for each document, `taken` the words that the mix takes, repeats counted."""
        key = [ROW, "doc_id", "size", "source_size", "target"]
        return self.taken().groupBy(*key).agg(F.sum("n_words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: docs' columns, a row for each pass that takes words of a document, its text cut to the words taken.

    A text that is taken whole stays as it is; of others the taken words stay, joined by single spaces. n_chars, if there, is set anew.
    Documents of which no words are taken, those without words among them, leave.
    """
    every = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    whole = written(docs.select(every.alias("_row"), F.monotonically_increasing_id().alias(ROW)), "mix-documents")
    mix = Mix(whole.select("_row.doc_id", "_row.source", "_row.text", ROW), numbers=ROW, **how)
    takes = mix.taken().where("n_words > 0").groupBy(ROW, "size", "epoch").agg(F.array_sort(F.collect_list(F.struct("begin", "n_words"))).alias("cuts"))
    takes = takes.select(F.col(ROW).alias("_of"), "size", "cuts")
    taken = whole.select(F.col(ROW).alias("_at"), "_row").join(takes, F.col("_at") == F.col("_of"))
    text = F.col("_row")["text"]
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    all_taken = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + c.n_words) == F.col("size")
    cut = F.when(all_taken, text).otherwise(F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(words, (c.begin + 1).cast("int"), c.n_words.cast("int")))), " "))
    out = taken.select("_row", cut.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
