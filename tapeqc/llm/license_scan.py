"""License scan: phrases, and text blocks that contain a license template's words.

For each template a text is cut into blocks half as long again as the template, each a half of the template after the one before, so that every place
where the template's words could stand lies whole in a block. A block matches when it holds at least `threshold` of the template's
distinct words: an exact set-similarity join. The templates' words are ordered by the number of documents that hold them, counted over all
documents, rarest first. A block can match only if it holds one of the template's rarest words, its prefix, one more than may be missing (prefix
filter); if it has so many of the template's words at all, repeats counted (length filter); and if from its rarest one on there are enough
left both in the template and among the block's words, repeats counted (positional filter). These need counts alone; only blocks that pass have
their distinct words counted, and no block that matches is missed.

Defined results: a null text is empty: no words, no labels, score 0. Words are runs of digits, lower-cased ASCII letters and all
characters from U+0080 on. Repeated rows each give a row, null ids are kept; texts may be of any length. Of blocks that hold equally much of a
template the first counts. An empty table gives none; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licenses import TEXTS

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_AS_WORDS).split()


def template_counts(docs: DataFrame, templates: dict[str, str] = TEXTS) -> dict[bytes, int]:
    """For each word of the templates the number of documents that hold it; a few hundred counts at most reach the driver."""
    own = sorted({w for t in templates.values() for w in words_of(t)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = frozenset(own), dict.fromkeys(own, 0)
        for b in batches:
            for text in b["text"]:
                for w in wanted.intersection(words_of(text.as_py())):
                    found[w] += 1
        yield pa.RecordBatch.from_pydict({"word": own, "n": [found[w] for w in own]}, pa.schema({"word": pa.binary(), "n": pa.int64()}))

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(own, 0) | {bytes(r.word): r.n for r in rows}


class Templates:
    """Templates as sets of word numbers, rarest word first."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float):
        order = sorted(counts, key=lambda w: (counts[w], w))
        self.number = {w: k for k, w in enumerate(order)}
        words = {name: words_of(t) for name, t in templates.items()}
        self.step = {name: max(1, -(-len(w) // 2)) for name, w in words.items()}
        self.width = {name: len(w) + self.step[name] for name, w in words.items()}
        self.rank = {name: self._ranks(w) for name, w in words.items()}
        self.size = {name: int(r.max(initial=-1)) + 1 for name, r in self.rank.items()}
        self.needed = {name: max(1, ceil(threshold * n - 1e-9)) for name, n in self.size.items()}
        self.prefix = {name: n - self.needed[name] + 1 for name, n in self.size.items()}
        self.prefixes = frozenset(w for w, k in self.number.items() if any(0 <= r[k] < self.prefix[name] for name, r in self.rank.items()))

    def _ranks(self, words: list[bytes]) -> np.ndarray:
        """For each word number its place among the template's words, the rarest first; -1 for words that are none of it. One more for words of no template."""
        out = np.full(len(self.number) + 1, -1, dtype=np.int32)
        own = sorted({self.number[w] for w in words})
        out[own] = np.arange(len(own))
        return out

    def best(self, words: list[bytes], seen: Counter | None = None) -> dict[str, tuple[float, int]]:
        """label: (largest containment, first word of the first block that has it) of the blocks that match. seen: counts blocks and what each filter leaves."""
        if self.prefixes.isdisjoint(words):
            return {}
        none, found = len(self.number), {}
        ids = np.fromiter((self.number.get(w, none) for w in words), dtype=np.int32, count=len(words))
        for name, ranks in self.rank.items():
            rank, step, width, need = ranks[ids], self.step[name], self.width[name], self.needed[name]
            at = np.flatnonzero(rank >= 0)
            rank = rank[at]
            hits = at[rank < self.prefix[name]]
            if not len(hits):
                continue
            low = np.maximum(0, -(-(hits - width + 1) // step))
            blocks = np.unique(np.concatenate([np.minimum(low + k, hits // step) for k in range(-(-width // step) + 1)]))
            los, his = np.searchsorted(at, blocks * step), np.searchsorted(at, blocks * step + width)
            enough = np.flatnonzero(his - los >= need)  # length filter
            if seen is not None:
                seen.update({"blocks": -(-len(words) // step), "prefix": len(blocks), "length": len(enough)})
            for k in enough.tolist():
                own = rank[los[k] : his[k]]
                least = int(own.min())
                if 1 + min(self.size[name] - least - 1, int(np.count_nonzero(own > least))) < need:  # positional filter
                    continue
                held = len(np.unique(own))
                if seen is not None:
                    seen.update({"positional": 1, "matching": int(held >= need)})
                if held >= need and held / self.size[name] > found.get(name, (0.0, 0))[0]:
                    found[name] = (held / self.size[name], int(blocks[k]) * step)
        return found


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after another, in order."""
    found = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        k = -1
        try:
            while True:
                k = words.index(parts[-1], k + 1)
                start = k - len(parts) + 1
                if start >= 0 and words[start : k + 1] == parts:
                    found.append((start, label))
        except ValueError:
            continue
    return sorted(found)


OUT = pa.schema({"doc_id": pa.int64(), "n_words": pa.int64(), "places": pa.list_(pa.struct({"word": pa.int64(), "label": pa.string()})), "blocks": pa.list_(pa.struct({"label": pa.string(), "containment": pa.float64(), "word": pa.int64()}))})


def scan(docs: DataFrame, templates: dict[str, str] = TEXTS, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, places (word, label: where a phrase stands), blocks (label, containment, word: each matching template's best block)."""
    found = Templates(templates, template_counts(docs, templates), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {"doc_id": b["doc_id"].to_pylist(), "n_words": [], "places": [], "blocks": []}
            for text in b["text"]:
                words = words_of(text.as_py())
                rows["n_words"].append(len(words))
                rows["places"].append([{"word": k, "label": label} for k, label in phrase_places(words)])
                rows["blocks"].append([{"label": k, "containment": c, "word": w} for k, (c, w) in sorted(found.best(words).items())])
            yield pa.RecordBatch.from_pydict(rows, OUT)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, places array<struct<word: long, label: string>>, blocks array<struct<label: string, containment: double, word: long>>")
