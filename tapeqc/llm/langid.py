"""Language identification by words first, then shorter and shorter character n-grams.

A model holds the log frequencies, in each language, of all words and of all character n-grams of 1 to 4 characters in words that it met at least
`least` times, as sorted sparse tables: a key has an entry for each language that it was met in, so that a model grows with the rows that it
learns from, which are bounded, and not with the square of the languages. A word that the model knows scores by its own frequencies; another one
by those of its longest n-grams of which any is known. A text's language is the one with the largest sum.

Words are runs of letters and of the marks that combine with them; digits and number signs are no letters.

Defined results: a null text, and one without a letter, is `und` with score 0; so is every text if nothing was learned, as from an empty table.
Ties go to the language that comes first. Whole texts are read; texts may be of any length. Null languages are not learned. Repeated
rows are learned and predicted each; other columns are kept, but for ones named as the result's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_WORD = re.compile(r"[^\W\d_]+")
#: What _WORD takes for letters and is none, and marks, at which it parts words; and words in texts that have any.
_ODD, _LETTERS = regex.compile(r"[\p{No}\p{Nl}\p{M}]"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LONGEST = 4
#: Words whose rows a Python worker remembers at most, and numbers in these rows; results don't depend on them.
_REMEMBERED, _CELLS = 100_000, 10_000_000
#: Odd multipliers of an n-gram's characters, and of its length.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _grams(word: str, n: int) -> list[str]:
    word = f"^{word}$"
    return [word[k : k + n] for k in range(len(word) - n + 1)]


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case."""
    text = (text or "").lower()
    return _WORD.findall(text) if text.isascii() or not _ODD.search(text) else _LETTERS.findall(text)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def _gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each n characters that follow one another in codes."""
    keys = np.repeat(_MIX[-1:] * np.uint64(n), max(0, len(codes) - n + 1))
    for k in range(n):
        keys += codes[k : k + len(keys)] * _MIX[k]
    return keys


def _word_keys(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], dtype=np.uint64)


def _places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return at, known[at] == keys if len(known) else np.zeros(len(keys), dtype=bool)


@dataclass
class SparseTable:
    """Sorted 64-bit keys, and for each a run of entries: a language, and how far the log of the key's frequency in it stands above that of a key not met."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, gains: np.ndarray) -> SparseTable:
        order = np.argsort(keys, kind="stable")
        found, starts = np.unique(keys[order], return_index=True)
        return cls(found, np.append(starts, len(keys)), langs[order].astype(np.int32), gains[order].astype(np.float32))

    def add(self, out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Adds the entries of the keys at `at` to the rows of out (rows x languages)."""
        counts = self.starts[at + 1] - self.starts[at]
        entry = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.starts[at], counts)
        np.add.at(out, (np.repeat(rows, counts), self.langs[entry]), self.gains[entry])


@dataclass
class LanguageModel:
    """languages, and the tables of words and of n-grams."""

    languages: list[str]
    words: SparseTable
    grams: SparseTable

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's row: its own, or the mean of its longest n-grams of which any is known, or zeros; and whether it or two characters in turn are known."""
        out = np.zeros((len(words), len(self.languages)))
        at, known = _places(self.words.keys, _word_keys(words))
        self.words.add(out, np.flatnonzero(known), at[known])
        familiar = known.copy()
        left = np.flatnonzero(~known)
        for n in range(_LONGEST, 0, -1):
            if not len(left) or not self.languages:
                break
            codes = _codes("".join(f"^{words[k]}$" for k in left))
            owner = np.repeat(np.arange(len(left)), [len(words[k]) + 2 for k in left])
            keys = _gram_keys(codes, n)
            of = owner[: len(keys)]
            at, there = _places(self.grams.keys, keys)
            there &= of == owner[n - 1 :]
            of, at = of[there], at[there]
            found = np.bincount(of, minlength=len(left))
            self.grams.add(out, left[of], at)
            out[left[found > 0]] /= found[found > 0, None]
            familiar[left[found > 0]] = n > 1
            left = left[found == 0]
        return out, familiar


class _Rows(dict):
    """word: its row in a matrix, last whether it is familiar; rows are added as words come and, past a bound, forgotten."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.matrix, self.new = np.zeros((1000, len(self.model.languages) + 1), dtype=np.float32), []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return len(self) - 1

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The sum of the rows of each text's words."""
        rows = [np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]
        n = len(self)
        if n > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros((max(n, len(self.matrix) * 3 // 2) - len(self.matrix), self.matrix.shape[1]), dtype=np.float32)])
        step = max(100, min(10_000, _CELLS // (len(self.model.languages) + 1)))
        for k in range(0, len(self.new), step):
            part = self.new[k : k + step]
            at = n - len(self.new) + k
            self.matrix[at : at + len(part), :-1], self.matrix[at : at + len(part), -1] = self.model.rows(part)
        out = [self.matrix[r].sum(axis=0, dtype=np.float64) for r in rows]
        self.new = []
        if n > min(_REMEMBERED, _CELLS // (len(self.model.languages) + 1)):
            self.forget()
        return out


def sampled(docs: DataFrame, most: int, n: int) -> DataFrame:
    """About `most` of n rows: those whose 63-bit hash of doc_id and text is small enough, whatever n is."""
    if n <= most:
        return docs
    return docs.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) < F.lit((1 << 63) * most // n))


def fit(docs: DataFrame, max_docs: int = 20_000, least: int = 2) -> LanguageModel:
    """Learns from docs (doc_id, text, lang); rows with a null text or lang are left out.

    The fit takes about `max_docs` rows, those with the smallest hash of text and doc_id: that bounds the model, which keeps every word and n-gram that
    they hold at least `least` times in all, whatever the number of languages.
    """
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    docs = sampled(docs, max_docs, docs.select("lang").count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            found: dict[str, Counter] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"], strict=True):
                found.setdefault(lang, Counter()).update(words_of(text.as_py()))
            rows = [(lang, 0, w, c) for lang, words in found.items() for w, c in words.items()]
            for lang, words in found.items():
                grams = Counter()
                for w, c in words.items():
                    for k in range(1, _LONGEST + 1):
                        for g in _grams(w, k):
                            grams[k, g] += c
                rows += [(lang, k, g, c) for (k, g), c in grams.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_COUNTS.types)], schema=_COUNTS)

    counts = written(docs.select("text", "lang").mapInArrow(count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "language-counts")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, languages)).cast("array<string>"), F.col("lang")) - 1
    everywhere = F.sum("c").over(Window.partitionBy("n", "gram"))
    own = counts.withColumn("all", everywhere).where(F.col("all") >= least).select("n", "gram", number.cast("int").alias("lang"), "c").toArrow()
    sizes, langs, own_c = (own[x].to_numpy() for x in ("n", "lang", "c"))
    totals = np.ones((_LONGEST + 1, len(languages)))
    for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect():
        totals[r.n, languages.index(r.lang)] = r.c
    floor = 0.5 / totals.max(axis=1, initial=1)  # one for all languages, else what a small one lacks would speak for it
    keys = np.zeros(len(own), dtype=np.uint64)
    for size in range(_LONGEST + 1):
        at = np.flatnonzero(sizes == size)
        texts = own["gram"].take(pa.array(at)).to_pylist()
        keys[at] = _gram_keys(_codes("".join(texts)), size)[::size] if size else _word_keys(texts)

    gains = np.log(own_c / totals[sizes, langs] + floor[sizes]) - np.log(floor[sizes])
    table = lambda of: SparseTable.of(keys[of], langs[of], gains[of])
    return LanguageModel(languages, table(sizes == 0), table(sizes > 0))


_COUNTS = pa.schema({"lang": pa.string(), "n": pa.int32(), "gram": pa.string(), "c": pa.int64()})


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred string, score double, familiar double.

    score: the share of the best language when a text's evidence counts as that of ten words. familiar: the share of the text's words
    that the model knows or of which it knows two characters or more in turn, in any language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop("lang_pred", "score", "familiar").schema
    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(shared.value)
        languages = shared.value.languages
        for b in (whole.slice(k, 100) for whole in batches for k in range(0, whole.num_rows, 100)):
            texts = [words_of(text.as_py()) for text in b["text"]]
            found, scores, familiar = [], [], []
            for words, x in zip(texts, rows.scores(texts), strict=True):
                if not words or not languages:
                    found.append("und")
                    scores.append(0.0)
                    familiar.append(0.0)
                    continue
                familiar.append(float(x[-1]) / len(words))
                x = x[:-1]
                x = np.exp((x - x.max()) * min(1.0, 10 / len(words)))
                found.append(languages[int(np.argmax(x))])
                scores.append(float(x.max() / x.sum()))
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(familiar, pa.float64())], names=[*names, "lang_pred", "score", "familiar"])

    own = docs.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names])
    return own.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double").add("familiar", "double"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
