"""Fill-in-middle: whole texts cut in three and their parts exchanged, and the exact way back.

A text's UTF-8 bytes stand in one bytearray. Its tokens' ends are scanned, two of them are the cuts, and sentinels go before the parts:
`<P>`prefix`<M>`middle`<S>`suffix. The order of the form is then made in place by one rotation: of what stands after the prefix (psm), or of
all (spm). A rotation is three reversals, done in blocks of fixed size from both ends. The way back finds the sentinels, turns by the opposite
amount, and takes the sentinels out. A text that holds a sentinel stays plain, so that what is found is always what was put in: sentinels
begin with `<` and end with `>`, and cannot overlap one another.

Defined results: a null or empty text is plain and empty; a null doc_id draws from `seed:` alone; rows that repeat are documents of their own; an
empty table gives no row; other columns, also those named like results, are left out; texts of any length are turned whole, in memory of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that a reversal exchanges at a time, and texts of one Arrow batch.
_SWAP, _ROWS = 1 << 16, 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TURNED = pa.schema({"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()})


def reverse(buffer: np.ndarray, lo: int, hi: int) -> None:
    """buffer[lo:hi] turned round in place, a block from either end at a time."""
    while hi - lo > 1:
        k = min(_SWAP, (hi - lo) // 2)
        left, right = buffer[lo : lo + k], buffer[hi - k : hi]
        keep = left.copy()
        left[:] = right[::-1]
        right[:] = keep[::-1]
        lo, hi = lo + k, hi - k


def rotate(buffer: np.ndarray, lo: int, mid: int, hi: int) -> None:
    """Exchanges buffer[lo:mid] and buffer[mid:hi] in place by three reversals."""
    reverse(buffer, lo, mid)
    reverse(buffer, mid, hi)
    reverse(buffer, lo, hi)


def token_ends(text: bytes) -> np.ndarray:
    """Where the tokens of a text end, in bytes: a word with the white space before it, or white space at the end of the text."""
    space = _SPACE[np.frombuffer(text, dtype=np.uint8)]
    if not len(space):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(space))


def _chars(part: memoryview) -> int:
    return int(np.count_nonzero(np.frombuffer(part, dtype=np.int8) >= -64)) if len(part) else 0


def turn(text: bytes, first: int, second: int, form: str) -> bytearray:
    """text, cut at two places in bytes, in the order of a form: psm or spm."""
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    view, middle, suffix = np.frombuffer(out, dtype=np.uint8), first + 3, second + 6
    rotate(view, middle if form == "psm" else 0, suffix, len(view))
    return out


def turn_back(output: bytes, form: str) -> bytearray:
    """The text that `turn` was given."""
    out = bytearray(output)
    if form == "plain":
        return out
    p, s, m = (out.index(x) for x in (PREFIX, SUFFIX, MIDDLE))
    view, start, suffix = np.frombuffer(out, dtype=np.uint8), s if form == "psm" else 0, (m if form == "psm" else p) - s
    rotate(view, start, start + suffix, len(view))
    del view  # a bytearray keeps its size while it is viewed
    for at in (len(out) - suffix, (s if form == "psm" else m - suffix), 0):
        del out[at : at + 3]
    return out


def transform(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output: a row for each row of docs (doc_id, text).

    Four numbers, the first groups of the hex SHA-256 of `seed:doc_id`, choose the cuts (any two of the n + 1 places), whether a text is turned (`rate`
    in 100) and whether its suffix comes first (`spm_rate` in 100).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                ends = token_ends(data)
                draws = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(draws[k : k + 8], 16) for k in range(0, 32, 8))
                if not data or h3 % 100 >= rate or any(x in data for x in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((doc_id, len(ends), "plain", None, None, data.decode()))
                    continue
                first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1))))
                form, view = "spm" if h4 % 100 < spm_rate else "psm", memoryview(data)
                rows.append((doc_id, len(ends), form, _chars(view[:first]), _chars(view[first:second]), turn(data, first, second, form).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TURNED.types, strict=True)], schema=_TURNED)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(turned: DataFrame) -> DataFrame:
    """turned (form, output, and any other columns; one named restored goes) with `restored`: each text as it was, from its output and form alone; null where either is null."""
    turned, added = turned.drop("restored"), pa.field("restored", pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            texts = [turn_back(o.as_buffer().to_pybytes(), f).decode() if f is not None and o.is_valid else None for o, f in zip(b["output"], b["form"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema=b.schema.append(added))

    return turned.mapInArrow(run, StructType([*turned.schema.fields, StructField("restored", StringType())]))
