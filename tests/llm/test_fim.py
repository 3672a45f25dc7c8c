"""Fill-in-middle beside plain Python, and the exact way back."""

import hashlib
import re

import numpy as np
import pytest

from tapeqc.llm import fim
from tapeqc.llm.queries import QUERIES

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, form string, output string"


def texts():
    rng = np.random.default_rng(2)
    some = ["".join(rng.choice(list("ab é😀\n\t<>PSM/"), int(rng.integers(1, 60)))) for _ in range(300)]
    return [*some, None, "", " ", " \n\t", "x", "<P>", "a <S> b", "< P> <M", "<<P", "P>", "é" * 70_000, "word " * 60_000, " y" * 30_001 + "\n"]


def expected(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    draws = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(draws[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_query(spark, tmp_path):
    rows = [(k, t, "x", "y") for k, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "no id here at all", None, None), (-5, "below zero", None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_fill_in_middle"](spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(d, *(e := expected(d, t))[:4], sha(e[4]), sha(t)) for d, t, *_ in rows]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize(("rate", "spm"), [(100, 0), (100, 100), (0, 50)])
def test_round_trip(spark, rate, spm):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts())], SCHEMA)
    got = fim.restore(fim.transform(docs, seed=7, rate=rate, spm_rate=spm)).collect()
    for r in got:
        text = texts()[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, text, 7, rate, spm)
        assert r.restored == (text or "")


def test_empty_table(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 200_001])
def test_rotations(n):
    rng = np.random.default_rng(n)
    data = rng.integers(0, 256, n).astype(np.uint8)
    for mid in {0, n // 3, n}:
        turned = data.copy()
        fim.rotate(turned, 0, mid, n)
        assert turned.tobytes() == data[mid:].tobytes() + data[:mid].tobytes()
