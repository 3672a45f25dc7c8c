"""Removal of repeated byte strings beside brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeqc.llm import repeats
from tapeqc.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, doc string, spans long"


def expected(rows, length):
    where = defaultdict(set)
    data = [(r[1] or "").encode() for r in rows]
    for k, x in enumerate(data):
        for i in range(len(x) - length + 1):
            where[x[i : i + length]].add((k, i))
    out = []
    for r, x in zip(rows, data, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if len(where[x[i : i + length]]) > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((r[0], len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, length, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 9))))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(int(rng.integers(length // 8, length))) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = [prose(int(rng.integers(0, 2 * length // 3)))]
        for _ in range(int(rng.integers(0, 3))):
            x = shared[rng.integers(0, 4)]
            i = int(rng.integers(0, len(x) // 2))
            parts += [x[i:][: int(rng.integers(length // 2, 3 * length))], prose(int(rng.integers(0, 20)))]
        rows.append((k, "".join(parts), "x", 1))
    near = prose(length)
    rows += [(100 + k, near[: 50 * k] + word() + near[50 * k :], None, None) for k in range(12)]
    exact = [prose(length // 2), near, "é" * length]
    rows += [(200 + k, exact[k % 3], None, None) for k in range(9)]
    once = "".join(chr(65 + k % 26) for k in range(length - 1)) + "!"
    rows += [(300, None, None, None), (301, "", None, None), (302, "short", None, None), (303, "z" * (length - 1), None, None), (304, "z" * length, None, None), (305, "y" * (5 * length), None, None), (306, "ab" * (2 * length), None, None)]
    rows += [(307, once, None, None), (308, "-" + once[:-1], None, None), (309, "q" + once + "q", None, None)]
    return [*rows, rows[0], rows[0], (None, rows[1][1], None, None), (None, prose(length), None, None), (None, "", None, None)]


key = lambda row: tuple((x is not None, x) for x in row)


def of(found):
    size = lambda s: s["end"] - s["start"]
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + size(s))
    return sorted(map(tuple, found.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()), key=key)


@pytest.mark.parametrize(("seed", "length", "group"), [(1, 40, 4096), (2, 40, 3), (3, 41, 8), (4, 16, 4096), (5, 200, 5)])
def test_removed(spark, monkeypatch, seed, length, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = corpus(seed, length)
    got = of(repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), length))
    assert got == sorted(expected(rows, length), key=key)


def test_query(spark, tmp_path):
    rows = corpus(9, 200)
    rows += [(400, "head one " * 40_000, None, None), (401, "x" + rows[3][1] * 20, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_suffix_dedup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows, 200), key=key)
    assert 0 < sum(r.n_removed for r in got) < sum(r.n_bytes for r in got)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repeats.remove_repeats(spark.createDataFrame([(1, None, None, None)], SCHEMA)).count() == 1
    with pytest.raises(ValueError, match="16 to 500"):
        repeats.remove_repeats(spark.createDataFrame([], SCHEMA), 8)


@pytest.mark.parametrize("length", [16, 41, 200])
def test_samples(length):
    rng = np.random.default_rng(length)
    text = bytes(rng.integers(97, 100, 3000).astype(np.uint8)) + b"a" * 500
    place, first, last = repeats.samples(text, length)
    gram = length // 2
    assert first[0] == 0 and last[-1] == len(text) - length
    assert (first[1:] == last[:-1] + 1).all() and (place >= last).all() and (place + gram <= first + length).all()
    where = {}
    for p, i, j in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
        for k in range(i, j + 1):
            assert where.setdefault(text[k : k + length], p - k) == p - k  # equal strings are sampled at the same place


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(a), int(b), int(d), int(p)) for a, b, d, p in zip(rng.integers(-3, 3, 3000), rng.integers(0, 40, 3000), rng.integers(0, 90, 3000), rng.integers(0, 3, 3000), strict=True)]
    rows += [(7, 7, k, 0) for k in range(4000)] + [(8, k, 0, 0) for k in range(50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts * 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = repeats.rerank(spark.createDataFrame(rows, "hi long, lo long, doc long, at long").withColumn("more", F.col("lo")), ["more"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    who = defaultdict(set)
    for a, b, d, p in rows:
        who[a, b].add((d, p))
    names = {n: k for k, n in enumerate(sorted(who))}
    want = sorted((d, p, n[1], names[n], (d, p) == min(w)) for n, w in who.items() if len(w) > 1 for d, p in w)
    assert sorted(map(tuple, got)) == want


def test_large_groups_are_not_listed(spark, monkeypatch):
    """op11: in groups of more than GROUP positions each of a position's hundred strings was a row."""
    rng = np.random.default_rng(11)
    junk = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    length, n, passage, rows, where = 200, 300, junk(300), [], defaultdict(set)
    for k in range(n):
        left, right = (0, 0) if k % 3 == 2 else (int(rng.integers(0, 90)), int(rng.integers(0, 60)))
        most, least = (100, 0) if k % 5 else (int(rng.integers(60, 101)), int(rng.integers(0, 40)))
        text = (junk(left) + passage[left : 300 - right] + junk(right))[100 - most : 300 - least]
        rows.append((k, 1000 << 16 | most << 8 | least, text))
        for i in range(most - least + 1):
            where[text[i : i + length]].add((k, 1000 - most + i))
    named, real = [], repeats.rerank
    monkeypatch.setattr(repeats, "rerank", lambda rows, more=[]: named.append(rows.count()) or real(rows, more))  # noqa: B006
    found = repeats._sorted_strings(spark.createDataFrame(rows, "doc long, at long, bytes binary"), length).collect()
    assert {(r.doc, i) for r in found for i in range(r["first"], r["last"] + 1)} == {x for at in where.values() if len(at) > 1 for x in at}
    assert max(named) <= 10 * n, named
