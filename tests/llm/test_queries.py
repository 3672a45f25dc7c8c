"""The registered queries of the ten operators on small odd tables, against their contracts in plain Python."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeqc.llm import lattice
from tapeqc.llm.queries import QUERIES, TOKENIZER

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LICENSE = "Released under the MIT License; or the apache\nlicense. GENERAL public license, mit-license! (x)"
PERSONAL = "Mail a.b+c@d-e.fr or x@y.z.w, host 10.0.0.255 not 10.0.0.256, card 4111 1111-1111 1111 or 4111111111111112, call +49 (30) 123-4567. IBAN DE89 3704 0044 0532 0130 00"


def documents():
    rng = np.random.default_rng(6)
    langs = {"en": "the cat sat on mat and ran far", "fr": "le chat est sur la table ici même", "de": "der hund lief in den garten hinein", "es": "el perro corre por la calle señor"}
    rows = []
    for k in range(120):
        lang = list(langs)[k % 4]
        words = rng.choice(langs[lang].split(), int(rng.integers(1, 60)))
        rows.append((k, " ".join(words), lang if k % 5 else None, ["b", "a", None, "é"][k % 4]))
    base = " ".join(f"w{k}" for k in rng.integers(0, 40, 200))
    rows += [(200 + k, base.replace("w7 ", f"new{k} ") if k % 2 else base.upper(), "en", "b") for k in range(8)]
    rows += [(300, None, "en", "a"), (301, "", "fr", "b"), (302, " \t\n", None, None), (303, "² ½ 12", "de", "a"), (304, "x" * 30_000, "en", "a"), (305, "long words " * 9_000, "en", "b")]
    rows += [(306, LICENSE, "en", "a"), (307, LICENSE.upper(), "en", "a"), (308, PERSONAL, "en", "b"), (309, "😀 " + PERSONAL, "en", "b"), (310, "Y̊ H̱ <|endoftext|> É", "fr", "b")]
    return [*rows, rows[0], rows[0], (None, "no id here", "en", "a"), (None, None, None, None)]


def vectors():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 64))
    v[100:150] = v[7] + 0.2 * rng.standard_normal((50, 64))
    v[250] = v[3]
    rows = [(k, [float(np.float32(x)) for x in r]) for k, r in enumerate(v)]
    return [*rows, (500, None), (550, [0.0] * 64), (600, [1.0, None] + [0.0] * 62), (650, [float("nan")] * 64), (700, [float("inf")] * 64), rows[9], (None, rows[11][1])]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("clash"))
    docs.repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(3).write.parquet(str(at / "embeddings.parquet"))
    return str(at)


def run(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def words(text):
    return WORD.findall((text or "").encode())


def test_mixing(spark, sf):
    got = run(spark, sf, "op1_mixing")
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d[0], len(words(d[1]))) for d in documents())
    sizes = Counter()
    for d in documents():
        sizes[d[3]] += len(words(d[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, aims = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        heavy = sum(weight[s] for s in order if s not in aims)
        over = [s for s in order if s not in aims and left * weight[s] / heavy > 2 * sizes[s]]
        if not over:
            break
        aims |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
    aims |= {s: left * weight[s] / heavy for s in order if s not in aims}
    by = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and any(r.source_size == sizes[s] and abs(r.target - float(aims[s])) < 1e-6 for s in order)
        by[r.target] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.items())
    assert sorted(map(str, got)) == sorted(map(str, run(spark, sf, "op1_mixing")))


def cosines():
    good = [(i, np.array(v, dtype=float)) for i, v in vectors() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = np.stack([v / np.sqrt((v * v).sum()) for _, v in good])
    return [i for i, _ in good], u @ u.T


def test_prefix_forest(spark, sf):
    got, (ids, s) = run(spark, sf, "op2_prefix_forest"), cosines()
    hit = 0
    for q in [k for k, i in enumerate(ids) if i is not None and i % 50 == 0]:
        own = sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(own[k].score >= own[k + 1].score for k in range(4))
        assert all(any(ids[k] == r.vec_id and abs(s[q, k] - r.score) < 1e-9 for k in range(len(ids)) if k != q) for r in own)
        best = sorted((k for k in range(len(ids)) if k != q), key=lambda k: -s[q, k])[:5]
        hit += sum(r.score >= s[q, best[-1]] - 1e-9 for r in own)
    assert len(got) == 30 and hit >= 27


def test_language_id(spark, sf):
    got = run(spark, sf, "op3_language_id")
    texts = {d[0]: d[1] for d in documents()}
    assert len(got) == len(documents())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) and r.lang_pred in {"und", "en", "fr", "de", "es"} and 0 <= r.score <= 1
    right = [(r.lang_pred, list(("en", "fr", "de", "es"))[r.doc_id % 4]) for r in got if r.doc_id is not None and r.doc_id < 120]
    assert sum(a == b for a, b in right) >= 0.95 * len(right)


def test_language_id_by_backoff(spark, sf):
    """The predictions of the query beside a plain one: words, else the longest n-grams that are known."""
    words = lambda text: regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
    taught = [(d[1], d[2]) for d in documents() if d[1] is not None and d[2] and not (d[0] is not None and zlib.crc32(str(d[0]).encode()) % 4 == 2)]
    counts, totals, langs = Counter(), Counter(), sorted({lang for _, lang in taught})
    grams = lambda w, n: [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)]
    for text, lang in taught:
        for w in words(text):
            for n, g in [(0, w), *((n, g) for n in range(1, 5) for g in grams(w, n))]:
                counts[n, g, lang] += 1
                totals[n, lang] += 1
    everywhere = Counter()
    for (n, g, _), c in counts.items():
        everywhere[n, g] += c
    floor = {n: 0.5 / max(totals[n, x] for x in langs) for n in range(5)}
    gain = lambda n, g: np.array([np.log(counts[n, g, x] / totals[n, x] + floor[n]) - np.log(floor[n]) for x in langs]) if everywhere[n, g] >= 2 else None

    def row(w):
        if (own := gain(0, w)) is not None:
            return own
        for n in range(4, 0, -1):
            if found := [x for g in grams(w, n) if (x := gain(n, g)) is not None]:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    plain = {}
    for doc_id, text, *_ in documents():
        found = words(text)
        if doc_id is None:
            continue
        x = sum((row(w) for w in found), np.zeros(len(langs)))
        p = np.exp((x - x.max()) * min(1.0, 10 / max(1, len(found))))
        plain[doc_id] = (langs[int(np.argmax(x))], p.max() / p.sum()) if found else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in run(spark, sf, "op3_language_id") if r.doc_id is not None}
    assert len(plain) > 130
    for doc_id, (lang, score) in plain.items():
        assert got[doc_id][0] == lang and abs(got[doc_id][1] - score) < 1e-4, doc_id


def test_license_scan(spark, sf):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = Counter()
    for i, text, _, _ in documents():
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in phrases.items() for k in range(len(own)) if own[k : k + len(p.split())] == [w.encode() for w in p.split()]]
        starts = [k for k, _ in places]
        want[i, len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = run(spark, sf, "op5_license_scan")
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels.split(",") == sorted(set(r.labels.split(","))) and 0 <= r.score <= 1 for r in got)


def ids_of(text, end):
    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_wavelet_tokens(spark, sf):
    got = sorted(run(spark, sf, "op6_wavelet_tokens"), key=lambda r: r.start)
    want = Counter()
    for i, text, _, _ in documents():
        x = ids_of(text, 1)
        want[i, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


def test_pii(spark, sf):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    want = Counter()
    for i, text, _, _ in documents():
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
        want[i, *(sum(s[0] == k for s in spans) for k in patterns), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    got = run(spark, sf, "op7_pii")
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert all(r.spans.count("iban") == 1 for r in got if r.doc_id in (308, 309))


def test_pattern_packing(spark, sf):
    got, want = run(spark, sf, "op8_pattern_packing"), Counter()
    for i, text, _, _ in documents():
        x = ids_of(text, 0)
        for p, at in enumerate(range(0, len(x), 2048)):
            want[i, p, at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


def test_lattice_dedup(spark, sf):
    got, (ids, s) = run(spark, sf, "op9_lattice_dedup"), cosines()
    linked = (s >= 0.9) & ~np.eye(len(ids), dtype=bool)
    group = list(range(len(ids)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        if group[a] != group[b]:
            lo, hi = sorted((group[a], group[b]))
            group = [lo if g == hi else g for g in group]
    low = {g: min((ids[k] for k in range(len(ids)) if group[k] == g and ids[k] is not None), default=None) for g in group}
    want = Counter((ids[k], int(linked[k].sum()), low[group[k]]) for k in range(len(ids)))
    want.update((i, 0, i) for i, v in vectors() if i in (500, 550, 600, 650, 700))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_lattice_recall_near_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(1500):
        a, c = rng.standard_normal(64), 0.901 + 0.02 * rng.random()
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
    found = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").count()
    assert found >= 0.99 * len(rows)


def test_jaccard_join(spark, sf):
    sets, own = [], documents()
    for _, text, _, _ in own:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    group = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    low = {g: min((own[k][0] for k in range(len(own)) if group[k] == g and own[k][0] is not None), default=None) for g in group}
    got = run(spark, sf, "op10_jaccard_join")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d[0], len(s), low[g]) for d, s, g in zip(own, sets, group, strict=True))
