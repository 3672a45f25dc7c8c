"""The ten operators on small tables with nulls, empty and long texts, repeated rows, clashing columns, and on empty tables; against brute force."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeqc.llm import ann, graph, jaccard, langid, lattice, license_scan, mixing, packing, pii, ranks, shared, warc, wavelet, words
from tapeqc.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _row long, spans string, part int, score double"
TEXTS = [None, "", " \n\t", "one", "One two", "the same text is here again and again for all of us to read now", "the same text is here again and again for all of us to read now", "émigré ñandú 東京 mail a@b.co or +1 (555) 123-4567", "word " * 3000, "x" * 20000, "released under the MIT License. Apache License, general PUBLIC license!"]


def rows():
    out = [(k, t, ("en", "fr", None)[k % 3], ("b", "a", None)[k % 3], None, 1, 2, "z", 3, 0.5) for k, t in enumerate(TEXTS)]
    return out + [out[5], out[5], out[0], (None, None, None, None, None, None, None, None, None, None), (None, "null id here", "en", "a", None, 1, 1, "", 1, 1.0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_offsets(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("n"))
    found = sorted((r.g, r.at, r.n) for r in ranks.with_offsets(df, ["g"], ["id"], {"at": "n"}).collect())
    at = Counter()
    for g, start, n in found:
        assert start <= at[g]
        at[g] = max(at[g], start + n)
    assert at == {g: sum(k % 7 for k in range(3000) if k % 3 == g) for g in range(3)}


def test_spread_join(spark):
    rows_ = [(7, k) for k in range(500)] + [(k, k) for k in range(100)] + [(None, k) for k in range(50)] + [(7, 3), (7, 3)]
    rows_ = spark.createDataFrame(rows_, "key int, x int")
    small = shared.written(rows_.where("key % 2 = 1 or key = 4").groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("most"), F.lit("s").alias("s")), "small")
    want = sorted(map(str, rows_.join(small.drop("n"), "key", "left").collect()))
    for least in (0, 100, 1000):
        assert sorted(map(str, shared.spread_join(rows_, small, "key", "n", least).collect())) == want


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 1), (8, 7), (5, 5), (None, 4), (6, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 9: 7, 8: 7, 7: 7}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_targets_reshare(spark):
    for sizes, weights in (([10, 100, 7, 0], [3, 1, 2, 3]), ([5], [3]), ([1, 1, 1], [3, 1, 2]), ([1000, 3, 3, 3, 50], [3, 1, 2, 3, 1]), ([0, 0], [3, 1]), ([6, 6, 2], [3, 3, 1])):
        whole, fixed, want = 1.5 * sum(sizes), {k for k, n in enumerate(sizes) if not n}, {}
        while True:  # give, cap, reshare
            heavy = sum(w for k, w in enumerate(weights) if k not in fixed)
            left = whole - sum(2.0 * sizes[k] for k in fixed)
            want = {k: 2.0 * sizes[k] if k in fixed else left * w / heavy for k, w in enumerate(weights)}
            over = {k for k in want if k not in fixed and want[k] > 2.0 * sizes[k]}
            if not over:
                break
            fixed |= over
        level = mixing.fill_level(spark.createDataFrame([(n, float(w)) for n, w in zip(sizes, weights, strict=True)], "n long, weight double"), 1.5, 2.0)
        assert [2.0 * n if level is None else min(2.0 * n, level * w) for n, w in zip(sizes, weights, strict=True)] == pytest.approx([want[k] for k in range(len(sizes))])


@pytest.mark.parametrize("group", [mixing.GROUP, 64])
def test_a_mix_of_very_many_sources(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4000).cast("string")).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 7 * 3).cast("int")).alias("text"))
    runs = [mixing.Mix(df, block_words=4, n_shards=16) for _ in range(2)]
    found = runs[0].documents().toPandas()
    by = found.groupby(found.doc_id % 4000).agg({"target": "first", "taken": "sum", "size": "sum"})
    assert len(found) == 12_000 and (abs(by.taken - by.target) <= 1).all() and (found.taken <= 2 * found["size"]).all() and by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    assert sorted(map(str, runs[1].documents().collect())) == sorted(map(str, runs[0].documents().collect()))
    shards = runs[0].slots().groupBy("shard").count().toPandas()
    assert len(shards) == 16 and shards["count"].max() - shards["count"].min() <= 1
    order = {r.source: r.source_no for r in runs[0].sources().collect()}
    assert [order[s] for s in sorted(order)] == list(range(4000))


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000):
        key = np.full(n, 77, dtype=np.uint64)
        p = mixing.permuted(np.arange(n), np.full(n, n), key)
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permuted(p, np.full(n, n), key, inverse=True) == np.arange(n)).all()


def test_mix(docs, nothing):
    one, two = (sorted(map(str, mixing.Mix(docs, block_words=4).documents().collect())) for _ in range(2))
    assert one == two and len(one) == len(rows())
    found = mixing.Mix(docs, block_words=4).documents().toPandas()
    assert (found.taken <= 2 * found["size"]).all()
    by = found.groupby("source_size").agg({"target": "first", "taken": "sum", "size": "sum"})
    assert (by.index == by["size"]).all() and (abs(by.taken - by.target) <= 1).all()
    assert found["size"].sum() == sum(len((r[1] or "").encode().split()) for r in rows())
    out = mixing.mixed_documents(docs, block_words=4)
    assert out.columns == docs.columns
    assert out.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == found.taken.sum()
    assert mixing.Mix(nothing).documents().count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mix_of_rows_numbered_by_another(spark):
    rows_ = [(1, "a b c", "x", 7, "k"), (1, "a b c", "x", 7, "k"), (2, "d e f g", "y", 7, None), (3, "h", None, None, "k")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string, _mix_row long, _k string")
    found = mixing.Mix(df, block_words=2).documents().collect()
    assert len(found) == 4 and sorted(r.doc_id for r in found) == [1, 1, 2, 3] and all(r.taken <= 2 * r["size"] for r in found)
    out = mixing.mixed_documents(df, block_words=2).collect()
    assert {r._mix_row for r in out} <= {7, None} and sum(len(r.text.split()) for r in out) == sum(r.taken for r in found)


def vectors(spark, extra=()):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    base[200:240] = base[7] + 0.05 * rng.standard_normal((40, 16))
    base[250] = base[3]
    out = [(int(k), [float(x) for x in v]) for k, v in enumerate(base.astype(np.float32))]
    return [*out, (500, None), (501, [0.0] * 16), (550, [1.0, None] + [0.0] * 14), (600, [float("nan")] * 16), (650, [float("inf")] * 16), (None, out[9][1]), out[11], *extra]


def brute(rows):
    good = [(i, np.array(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.stack([v for _, v in good])
    return [i for i, _ in good], (m @ m.T) / np.sqrt((m * m).sum(1))[:, None] / np.sqrt((m * m).sum(1))[None, :]


def test_prefix_forest(spark):
    rows_ = vectors(spark)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows_], "vec_id long, embedding array<float>, rank int, score string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block_rows=20).collect()]
    ids, s = brute(rows_)
    want, queries = [], [k for k, i in enumerate(ids) if i is not None and i % 50 == 0]
    for q in queries:
        best = sorted((-s[q, k], ids[k] is None, ids[k] or 0, k) for k in range(len(ids)) if k != q)[:5]
        want += [(ids[q], ids[b[3]]) for b in best]
    assert len({(q, v) for q, _, v, _ in got} & set(want)) >= 0.9 * len(set(want))
    assert len(got) == 5 * len(queries) and {r for _, r, _, _ in got} == {1, 2, 3, 4, 5}
    score = {(ids[a], ids[b]): s[a, b] for a in queries for b in range(len(ids))}
    assert all(abs(score[q, v] - x) < 1e-12 for q, _, v, x in got)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).count() == 2


def test_lattice(spark):
    x = np.random.default_rng(0).standard_normal((500, 8)) * 3
    near = lattice.nearest_e8(x)
    assert (((near * 2) % 1) == 0).all() and (((x - near) ** 2).sum(1) <= 1 + 1e-9).all()
    rows_ = vectors(spark)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows_], "vec_id long, embedding array<float>, node int, ok string")
    got = lattice.near_duplicates(df).toPandas()
    ids, s = brute(rows_)
    links = Counter()
    for a in range(len(ids)):
        links[ids[a]] = max(links[ids[a]], int((s[a] >= 0.9).sum()) - 1)
    assert len(got) == len(rows_)
    for r in got.itertuples():
        i = None if r.vec_id != r.vec_id else int(r.vec_id)
        assert r.n_links == links[i], i
    by = got.dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id").component_id
    assert {by.loc[float(k)] for k in range(200, 240)} == {7.0} and by.loc[250.0] == 3 and by.loc[600.0] == 600
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_language(docs, nothing, spark):
    model = langid.fit(docs)
    got = langid.predict(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score", "familiar"] and got.count() == len(rows())
    for r in got.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert langid.predict(nothing, langid.fit(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(nothing)).collect()} == {"und"}
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.predict(whole, langid.fit(whole.where(~langid.held_out()))).where(langid.held_out()).where("lang_pred = lang").count()
    assert held >= 0.9 * whole.where(langid.held_out()).count()
    assert spark.range(1).select(F.lit(12).cast("long").alias("doc_id")).select(langid.held_out()).first()[0] == (zlib.crc32(b"12") % 4 == 2)


def test_rare_languages_keep_their_words(spark):
    common = [(k, " ".join(f"{a}{b}en" for a in "bcdfghjklm" for b in "aeiou"), "en") for k in range(40)]
    rare = [(100, "qulto quvto zulto zuvto", "xx"), (101, "qixpy qirpy zixpy zirpy", "yy")]
    docs = spark.createDataFrame([*common, *rare], "doc_id long, text string, lang string")
    model = langid.fit(docs, least=1)
    assert len(model.words.keys) == 50 + 4 + 4
    asked = spark.createDataFrame([(1, "quvto zulto"), (2, "zirpy qixpy"), (3, "baen caen"), (4, "quvtoquv")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()} == {1: "xx", 2: "yy", 3: "en", 4: "xx"}
    shared = spark.createDataFrame([(1, "aa bb cc " * 9 + "dd", "en"), (2, "dd dd dd ee", "xx")], "doc_id long, text string, lang string")
    model = langid.fit(shared)
    k = int(np.searchsorted(model.words.keys, langid._word_keys(["dd"])[0]))
    assert len(model.words.keys) == 4  # ee was met once
    mine = slice(model.words.starts[k], model.words.starts[k + 1])
    assert model.words.langs[mine].tolist() == [0, 1]
    assert np.allclose(model.words.gains[mine], np.log([(1 + 0.5) / 0.5, (3 / 4 + 0.5 / 28) / (0.5 / 28)]), atol=1e-5)


def test_many_languages_keep_their_words(spark):
    letters = str.maketrans("0123456789", "qrstuvwxyz")
    docs = spark.createDataFrame([(k, " ".join(f"{a}{k}x" for a in "abcdefgh").translate(letters), f"l{k:03}") for k in range(200)], "doc_id long, text string, lang string")
    model = langid.fit(docs, least=1)
    assert len(model.words.keys) == 1600 and len(model.words.gains) == 1600 and len(model.languages) == 200
    got = langid.predict(docs, model).where("lang_pred = lang").count()
    assert got == 200


def test_language_rows_are_forgotten_and_found_again(monkeypatch):
    words, nothing = langid._word_keys(["dd", "ee"]), np.zeros(0)
    model = langid.LanguageModel(["en", "xx"], langid.SparseTable.of(np.repeat(words, 2), np.array([0, 1, 0, 1]), np.array([1, -1, -2, 2.0])), langid.SparseTable.of(nothing.astype(np.uint64), nothing, nothing))
    monkeypatch.setattr(langid, "_REMEMBERED", 3)
    rows = langid._Rows(model)
    asked = [["dd", "ee", "ee"], ["un", "known", "dd"], []]
    want = [np.append(model.rows(words)[0].sum(axis=0), model.rows(words)[1].sum()) if words else np.zeros(3) for words in asked]
    assert [w[-1] for w in want] == [3, 1, 0]
    for _ in range(3):
        assert np.allclose(rows.scores(asked), want)


def test_what_is_no_letter():
    assert langid.words_of("² ½ ① 12 _ ٣") == [] and langid.words_of("a² b½c 3d Éa_b") == ["a", "b", "c", "d", "éa", "b"]
    assert langid.words_of("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"]


def test_undetermined(docs, spark):
    odd = spark.createDataFrame([(1, "² ½"), (2, "12 34"), (3, None), (4, "ⅷ ①")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, langid.fit(docs)).collect()} == {("und", 0.0)}


def test_a_sample_is_never_empty(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    assert 800 < langid.sampled(docs, 1000, 20_000).count() < 1200
    assert 20 < langid.sampled(docs, 10**9, 10**12 // 4).count() < 200  # of a table of 2.5e11 rows, a share of 4 in 1000
    share = langid.sampled(docs, 20_000, 21_000_000_000)._jdf.queryExecution().optimizedPlan().toString()
    assert str((1 << 63) * 20_000 // 21_000_000_000) in share


def test_warc_repeated_rows_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    pages = [(1, "http://a.b/", "x")] * 25 + [(None, "http://a.b/", "y")] * 13 + [(None, None, None)] * 9 + [(k, f"http://a.b/{k}", "z") for k in range(2, 9)] + [(7, None, "w")] * 5
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = warc.write_index(warc.write_archives(df))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1
    got = Counter((r.page_id, r.url) for r in warc.lookup(files, df.select("url", "page_id")).collect())
    assert got == Counter((i, u) for i, u, _ in pages)
    assert warc.lookup(files, df.where("page_id = 1").select("url")).count() == 38


def test_warc(spark):
    html = ["same", "same", None, "", "other é", "same", "long " * 5000]
    pages = [(k, f"http://User@Sub.Example.org:80/p a?{k}" if k != 4 else None, h, 1) for k, h in enumerate(html)] + [(None, "x", "same", 2), (3, "http://a.b/", "", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    lines = warc.write_archives(df)
    files = warc.write_index(lines)
    got = warc.lookup(files, df.select("url", "page_id")).collect()
    assert len(got) == len(pages)
    last = {}
    for k, _, h, _ in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if k is None else k)
    for r in got:
        h = next((p[2] or "") for p in pages if p[0] == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        revisit = last[h] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", last[h]) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == h.encode()
    by_url = warc.lookup(files, df.where("page_id = 5").select("url")).collect()
    assert [r.page_id for r in by_url] == [5]
    assert warc.lookup(files, spark.createDataFrame([("http://no.where/",)], "url string")).count() == 0
    none = df.limit(0)
    assert warc.lookup(warc.write_index(warc.write_archives(none)), none.select("url", "page_id")).count() == 0


def test_licenses(docs, nothing):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [(p.word, p.label) for p in got[10].places] == [(3, "mit"), (5, "apache"), (7, "gpl")] and got[10].n_words == 10
    assert {b.label for b in got[10].blocks} >= {"mit-notice"} and not got[5].blocks and got[0].n_words == 0
    assert license_scan.scan(nothing).count() == 0
    rng = np.random.default_rng(1)
    texts = license_scan.TEXTS | {"again": "one two one two one", "single": "alone"}
    counts = {w: int(rng.integers(1, 99)) for t in texts.values() for w in license_scan.words_of(t)}
    found, names, matches = license_scan.Templates(texts, counts, 0.8), list(texts), 0
    vocabulary = [*sorted(counts), b"zz", b"yy"]
    for turn in range(300):
        words = [vocabulary[k] for k in rng.integers(0, len(vocabulary), int(rng.integers(0, 400)))]
        if turn % 2:
            own = license_scan.words_of(texts[names[turn % len(names)]])[turn % 5 :]
            words[turn % 60 : turn % 60] = [w for k, w in enumerate(own) if (k * turn) % 11 or turn % 3]
        best = {}
        for name, text in texts.items():
            t, n = set(license_scan.words_of(text)), len(license_scan.words_of(text))
            step = max(1, -(-n // 2))
            for start in range(0, len(words), step):
                c = len(t & set(words[start : start + n + step])) / len(t)
                if c >= 0.8 - 1e-9 and c > best.get(name, (0, 0))[0]:
                    best[name] = (c, start)
        assert found.best(words) == best
        matches += len(best)
    assert matches > 150


def test_every_license_text_is_found(spark):
    texts = license_scan.TEXTS
    rows_ = [(k, "before it " * (k * 7) + t.upper() + " and after" * 50) for k, t in enumerate(texts.values())]
    rows_ += [(100 + k, " ".join(t.split()[::2])) for k, t in enumerate(texts.values())]
    got = {r.doc_id: {b.label: b.containment for b in r.blocks} for r in license_scan.scan(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert all(got[k][name] == 1.0 for k, name in enumerate(texts))
    assert not any(name in got[100 + k] for k, name in enumerate(texts) if name.endswith("text") and len(texts[name].split()) > 60)


def encode(text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_tokens_round_trip(docs, nothing):
    got = wavelet.read_tokens(wavelet.write_tokens(docs, TOKENIZER)).collect()
    assert len(got) == len(rows())
    want = Counter((r[0], encode(r[1], 1).tobytes()) for r in rows())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert wavelet.read_tokens(wavelet.write_tokens(nothing, TOKENIZER)).count() == 0


@pytest.mark.parametrize("n,most", [(5000, 300), (400_000, 50_000), (700, 90_000), (1, 1), (512, 2)])
def test_wavelet_matrix(n, most):
    ids = np.random.default_rng(1).zipf(1.3, n) % most
    matrix = wavelet.WaveletMatrix.of(ids)
    file = wavelet.WaveletFile(io.BytesIO(matrix.dump(np.array([n // 3, n - n // 3]))))
    assert file.lengths().tolist() == [n // 3, n - n // 3]
    for m in (matrix, file):
        assert (m.decode() == ids).all()
        for k in range(0, n, max(1, n // 9)):
            assert m.access(k) == ids[k]
        for t in (0, 1, 7, 299, 301, 5000, 99_000):
            assert m.rank(t, n * 2 // 3) == (ids[: n * 2 // 3] == t).sum()
            places = np.flatnonzero(ids == t)
            assert [m.select(t, k) for k in range(3)] == [int(places[k]) if k < len(places) else None for k in range(3)]


def test_one_token_needs_few_reads():
    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            Counted.read_bytes += n
            return super().read(n)

    ids = np.random.default_rng(4).integers(0, 49_000, 2_000_000)
    data = wavelet.WaveletMatrix.of(ids).dump(np.array([len(ids)]))
    file = wavelet.WaveletFile(Counted(data))
    assert file.access(1_234_567) == ids[1_234_567] and Counted.read_bytes < len(data) / 4


def test_words_beside_the_library():
    from tokenizers import Tokenizer

    whole, encode_ = Tokenizer.from_file(TOKENIZER), words.WordEncoder(TOKENIZER)
    rng = random.Random(1)
    odd = [chr(c) for r in ((32, 127), (0xA0, 0x250), (0x2B0, 0x400), (0x1E00, 0x1F00), (0x1100, 0x1200), (0x2000, 0x2070), (0xAC00, 0xAC40), (0x300, 0x330), (65, 91), (65, 91), (0x300, 0x30D)) for c in range(*r)]
    latin = [chr(c) for c in range(256)] + list("'stremlvd'Aa .,!") * 8
    texts = ["Y\u030a H\u0331 T\u0308 W\u030a J\u030c", "<|endoftext|> a", "the THE The", "it's IT'S won't 12 ab12", "a \u0301b", *("".join(rng.choices(latin if k % 2 else odd, k=rng.randint(1, 14))) for k in range(20_000))]
    assert encode_.by_word
    for t in texts:
        assert encode_.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, ascii(t)


def test_words_of_another_tokenizer(tmp_path):
    import json

    steps = json.loads(open(TOKENIZER).read())
    steps["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(steps))
    from tokenizers import Tokenizer

    other = words.WordEncoder(str(tmp_path / "t.json"))
    assert not other.by_word and other.ids("The Cat").tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode("The Cat", add_special_tokens=False).ids


def test_pii(docs, nothing, spark):
    import re

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum((x := int(c) * (k % 2 + 1)) - 9 * (x > 9) for k, c in enumerate(reversed(d))) % 10 == 0

    def want(text):
        out = []
        for k, p in kinds.items():
            for m in re.finditer(p, text or ""):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                    out.append(f"{k}:{m.start()}:{m.end()}")
        return ",".join(out)

    odd = ["a@b.c_d@e.f x@y@z.w a.b@c a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.04 1.2.3", "😀 4111 1111-1111 1111, 4111111111111111x 4111111111111112", "+1 (555) 123-4567 +12 345 678 901 +1 2", "1" * 3000 + " " + "1 " * 3000, "a" * 9000 + "@", *[r[1] for r in rows()]]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(odd)], "doc_id long, text string, spans int")
    found = pii.find_pii(df).select("text", pii.span_list(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))).alias("x")).collect()
    assert all(r.x == want(r.text) for r in found) and len(found) == len(odd)
    own = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32, bad GB82WEST12345698765433, call 555-123-4567. id 555-123-4567")], "doc_id long, text string")
    r = pii.find_pii(own).select(pii.span_list(F.col("spans")).alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("r")).first()
    assert r.s.startswith("iban:5:32,tel:67:79") and r.r.startswith("IBAN [IBAN], bad GB82WEST12345698765433, call [TEL].")
    assert pii.find_pii(nothing).count() == 0
    more = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 BIC X"), (2, "konto DE89370400440532013000 and NO93 8601 1117 947"), (3, "call 555-123-4567 or 555-123-9999 x")], "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.find_pii(more).select("doc_id", pii.span_list(F.col("spans")).alias("s")).collect()}
    assert found == {1: "iban:5:32", 2: "iban:6:28,iban:33:51", 3: "tel:5:17,tel:21:33"}


def test_redaction(spark):
    rng = np.random.default_rng(1)
    texts = ["", "x", "😀 é " * 5000, "".join(rng.choice(list("ab é😀"), 6144))]
    rows_ = []
    for k, t in enumerate(texts):
        for cuts in ([], [(0, len(t))], sorted({tuple(sorted(rng.integers(0, len(t) + 1, 2).tolist())) for _ in range(40)}), [(2048, 2050), (2049, 4096), (4096, 4100)]):
            rows_.append((k, t, [("ab"[i % 2], a, b) for i, (a, b) in enumerate(c for c in cuts if c[0] < c[1] <= len(t))]))
    df = spark.createDataFrame(rows_, "doc_id long, text string, spans array<struct<kind: string, start: int, end: int>>")
    for r in df.select("text", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("r")).collect():
        out, at = "", 0
        for s in sorted(r.spans, key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= at:
                out += r.text[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert r.r == out + r.text[at:]


def test_pii_in_a_text_of_very_many(spark):
    text = "".join(f"a{k}@b.co é {k % 250}.1.2.3 " for k in range(30_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find_pii(df, kinds=("email", "ip")).select("spans").first().spans
    assert len(spans) == 60_000 and all(text[s.start : s.end] == s.value for s in spans)


def test_packing(docs, nothing):
    places = packing.packed_documents(docs, TOKENIZER, length=64)[0].toPandas()
    want = Counter()
    for r in rows():
        ids = encode(r[1], 0)
        for p, s in enumerate(range(0, len(ids), 64)):
            want[-1 if r[0] is None else r[0], p, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())] += 1
    got = Counter(zip(places.doc_id.fillna(-1).astype(int), places.piece, places.start, places.length, places.ids_crc32, strict=True))
    assert got == want
    for _, g in places.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum([0, *g.length[:-1]])).all() and g.length.sum() <= 64
    assert packing.packed_documents(nothing, TOKENIZER)[0].count() == 0


def test_plan_holds_every_piece():
    rng = np.random.default_rng(2)
    for n in (1, 10, 5000):
        lengths = np.minimum(2048, rng.lognormal(6, 1, n).astype(int) + 1)
        runs = packing.plan(dict(Counter(lengths.tolist())), 2048)
        held = Counter()
        for run, k in runs:
            assert sum(run) <= 2048
            for x in run:
                held[x] += k
        assert held == Counter(lengths.tolist())
        assert sum(k for _, k in runs) <= 1.02 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("hot", [jaccard.HOT, -100])
def test_jaccard(docs, nothing, spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)  # -100: every list is dealt in slices
    rng = np.random.default_rng(5)
    texts = [r[1] for r in rows()]
    base = [f"w{k}" for k in rng.integers(0, 60, 120)]
    for k in range(60):
        words = list(base if k % 2 else [f"v{x}" for x in rng.integers(0, 40, 30)])
        for at in rng.integers(0, len(words), k % 4):
            words[at] = "new" + str(k)
        texts.append(" ".join(words).upper() if k % 5 == 0 else " ".join(words))
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, size int, digest string")
    for words, t in ((3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))):
        sets = []
        for text in texts:
            w = (text or "").encode().lower().split()
            sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
        root = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                n = len(sets[a] & sets[b])
                if n and n >= t * len(sets[a] | sets[b]) and root[a] != root[b]:
                    lo, hi = sorted((root[a], root[b]))
                    root = [lo if x == hi else x for x in root]
        got = jaccard.similar_groups(df, words, t).toPandas().sort_values("doc_id")
        assert got.component_id.tolist() == root and got.n_shingles.tolist() == [len(s) for s in sets]
        assert got[got.kept].component_id.is_unique
    assert jaccard.similar_groups(docs).count() == len(rows()) and jaccard.similar_groups(nothing).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, nothing, name, stage):
    out = stage(spark, docs, SF)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    found = out.toPandas()
    assert len(found) and stage(spark, nothing, SF).count() == 0
    texts = [r[1] for r in rows()]
    if name == "language_id":
        assert sorted(found.text) == sorted(t for t in texts if t and any(c.isalpha() for c in t))
    if name == "near_duplicates":
        assert sum(t == texts[5] for t in found.text) == 1
        assert found.text.isna().sum() == sum(t is None for t in texts) and sum(t is not None and not t.split() for t in found.text) == 2
    if name == "personal_data":
        assert len(found) == len(texts) and not any("a@b.co" in (t or "") for t in found.text)
        assert sorted(map(str, found.text[~found.text.map(str).str.contains("@|\\+1|EMAIL|PHONE")])) == sorted(str(t) for t in texts if not t or "@" not in t)
    if name == "source_mix":
        mix = mixing.Mix(docs).documents().toPandas()
        words = lambda t: len((t or "").encode().split())
        assert sum(map(words, found.text)) == mix.taken.sum()
        for r in found.itertuples():  # what a copy holds is a part of its document
            assert any(" ".join(r.text.split()) in " ".join((t or "").split()) for t in texts) and r.n_chars == len(r.text)
    if name == "best_fit_packing":
        want = sum(-(-len(encode(t, 0)) // 2048) for t in texts)
        assert len(found) == want and found.groupby("sequence_id").length.sum().max() <= 2048


def test_languages_that_nobody_taught_leave(spark):
    taught = [(k, t, c) for k, (t, c) in enumerate([("the cat sat on the mat and ran", "en"), ("le chat est sur la table ici", "fr"), ("der hund lief in den garten hinein", "de"), ("el perro corre por la calle", "es")] * 5)]
    asked = [(100, "東京は日本の首都です 漢字 かな交じり 文章", None), (101, "cat", None), (102, "la", None), (103, "the cat sat 東", None), (104, "12 34", None), (105, None, "en")]
    df = spark.createDataFrame(taught + asked, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, df, SF).collect()}
    assert set(kept) == {*range(20), 101, 102, 103} and kept[101] == "en" and all(kept.values())
    alone = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, alone, SF).collect()} == {*range(20), 100, 101, 102, 103}


def test_documents_without_words_stay(spark):
    rows_ = [(None, None, 1), (None, None, 2), (7, " ", 3), (7, " ", 4), (8, "a b c d e f", 5), (8, "a b c d e f", 6), (None, "x y z", 7), (None, "x y z", 8)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, other int")
    out = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    assert sorted(r.other for r in out)[:4] == [1, 2, 3, 4] and len(out) == 6
    assert sorted(map(str, out)) == sorted(map(str, corpus_pipeline.near_duplicates(spark, df.orderBy(F.desc("other")), SF).collect()))


def test_stages_take_any_column_name(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "en", "a", 22, 1, 2), (2, "a@b.co is where I write", "en", "b", 23, 3, 4)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns and stage(spark, df, SF).count() >= 2, name


def test_pipeline(spark):
    assert corpus_pipeline.run(spark, SF).where("offset + length > 2048").count() == 0
