"""The queries of the training-data operators over whole tables, each a thin one that derives its columns from its operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fim, jaccard, langid, lattice, license_scan, mixing, packing, pii, repeats, trie, warc, wavelet

#: The tokenizer that the queries encode with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words and are taken 0 times; a null source is the last one; repeated rows are documents of their own, null ids kept; an empty table gives no row."""
    return mixing.Mix(_table(spark, sf_dir, "documents")).documents()


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, zero or hold a null or non-finite component take no part; ties go to the smaller vec_id, null last; equal rows find each other; an empty table gives no row."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are null or without a letter are `und` with score 0; a null doc_id is not held out; rows that repeat are predicted each; ties go to the first language; an empty table gives no row."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; of equal payloads the largest page_id is the response, a null one last; repeated rows are records of their own; an empty table gives no row."""
    pages = _table(spark, sf_dir, "pages")
    files = warc.write_index(warc.write_archives(pages, min_bytes=0))
    found = warc.lookup(files, pages.select("url", "page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty: no words, null places, no labels, score 0; the best of a label's equal blocks is the first; rows that repeat and null ids are kept; an empty table gives no row."""
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    starts, base, own = (F.transform(c, _field(f)) for c, f in (("places", "word"), ("places", "label"), ("blocks", "label")))
    label_list = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    score = F.when(F.size("places") > 0, 1.0).otherwise(best)
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), label_list(base).alias("base_labels"), label_list(F.concat(base, own)).alias("labels"), score.alias("score"))


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is its end id alone; null ids come first, rows that share one in the order of their texts' hashes; an empty table gives no row."""
    manifest = wavelet.write_tokens(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)
    found = wavelet.read_tokens(manifest)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty and has no spans, the hash of nothing; rows that repeat and null ids are kept; an empty table gives no row."""
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is its end id alone; only documents of over 2048 ids are cut; rows that repeat and null ids are kept; an empty table gives no row."""
    places, _ = packing.packed_documents(_table(spark, sf_dir, "documents"), TOKENIZER, length=2048, end_id=0)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, zero or hold a null or non-finite component link with nothing; rows that repeat link with each other; a null vec_id is no component's id; an empty table gives no row."""
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are null or without words have no set and stay alone; rows that repeat are documents of their own and link; a component's id is its smallest that is not null; an empty table gives no row."""
    return jaccard.similar_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty; texts of under 200 bytes stay; rows that repeat and equal texts are texts of their own, and so repeats; null ids are kept; an empty table gives no row."""
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand by turn, null first, then by the SHA-256 of role and text; repeated rows are turns of their own; rows without a conv_id take no part; an empty table gives no row."""
    return trie.nodes(trie.write_tries(trie.rebuilt(_table(spark, sf_dir, "conversations"))))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty and plain; a null doc_id draws from `42:` alone; rows that repeat are kept; an empty table gives no row."""
    turned = fim.restore(fim.transform(_table(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80))
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_prefix_forest, op3_language_id, op4_warc, op5_license_scan, op6_wavelet_tokens, op7_pii, op8_pattern_packing, op9_lattice_dedup, op10_jaccard_join, op11_suffix_dedup, op12_conversation_trie, op13_fill_in_middle)}

_WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), g AS (
  SELECT page_id, payload, unhex(sha1(payload)) AS digest, max(page_id) OVER (PARTITION BY payload) AS response FROM p
), bits AS (
  SELECT page_id, payload, response, list_aggregate([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (('0x' || substr(hex(digest) || '00', 1 + (k * 5) // 8 * 2, 4))::INTEGER >> (16 - 5 - (k * 5) % 8)) & 31)::INTEGER, 1)
    FOR k IN range(32)], 'string_agg', '') AS b32
  FROM g
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM bits
"""

_REPEATS_SQL = """
WITH b AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT r, u.i AS i, md5_number(substr(x, 2 * u.i + 1, 400)) AS m FROM b, unnest(range(0, n - 199)) AS u(i)
), twice AS (
  SELECT m FROM w GROUP BY m HAVING count(*) > 1
), opens AS (
  SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER p + 200, -1) THEN 1 ELSE 0 END AS opens FROM w SEMI JOIN twice USING (m) WINDOW p AS (PARTITION BY r ORDER BY i)
), runs AS (
  SELECT r, run, min(i) AS s, max(i) + 200 AS e FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM opens) GROUP BY r, run
), cuts AS (
  SELECT r, list(struct_pack(s := s, e := e) ORDER BY s) AS spans FROM runs GROUP BY r
), d AS (
  SELECT doc_id, n, x, coalesce(spans, []) AS spans FROM b LEFT JOIN cuts USING (r)
)
SELECT doc_id, n AS n_bytes, coalesce(list_sum(list_transform(spans, lambda v: v.e - v.s)), 0)::BIGINT AS n_removed, len(spans) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, len(spans) + 1), lambda k: substr(x, 2 * (CASE WHEN k = 0 THEN 0 ELSE spans[k].e END) + 1, 2 * ((CASE WHEN k = len(spans) THEN n ELSE spans[k + 1].s END) - (CASE WHEN k = 0 THEN 0 ELSE spans[k].e END)))), ''))) AS kept_sha256
FROM d
"""

_CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"

_TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, ({_CRC32} % 6)::INT AS h, list(digest ORDER BY turn NULLS FIRST, digest) AS digests, list(w ORDER BY turn NULLS FIRST, digest) AS ws
  FROM turns GROUP BY conv_id
), paths AS (
  SELECT o.conv_id, list_concat(coalesce(b.digests[1:o.h], []), o.digests[o.h + 1:]) AS digests, list_concat(coalesce(b.ws[1:o.h], []), o.ws[o.h + 1:]) AS ws
  FROM own o LEFT JOIN own b ON b.conv_id = o.base
), places AS (
  SELECT conv_id, ws, len(digests) AS n, list_transform(range(0, len(digests) + 1), lambda d: sha256(d || ':' || array_to_string(digests[1:d], ','))) AS keys FROM paths
), rows AS (
  SELECT conv_id, d.d AS depth, keys[d.d + 1] AS key, CASE WHEN d.d > 0 THEN keys[d.d] END AS parent, keys[1:d.d + 1] AS above, CASE WHEN d.d > 0 THEN ws[d.d] ELSE 0 END AS w, d.d = n AS ends
  FROM places, unnest(range(0, n + 1)) AS d(d)
), nodes AS (
  SELECT key, min(depth) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(above) AS above, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM rows GROUP BY key
), kids AS (
  SELECT parent AS key, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT a.a AS key, sum((n - 1) * w) AS saved, count(*) FILTER (WHERE children IS NULL) AS leaves
  FROM nodes LEFT JOIN kids USING (key), unnest(above) AS a(a) GROUP BY a.a
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN nodes p ON p.key = v.parent
"""

_SPACE = r"\x20\x09-\x0D"
_FIM_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+') AS tokens, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents
), h AS (
  SELECT *, len(tokens) AS n, list_transform(range(0, 4), lambda k: ('0x' || substr(hex, 8 * k + 1, 8))::BIGINT) AS h FROM d
), f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), c AS (
  SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


#: DuckDB SQL for the queries whose every column SQL can express at the tables' size.
ORACLE_SQL: dict[str, str] = {"op4_warc": _WARC_SQL, "op11_suffix_dedup": _REPEATS_SQL, "op12_conversation_trie": _TRIE_SQL, "op13_fill_in_middle": _FIM_SQL}
