"""From raw documents to packed training sequences: language ID, near duplicates, personal data, source mix, packing.

Each stage takes what its predecessor kept, read back from Parquet, and all but the last return the columns of documents. Stages take tables with
nulls in any column, empty texts, repeated rows and further columns; an empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeqc.llm import jaccard, langid, mixing, packing, pii
from tapeqc.llm.queries import TOKENIZER
from tapeqc.llm.shared import written

#: Documents of whose words a smaller share is familiar in any of the languages learned leave.
LEAST_FAMILIAR = 0.5


def _col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _rest(docs: DataFrame) -> Column:
    """All of a row but its text, as a struct."""
    return F.struct(F.lit(True).alias("_"), *[_col(c) for c in docs.columns if c != "text"])


def _put(docs: DataFrame, new: dict[str, Column]) -> list[Column]:
    """docs' columns from `_doc` (_rest) and `text`, those in `new` replaced."""
    return [new.get(c, F.col("text") if c == "text" else F.col("_doc")[c]).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach; fills null languages in.

    Texts that are null or without letters leave, and those written in what no language learned is like: of most of their words not even two
    characters in turn are known. Where languages are close or a text is short it stays. If no row has a language, nothing was learned and all
    texts with letters stay, without one.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.predict(docs.select(_rest(docs).alias("_doc"), "text"), model).where((F.col("lang_pred") != "und") & (F.col("familiar") >= LEAST_FAMILIAR))
    return kept.select(*_put(docs, {"lang": F.coalesce(F.col("_doc")["lang"], F.col("lang_pred"))}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each group linked by shingles of five words at a similarity of 0.8 or more.

    Rows that agree in doc_id and text are one group; of these the one whose other columns hash smallest stays. Documents without words
    link with nothing: every such row stays, repeated or not. Null ids come last.
    """
    groups = jaccard.similar_groups(docs, words=5, threshold=Fraction(4, 5))
    kept = groups.where("kept and n_shingles > 0").select(F.col("row").alias("_kept_row"), F.col("doc_id").alias("_kept_id")).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).select(_rest(docs).alias("_doc"), "text", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    stay = rows.join(kept, (F.col("_row") == F.col("_kept_row")) & F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi")
    first = Window.partitionBy("_row", "_id").orderBy(F.xxhash64(F.to_json("_doc")))
    one = stay.withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return one.select(*_put(docs, {})).unionByName(docs.where(~worded))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [KIND] in place of personal data; every document stays, repeated rows too. Null and empty texts stay as they are; n_chars is set anew."""
    found = pii.find_pii(docs.select(_rest(docs).alias("_doc"), "text"), out="_spans")
    clean = found.select("_doc", pii.redacted(F.col("text"), F.col("_spans")).alias("text"))
    return clean.select(*_put(docs, {"n_chars": F.length("text").cast("long")}))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at weights 3, 1, 2: documents once for each pass that takes words of theirs, cut to these.

    Null and empty texts have no words and leave; a null source is a source of its own; repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the documents' tokens in sequences of 2048.

    A null or empty text is its end token alone; null ids are kept; repeated rows are documents of their own; longer texts are cut in pieces.
    """
    return packing.packed_documents(docs, TOKENIZER, length=2048, end_id=0)[0]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Pseudorandom permutations and fitted models are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
