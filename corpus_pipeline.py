"""A corpus pipeline of five operators: language, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, near_duplicates, packing, pii
from tessera.llm.common import table, written


def _row(docs: DataFrame) -> Column:
    """All columns of a document as one, so that their names cannot clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tessera_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or far from every language learnt from the labelled rows.

    Rejection is lenient (a fifth of what a language's own texts reach), so that short clean texts
    stay.  Where no row has a language nothing is known and only texts without a letter go.
    """
    learn = F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))
    model = language.fit(docs, learn, order=F.xxhash64("doc_id"), reject_share=0.2)
    if not model.language:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    outputs = ("tessera_lang", "tessera_score", "tessera_rejected")
    return language.with_language(docs, model, outputs=outputs).where("not tessera_rejected").drop(*outputs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at a similarity of 0.8 of five-word shingles."""
    return near_duplicates.without_duplicates(docs, shingle=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    rows = docs.select("text", _row(docs))
    return pii.redact(pii.with_spans(rows, pii.fit(docs)), "tessera_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix: whole documents as often as taken, and parts where a quota ends inside one."""
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), _row(docs))
    quota = mixing.quotas(written(sized.select("doc_id", "source", "size"), "sized"))
    return mixing.draw(mixing.mix(sized, quota), "tessera_row")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens."""
    return packing.pack(written(packing.pieces(docs), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Languages, links and packings are learnt or found by procedures that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
