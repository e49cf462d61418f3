"""Readers over files that Spark writes from the test tables: corpora, queries, topics, article sets, archives."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..operators.stages import shared_folder
from ..sources import archives as AR
from ..sources import articles as A
from .registry import query

_KINDS = [*params.TOPIC_COLUMNS, "odd"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _text(c) -> Column:
    """The column as the content of an XML element."""
    return F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "corpus")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    title = F.concat(F.lit("Title "), (F.col("doc_id") % 7).cast("string"))
    docs.select(F.col("doc_id").cast("string").alias("_id"), title.alias("title"), "text").repartition(5).write.json(folder)
    return A.read_corpus(spark, folder)


@query("select cast(doc_id as varchar) as id, 'Title ' || doc_id % 7 as title, text as abstract from documents")
def src_01_corpus(spark, sf):
    return _corpus(spark, sf).select("id", "title", "abstract")


@query("select count(*) as documents, count(*) as places, 0::bigint as first_place, count(*) - 1 as last_place from documents")
def src_03_corpus_places(spark, sf):
    """Every record has its own place, without a gap, whatever the number of files."""
    return _corpus(spark, sf).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("doc_idx").alias("places"), F.min("doc_idx").alias("first_place"), F.max("doc_idx").alias("last_place"))


@query("select row_number() over (order by qid) - 1 as query_idx, qid, text from (select 'q' || item_id as qid, text from benchmark where item_id % 3 <> 0)")
def src_02_judged_queries(spark, sf):
    """Queries of a file that a file of judgments names; it names some more that have no text."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("_id"), "text", "item_id")
    asked, judged = _folder(spark, "asked"), _folder(spark, "judged")
    items.select("_id", "text").write.json(asked)
    grade = lambda name: F.struct(name.alias("qid"), F.lit("d1").alias("id"), F.lit(1).alias("grade"))
    lines = items.where("item_id % 3 <> 0").select(F.inline(F.array(grade(F.col("_id")), grade(F.concat("_id", F.lit("x"))))))
    lines.write.option("sep", "\t").option("header", True).csv(judged)
    return A.read_queries(spark, asked, A.read_qrels(spark, judged))


_PLACE = f"item_id % {len(_KINDS)}"
_CASES = lambda values: f"case {_PLACE} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


@query(
    f"""select '2015-' || item_id as qid, 2015 as year, cast(item_id as varchar) as number, {_CASES([f"'{k}'" for k in _KINDS])} as type,
    {_CASES([f"'{params.TOPIC_COLUMNS[k]}'" if k in params.TOPIC_COLUMNS else "cast(null as varchar)" for k in _KINDS])} as gate, trim(regexp_replace(text, '\\s+', ' ', 'g')) as summary
    from benchmark where trim(text) <> ''"""
)
def src_07_topics(spark, sf):
    """A topic for each item, with blanks and capitals in its type, and one type that has no column."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").where("trim(text) <> ''")
    kind = F.initcap(F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("item_id") % len(_KINDS) + 1).cast("int")))
    whole = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE topics><topics><topic number="'), F.col("item_id").cast("string"), F.lit('" type=" '), kind, F.lit('"><summary>'), _text("text"), F.lit("</summary></topic></topics>"))
    return A.parse_topics(items.select(whole.alias("value")), 2015).withColumnRenamed("column", "gate")


@query("select cast(doc_id as varchar) as pmid, case when doc_id % 3 = 0 then 'Review' else 'Review|Kind ' || doc_id % 5 end as types from documents")
def src_12_publication_types(spark, sf):
    """An article set for each document; the numbers of cited articles and a book article do not count."""
    i = F.col("doc_id")
    name = lambda x: F.concat(F.lit("<PublicationType UI='D1'> "), x, F.lit("\n</PublicationType>"))
    second = F.when(i % 3 != 0, name(F.concat(F.lit("Kind  "), (i % 5).cast("string")))).otherwise(F.lit(""))
    cited = F.lit("<CommentsCorrectionsList><CommentsCorrections><PMID>1</PMID></CommentsCorrections></CommentsCorrectionsList>")
    book = F.lit("<PubmedBookArticle><BookDocument><PMID>2</PMID></BookDocument></PubmedBookArticle>")
    whole = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version='1'>"), i.cast("string"), F.lit("</PMID><Article><PublicationTypeList>"), name(F.lit("Review")), second,
        F.lit("</PublicationTypeList></Article>"), cited, F.lit("</MedlineCitation></PubmedArticle>"), book, F.lit("</PubmedArticleSet>"),
    )
    rows = A.parse_publication_types(spark.read.parquet(f"{sf}/documents.parquet").select(whole.alias("value")))
    return rows.select("pmid", F.array_join("types", "|").alias("types"))


@query("select 'd/' || doc_id || '.nxml' as name, coalesce(text, '') as text from documents")
def src_11_archives(spark, sf):
    """Documents as members of archives, half of them compressed, read back in ranges and as streams."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    name = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".nxml")).alias("path")
    part = lambda k: docs.where(F.pmod("doc_id", F.lit(2)) == k).select(name, "text")
    made = AR.write_archives(part(0), _folder(spark, "plain")).unionByName(AR.write_archives(part(1), _folder(spark, "packed"), packed=True))
    return AR.archive_files(made).select(F.substring_index("path", "!", -1).alias("name"), "text")
