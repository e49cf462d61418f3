"""Joins, aggregates, windows, decisions and parsers as queries of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import params
from ..functions import scores as S
from ..operators import pool as P
from ..operators import search as R
from ..operators import stats as ST
from ..operators.stages import shared_folder, stored
from ..sources import articles as A
from ..sources import corpus as C
from ..sources import embedding_cache as EC
from . import views as V
from .registry import query, r6


def _top(spark, sf, k=params.POOL_K):
    return R.bm25_search(V.index(spark, sf), V.asked(spark, sf), k)


@query("select b.query_idx, b.doc_idx, cast(b.rank as int) as rank, coalesce(j.grade, 0.0) as grade from bm25_top b left join judged j using (query_idx, doc_idx)", "bm25_top", "judged")
def jon_05_graded_ranking(spark, sf):
    rows = _top(spark, sf).join(V.judged(spark, sf), ["query_idx", "doc_idx"], "left")
    return rows.select("query_idx", "doc_idx", "rank", F.coalesce("grade", F.lit(0.0)).alias("grade"))


@query("select b.query_idx, count(*) as hits from bm25_top b where exists (select 1 from judged j where j.query_idx = b.query_idx and j.doc_idx = b.doc_idx and grade > 0) group by 1", "bm25_top", "judged")
def jon_06_retrieved_and_relevant(spark, sf):
    return _top(spark, sf).join(V.judged(spark, sf).where("grade > 0"), ["query_idx", "doc_idx"], "left_semi").groupBy("query_idx").agg(F.count(F.lit(1)).alias("hits"))


@query("select query_idx, qid from asked where query_idx in (select query_idx from judged)", "asked", "judged")
def jon_07_judged_queries(spark, sf):
    return V.asked(spark, sf).join(V.judged(spark, sf), "query_idx", "left_semi").select("query_idx", "qid")


@query("select distinct doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def jon_10_still_to_fetch(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return A.still_to_fetch(read("documents"), read("labels"), "doc_id")


_GATES = ", ".join(f"('{t}', " + ", ".join(f"cast({g} as double)" for g in gates) + ")" for t, gates in params.GATES.items())


@query("select item_id, g.* from benchmark b join (values " + _GATES + ") g(question_type, " + ", ".join(f"g_{m}" for m in params.MODULES) + ") on g.question_type = (['treatment', 'diagnosis_test', 'prognosis', 'other'])[item_id % 4 + 1]")
def jon_11_gates_of_queries(spark, sf):
    kinds = F.array(*[F.lit(t) for t in params.GATES])
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.element_at(kinds, F.expr("cast(item_id % 4 + 1 as int)")).alias("question_type"))
    return items.join(F.broadcast(P.gate_table(spark)), "question_type")


@query("select lang, count(*) as n, min(n_chars) as least, max(n_chars) as most, round(median(n_chars), 6) as middle, round(stddev_pop(n_chars), 4) as sd_population, round(coalesce(stddev_samp(n_chars), 0), 4) as sd_sample from documents group by 1")
def agg_08_09_spread(spark, sf):
    c = F.col("n_chars")
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), r6(F.percentile(c, 0.5)).alias("middle"),
        F.round(F.stddev_pop(c), 4).alias("sd_population"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4).alias("sd_sample"),
    )


@query("select round(quantile_cont(n_chars, 0.025), 6) as ci_lo, round(quantile_cont(n_chars, 0.975), 6) as ci_hi from documents")
def agg_10_percentiles(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("n_chars").cast("double").alias("mean"))
    return ST.interval(rows).select(r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"))


@query("select query_idx, cast(case when max(grade) > min(grade) then (max(grade) - min(grade)) / 2 else 1.0 end as double) as half_range from judged group by 1", "judged")
def agg_16_half_range(spark, sf):
    spread = F.max("grade") - F.min("grade")
    return V.judged(spark, sf).groupBy("query_idx").agg(F.when(spread > 0, spread / 2).otherwise(F.lit(1.0)).alias("half_range"))


@query("select domain, max(tau) > min(tau) as varies from factors group by 1", "factors")
def flt_06_varying_factor(spark, sf):
    tau = F.coalesce(S.temporal_decay(F.col("publication_date"), F.lit(V.AS_OF).cast("timestamp"), F.col("domain")), F.lit(1.0))
    return V.documents(spark, sf).select("domain", tau.alias("tau")).groupBy("domain").agg((F.max("tau") > F.min("tau")).alias("varies"))


@query("select sha256(coalesce(text, '')) as key, min(doc_id) as doc_id from documents group by 1")
def win_06_first_seen(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("_id"), "doc_id")
    return A.first_seen(rows, "doc_id").select(F.col("_id").alias("key"), "doc_id")


@query("select query_idx, round(bm25, 9) = round(following, 9) as tied from (select query_idx, rank, bm25, lead(bm25) over (partition by query_idx order by rank) as following from bm25_top) where rank = 10", "bm25_top")
def win_08_tie_at_cutoff(spark, sf):
    following = F.lead("bm25").over(Window.partitionBy("query_idx").orderBy("rank"))
    rows = _top(spark, sf).withColumn("following", following).where("rank = 10")
    return rows.select("query_idx", (F.round("bm25", 9) == F.round("following", 9)).alias("tied"))


@query("select '2014-' || item_id % 9 as qid, cast(item_id as varchar) as id, 2 as grade from benchmark")
def src_06_trec_judgments(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    line = lambda grade: F.concat_ws(" ", (F.col("item_id") % 9).cast("string"), F.lit("0"), F.concat(F.lit("PMC"), F.col("item_id").cast("string")), F.lit(grade))
    lines = items.select(F.col("item_id").alias("line_no"), line("1").alias("value")).unionByName(items.select((F.col("item_id") + 1_000_000).alias("line_no"), line("2").alias("value")))
    return A.parse_trec_qrels(lines, 2014)


@query("select 'q' || query_idx as qid, query_idx % 2 as parity, count(*) as judged from judged group by all", "judged")
def src_04_split_judgments(spark, sf):
    """Judgments written as one file for each split and read back with the split's name."""
    folder = f"{shared_folder(spark)}/tables/judgments-{uuid.uuid4().hex}"
    rows = V.judged(spark, sf).select(F.concat(F.lit("q"), "query_idx").alias("qid"), F.concat(F.lit("d"), "doc_idx").alias("id"), "grade", F.expr("query_idx % 2").alias("split"))
    rows.write.partitionBy("split").option("sep", "\t").option("header", True).csv(folder)
    halves = A.read_qrels(spark, f"{folder}/split=0", "0").unionByName(A.read_qrels(spark, f"{folder}/split=1", "1"))
    return halves.groupBy("qid", F.col("split").cast("long").alias("parity")).agg(F.count(F.lit(1)).alias("judged"))


_FILES = "select doc_id, doc_id % 900 as own, doc_id % 800 as inside, case when doc_id % 7 = 3 then 'parse_error' when doc_id % 11 = 5 then 'no_article_meta' else 'parsed' end as status from documents"


def _article_files(spark, sf) -> DataFrame:
    """An article file for each document (source, path, member, text); some are broken, without meta data, or of one number."""
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    tag = lambda kind, c: F.concat(F.lit(f'<article-id pub-id-type="{kind}">'), text(c), F.lit("</article-id>"))
    when = lambda c, x: F.when(F.expr(c), x).otherwise(F.lit(""))
    meta = F.concat(
        tag("pmc", F.concat(F.lit("PMC"), text(i % 800))), when("doc_id % 3 = 0", tag("pmid", i)), when("doc_id % 4 = 1", F.lit('<pub-date pub-type="epub"><year>2000</year></pub-date>')),
        when("doc_id % 5 <> 0", F.concat(F.lit("<abstract>"), F.length("text").cast("string"), F.lit(" signs</abstract>"))),
    )
    whole = F.concat(F.lit("<article><front><article-meta>"), meta, F.lit("</article-meta></front></article>"))
    file = F.when(F.expr("doc_id % 7 = 3"), "<article><front>").when(F.expr("doc_id % 11 = 5"), "<article><front/></article>").otherwise(whole)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select(F.lit(0).alias("source"), F.concat(F.lit("a/PMC"), text(i % 900), F.lit(".nxml")).alias("path"), i.alias("member"), file.alias("text"))


@query(f"""with f as ({_FILES}), k as (select * from f where status = 'parsed' qualify row_number() over (partition by own order by doc_id) = 1)
select (select count(*) from f where status = 'parse_error') as parse_error, (select count(*) from f where status = 'no_article_meta') as no_article_meta,
  (select count(*) from f where status = 'parsed') - count(*) as duplicate_id, count(*) as written, count(*) filter (doc_id % 5 <> 0) as with_abstract, count(*) filter (doc_id % 4 = 1) as with_date,
  count(*) filter (doc_id % 3 = 0) as with_pmid, count(*) filter (own <> inside) as file_name_differs_from_article_id from k""")
def agg_18_corpus_counts(spark, sf):
    """What became of every article file: errors, duplicates and what the records kept hold."""
    parsed = stored(C.article_statuses(_article_files(spark, sf)), "parsed")
    return C.corpus_counts(parsed, C.first_of_each(parsed))


@query(f"select cast(own as varchar) as _id, cast(inside as varchar) as pmc_in_file, case when doc_id % 3 = 0 then cast(doc_id as varchar) end as pmid, case when doc_id % 5 <> 0 then coalesce(length(text), 0) || ' signs' else '' end as abstract, case when doc_id % 4 = 1 then '2000-01-01' end as pub_date from (select f.*, text from ({_FILES}) f join documents using (doc_id)) where status = 'parsed' qualify row_number() over (partition by own order by doc_id) = 1")
def src_08_articles(spark, sf):
    return C.first_of_each(C.article_statuses(_article_files(spark, sf))).select("_id", "pmc_in_file", "pmid", "abstract", "pub_date")


@query("select count(distinct text) as first_misses, 0::bigint as second_misses, count(*) as documents, count(text) as embedded from documents")
def src_14_embedding_cache(spark, sf):
    """Documents through the embedding cache twice: the second run finds every text that the first has written back."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = f"{shared_folder(spark)}/tables/cache-{uuid.uuid4().hex}"
    first, second = (EC.fill(docs, path, "hash", EC.hash_encoder()) for _ in range(2))
    out = EC.with_embeddings(docs, path, "hash").agg(F.count(F.lit(1)).alias("documents"), F.count("embedding").alias("embedded"))
    return out.select(F.lit(first).cast("long").alias("first_misses"), F.lit(second).cast("long").alias("second_misses"), "documents", "embedded")
