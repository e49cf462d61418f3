"""Index, search, fusion, reranking, metrics, arms and statistics as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import scores as S
from ..operators import metrics as M
from ..operators import pool as P
from ..operators import postings as PO
from ..operators import search as R
from ..operators import stats as ST
from ..operators.stages import cut
from . import views as V
from .registry import query, r6


def as_of():
    return F.lit(V.AS_OF).cast("timestamp")


def _index(spark: SparkSession, sf: str) -> R.Index:
    return V.index(spark, sf)


@query("select doc_idx, term, cast(tf as int) as tf from postings", "postings")
def agg_01_term_frequency(spark, sf):
    return _index(spark, sf).postings.select("doc_idx", "term", "tf")


@query("select term, df from terms", "terms")
def agg_02_document_frequency(spark, sf):
    return _index(spark, sf).terms


@query("select n, round(avgdl, 6) as avgdl from corpus", "corpus")
def agg_03_corpus_statistics(spark, sf):
    return _index(spark, sf).corpus.select("n", r6("avgdl").alias("avgdl"))


@query("select query_idx, doc_idx, round(bm25, 6) as bm25 from bm25", "bm25")
def agg_04_bm25_scores(spark, sf):
    return R.bm25_scores(_index(spark, sf), V.asked(spark, sf)).select("query_idx", "doc_idx", r6("bm25").alias("bm25"))


@query("select count(*) as postings, cast(sum(tf) as bigint) as tokens, count(distinct term) as terms from postings", "postings")
def agg_05_index_sizes(spark, sf):
    i = _index(spark, sf)
    return i.rows.agg(F.sum(F.size("terms")).cast("long").alias("postings"), F.sum("dl").alias("tokens")).crossJoin(F.broadcast(i.terms.agg(F.count(F.lit(1)).alias("terms"))))


@query("select term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from terms cross join corpus", "terms", "corpus")
def scl_19_idf(spark, sf):
    i = _index(spark, sf)
    return i.terms.crossJoin(F.broadcast(i.corpus)).select("term", r6(S.idf(F.col("n"), F.col("df"))).alias("idf"))


@query("select doc_idx, round(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 5) as tf_norm from postings join lengths using (doc_idx) cross join corpus group by 1", "postings", "lengths", "corpus")
def scl_20_tf_norm(spark, sf):
    i = _index(spark, sf)
    rows = i.postings.crossJoin(F.broadcast(i.corpus))
    return rows.groupBy("doc_idx").agg(F.round(F.sum(S.tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"))), 5).alias("tf_norm"))


@query("select query_idx, term, cast(times as bigint) as times, df from query_terms join terms using (term)", "query_terms", "terms")
def jon_02_terms_with_df(spark, sf):
    return R.query_terms(V.asked(spark, sf)).join(_index(spark, sf).terms, "term").select("query_idx", "term", "times", "df")


@query("select query_idx, count(*) as matched, case when count(*) < 10 then '<10' when count(*) < 100 then '10-99' else '>=100' end as stratum from bm25 where bm25 <> 0 group by 1", "bm25")
def flt_03_match_strata(spark, sf):
    n = F.count(F.lit(1))
    stratum = F.when(n < 10, "<10").when(n < 100, "10-99").otherwise(">=100")
    return R.bm25_scores(_index(spark, sf), V.asked(spark, sf)).where("bm25 <> 0").groupBy("query_idx").agg(n.alias("matched"), stratum.alias("stratum"))


_PROBES = "(values (0, 'no such token zzzz'), (1, ''), (2, 'the THE the'), (3, (select term from terms order by df, term limit 1)), (4, '!? --')) v(query_idx, text)"


def _probes(spark, terms: DataFrame) -> DataFrame:
    rows = spark.createDataFrame([(0, "no such token zzzz"), (1, ""), (2, "the THE the"), (4, "!? --")], "query_idx long, text string")
    return rows.unionByName(terms.orderBy("df", "term").limit(1).select(F.lit(3).cast("long").alias("query_idx"), F.col("term").alias("text")))


@query(
    """select cast(query_idx as bigint) as query_idx, doc_idx, round(bm25, 6) as bm25, cast(rank as int) as rank from (
  select query_idx, doc_idx, bm25, row_number() over (partition by query_idx order by round(bm25, 9) desc, doc_idx) as rank
  from (select query_idx, doc_idx, coalesce(bm25, 0.0) as bm25 from probes cross join docs left join probe_scores using (query_idx, doc_idx))) where rank <= 10""",
    "postings", "terms", "corpus", "lengths",
    extra={
        "probes": f"select * from {_PROBES}",
        "probe_terms": r"select query_idx, term, count(*) as times from (select query_idx, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from probes) group by all",
        "probe_scores": V.CTES["bm25"][1].replace("query_terms q", "probe_terms q"),
    },
)
def jon_04_zero_padding(spark, sf):
    i = _index(spark, sf)
    return R.bm25_search(i, _probes(spark, i.terms)).select("query_idx", "doc_idx", r6("bm25").alias("bm25"), "rank")


@query("select query_idx, doc_idx, round(bm25, 6) as bm25, cast(rank as int) as rank from bm25_top where rank <= 10", "bm25_top")
def top_01_bm25_search(spark, sf):
    return R.bm25_search(_index(spark, sf), V.asked(spark, sf)).select("query_idx", "doc_idx", r6("bm25").alias("bm25"), "rank")


@query("select query_idx, doc_idx, round(bm25, 6) as bm25, cast(rank as int) as rank from bm25_top where rank <= 10", "bm25_top")
def top_01_block_search(spark, sf):
    found = PO.bm25_block_search(PO.postings_of(_index(spark, sf)), V.asked(spark, sf))
    return found.select("query_idx", "doc_idx", r6("bm25").alias("bm25"), "rank")


@query("select query_idx, doc_idx, term, cast(times as bigint) as times, cast(tf as int) as tf from query_terms join postings using (term)", "query_terms", "postings")
def jon_01_query_postings(spark, sf):
    return PO.query_postings(PO.postings_of(_index(spark, sf)), V.asked(spark, sf))


@query("select query_idx, count(distinct doc_idx) as documents, count(*) as met from query_terms join postings using (term) group by query_idx", "query_terms", "postings")
def flt_01_documents_with_a_term(spark, sf):
    """Of each query, the documents that hold one of its terms; the others are never met."""
    return PO.query_documents(PO.postings_of(_index(spark, sf)), V.asked(spark, sf))


@query(
    f"""select term, doc_idx // {PO.BLOCK_DOCS} as block, cast(count(*) as int) as n, min(doc_idx) as first_doc, max(doc_idx) as last_doc, cast(sum(tf) as bigint) as tokens,
    cast(max(tf) as int) as most, min(dl) as shortest from postings join lengths using (doc_idx) group by all""",
    "postings", "lengths",
)
def agg_06_posting_blocks(spark, sf):
    tokens = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    return PO.postings_of(_index(spark, sf)).rows.select(
        "term", "block", "n", F.element_at("docs", 1).alias("first_doc"), F.element_at("docs", -1).alias("last_doc"), tokens.alias("tokens"),
        F.element_at("front.tf", -1).alias("most"), F.element_at("front.dl", 1).alias("shortest"),
    )


@query("select query_idx, round(mean, 5) as mean, round(sd, 5) as sd from standard", "standard")
def win_02_bm25_standard(spark, sf):
    i = _index(spark, sf)
    return R.bm25_moments(i, V.asked(spark, sf)).select("query_idx", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


@query("select query_idx, doc_idx, round(hybrid, 6) as hybrid, cast(rank as int) as rank from hybrid_top", "hybrid_top")
def top_02_hybrid_search(spark, sf):
    return R.hybrid_search(_index(spark, sf), V.asked(spark, sf)).select("query_idx", "doc_idx", r6("hybrid").alias("hybrid"), "rank")


def _pool(spark, sf) -> DataFrame:
    """The hybrid pool with every factor and grade; its ranks are pool_rank."""
    docs, asked = V.documents(spark, sf), V.asked(spark, sf)
    factors = R.relevance_factors(R.hybrid_search(_index(spark, sf), asked), docs, asked, as_of())
    graded = factors.join(V.judged(spark, sf), ["query_idx", "doc_idx"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    return cut(graded.withColumnRenamed("rank", "pool_rank"))


def _reranked(name: str, pool: DataFrame, **options) -> DataFrame:
    score = S.composite(F.col("cosine"), F.col("apply"), F.col("action"), F.col("tau"), F.col("evidence"), **options)
    return P.arm(pool, name, score)


def _composite_sql(topic="0.5", apply="0.3", action="0.2", tau="tau", evidence="evidence", cosine="cosine"):
    return f"{tau} * {evidence} * ({topic} * {cosine} + {apply} * apply + {action} * action)"


def _ranked_sql(name: str, score: str) -> str:
    return f"select '{name}' as arm, query_idx, doc_idx, row_number() over (partition by query_idx order by round({score}, 9) desc, pool_rank) as rank from pool"


@query(f"select query_idx, doc_idx, cast(rank as int) as rank from ({_ranked_sql('r', _composite_sql())}) where rank <= 10", "pool")
def top_03_clinical_rerank(spark, sf):
    return _reranked("r", _pool(spark, sf)).where("rank <= 10").select("query_idx", "doc_idx", "rank")


@query(f"select query_idx, doc_idx, cast(rank as int) as rank from ({_ranked_sql('r', _composite_sql(tau='1.0'))})", "pool")
def top_04_rerank_whole_pool(spark, sf):
    return _reranked("r", _pool(spark, sf), use_tau=False).select("query_idx", "doc_idx", "rank")


@query("select query_idx, cast(min(rank) as int) as first_hit from bm25_top join judged using (query_idx, doc_idx) where grade > 0 group by 1", "bm25_top", "judged")
def top_09_first_hit(spark, sf):
    top = R.bm25_search(_index(spark, sf), V.asked(spark, sf), params.POOL_K)
    return top.join(V.judged(spark, sf).where("grade > 0"), ["query_idx", "doc_idx"]).groupBy("query_idx").agg(F.min("rank").alias("first_hit"))


# -- metrics of arms as one long table ---------------------------------------------------------

_ABLATIONS = {
    "full_clinical": ({}, _composite_sql()),
    "abl_temporal_off": ({"use_tau": False}, _composite_sql(tau="1.0")),
    "abl_evidence_off": ({"use_evidence": False}, _composite_sql(evidence="1.0")),
    "abl_topic_off": ({"weights": S.weights_without("topic")}, _composite_sql(topic="0.0")),
    "abl_apply_off": ({"weights": S.weights_without("apply")}, _composite_sql(apply="0.0")),
    "abl_action_off": ({"weights": S.weights_without("action")}, _composite_sql(action="0.0")),
}
_KEYS = {"cos_only_rerank": "cosine", "bm25_rerank_of_pool": "bm25", "oracle_rerank_of_pool": "grade", "hybrid_unreranked": "hybrid"}
_ARMS_SQL = " union all ".join(
    ["select 'bm25' as arm, query_idx, doc_idx, rank from bm25_top", *[_ranked_sql(n, s) for n, (_, s) in _ABLATIONS.items()], *[_ranked_sql(n, s) for n, s in _KEYS.items()]]
)
_METRICS_SQL = """select arm, a.query_idx, count(distinct case when coalesce(grade, 0) > 0 and rank <= 10 then a.doc_idx end) / 10.0 as p,
  case when coalesce(any_value(idcg), 0) > 0 then sum(case when rank <= 10 then coalesce(grade, 0) / log2(rank + 1) else 0.0 end) / any_value(idcg) else 0.0 end as ndcg,
  coalesce(1.0 / min(case when coalesce(grade, 0) > 0 then rank end), 0.0) as mrr
  from arms a left join judged j on j.query_idx = a.query_idx and j.doc_idx = a.doc_idx left join ideal i on i.query_idx = a.query_idx group by arm, a.query_idx"""
_NEEDS = ("bm25_top", "pool", "judged", "ideal")
_EXTRA = {"arms": _ARMS_SQL, "metrics": _METRICS_SQL}


def _rankings(spark, sf) -> DataFrame:
    pool = _pool(spark, sf)
    bm25 = R.bm25_search(_index(spark, sf), V.asked(spark, sf), params.POOL_K).select(F.lit("bm25").alias("arm"), "query_idx", "doc_idx", "rank")
    arms = [bm25, *[_reranked(n, pool, **o) for n, (o, _) in _ABLATIONS.items()], *[P.arm(pool, n, F.col(c)) for n, c in _KEYS.items()]]
    return reduce(DataFrame.unionByName, arms)


def _metrics(spark, sf) -> DataFrame:
    return cut(M.per_query(cut(_rankings(spark, sf)), V.judged(spark, sf)))


@query("select arm, query_idx, round(cast(p as double), 6) as p, round(ndcg, 6) as ndcg, round(cast(mrr as double), 6) as mrr from metrics", *_NEEDS, extra=_EXTRA)
def arm_01_to_14_per_query(spark, sf):
    return _metrics(spark, sf).select("arm", "query_idx", r6("p").alias("p"), r6("ndcg").alias("ndcg"), r6("mrr").alias("mrr"))


@query("select arm, round(avg(p), 6) as p_at_10, round(avg(ndcg), 6) as ndcg_at_10, round(avg(mrr), 6) as mrr from metrics group by arm", *_NEEDS, extra=_EXTRA)
def met_05_compare_methods(spark, sf):
    return M.compare(_metrics(spark, sf)).select("arm", r6("p_at_10").alias("p_at_10"), r6("ndcg_at_10").alias("ndcg_at_10"), r6("mrr").alias("mrr"))


def _one_arm(spark, sf) -> DataFrame:
    top = R.bm25_search(_index(spark, sf), V.asked(spark, sf), params.POOL_K).select(F.lit("bm25").alias("arm"), "query_idx", "doc_idx", "rank")
    return M.per_query(top, V.judged(spark, sf))


_ONE = {"arms": "select 'bm25' as arm, query_idx, doc_idx, rank from bm25_top", "metrics": _METRICS_SQL}
_ONE_NEEDS = ("bm25_top", "judged", "ideal")


@query("select query_idx, round(cast(p as double), 6) as p_at_10 from metrics", *_ONE_NEEDS, extra=_ONE)
def met_01_precision_at_k(spark, sf):
    return _one_arm(spark, sf).select("query_idx", r6("p").alias("p_at_10"))


@query("select query_idx, round(ndcg, 6) as ndcg_at_10 from metrics", *_ONE_NEEDS, extra=_ONE)
def met_03_ndcg_at_k(spark, sf):
    return _one_arm(spark, sf).select("query_idx", r6("ndcg").alias("ndcg_at_10"))


@query("select query_idx, round(cast(mrr as double), 6) as mrr from metrics", *_ONE_NEEDS, extra=_ONE)
def met_04_mrr(spark, sf):
    return _one_arm(spark, sf).select("query_idx", r6("mrr").alias("mrr"))


@query("select query_idx, round(idcg, 6) as idcg from ideal", "ideal")
def met_02_ideal_dcg(spark, sf):
    return M.ideal_dcg(V.judged(spark, sf)).select("query_idx", r6("idcg").alias("idcg"))


_BOUNDS = {"bounds": "select a.arm, round(b.m, 6) as baseline, round(a.m, 6) as experimental from (select arm, avg(ndcg) as m from metrics group by arm) a, (select avg(ndcg) as m from metrics where arm = 'bm25') b where a.arm <> 'bm25'"}


def _bounds(spark, sf) -> DataFrame:
    """(arm, baseline, experimental): the mean NDCG of every arm beside that of BM25."""
    means = _metrics(spark, sf).groupBy("arm").agg(r6(F.avg("ndcg")).alias("experimental"))
    base = means.where("arm = 'bm25'").select(F.col("experimental").alias("baseline"))
    return means.where("arm <> 'bm25'").crossJoin(F.broadcast(base))


@query("""select arm, baseline, experimental, experimental - baseline >= 0.05 as passed, case when experimental - baseline >= 0.05 then 'PASS: +' || printf('%.3f', experimental - baseline)
  when experimental > baseline then 'FAIL: +' || printf('%.3f', experimental - baseline) || ' < 0.05 required' else 'FAIL: no improvement (' || printf('%.3f', experimental - baseline) || ')' end as message from bounds""", *_NEEDS, extra=_EXTRA | _BOUNDS)
def met_06_conjecture(spark, sf):
    rows = _bounds(spark, sf).withColumn("c", M.conjecture(F.col("baseline"), F.col("experimental")))
    return rows.select("arm", "baseline", "experimental", "c.passed", "c.message")


@query("select arm, baseline, experimental, experimental >= baseline + 0.05 as absolute, experimental >= baseline * 1.05 as relative from bounds", *_NEEDS, extra=_EXTRA | _BOUNDS)
def met_07_both_bars(spark, sf):
    rows = _bounds(spark, sf).withColumn("c", M.bars(F.col("baseline"), F.col("experimental")))
    return rows.select("arm", "baseline", "experimental", "c.absolute", "c.relative")


@query("select query_idx, round(sum(case when in_pool then 1.0 else 0.0 end) / count(*), 6) as recall from (select j.query_idx, p.doc_idx is not null as in_pool from judged j left join hybrid_top p using (query_idx, doc_idx) where grade > 0) group by 1", "judged", "hybrid_top")
def met_08_pool_recall(spark, sf):
    pool = R.hybrid_search(_index(spark, sf), V.asked(spark, sf)).select("query_idx", "doc_idx", F.lit(1.0).alias("hit"))
    rows = V.judged(spark, sf).where("grade > 0").join(pool, ["query_idx", "doc_idx"], "left")
    return rows.groupBy("query_idx").agg(r6(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("recall"))


@query("select query_idx, count(*) as overlap from bm25_top b join hybrid_top h using (query_idx, doc_idx) group by 1", "bm25_top", "hybrid_top")
def set_02_pool_overlap(spark, sf):
    i, asked = _index(spark, sf), V.asked(spark, sf)
    a, b = R.bm25_search(i, asked, params.POOL_K).select("query_idx", "doc_idx"), R.hybrid_search(i, asked).select("query_idx", "doc_idx")
    return a.intersect(b).groupBy("query_idx").agg(F.count(F.lit(1)).alias("overlap"))


@query("select count(distinct doc_idx) as pooled from hybrid_top", "hybrid_top")
def set_03_pooled_documents(spark, sf):
    return R.hybrid_search(_index(spark, sf), V.asked(spark, sf)).select("doc_idx").distinct().agg(F.count(F.lit(1)).alias("pooled"))


@query("select p.query_idx, count(*) as pairs from pool p join pool q on p.query_idx = q.query_idx and p.grade > q.grade group by 1", "pool")
def jon_12_grade_dominance(spark, sf):
    pool = _pool(spark, sf).select("query_idx", "grade")
    pairs = pool.alias("a").join(pool.alias("b"), F.expr("a.query_idx = b.query_idx and a.grade > b.grade"))
    return pairs.groupBy(F.col("a.query_idx").alias("query_idx")).agg(F.count(F.lit(1)).alias("pairs"))


@query("select query_idx from pool group by 1 having max(grade) > min(grade)", "pool")
def flt_04_gradable_pools(spark, sf):
    return _pool(spark, sf).groupBy("query_idx").agg(F.max("grade").alias("hi"), F.min("grade").alias("lo")).where("hi > lo").select("query_idx")


@query("select query_idx, round(stddev_pop(0.4 * z) / stddev_pop(0.6 * cosine), 4) as ratio from hybrid group by 1 having stddev_pop(cosine) > 1e-12", "hybrid")
def arm_16_sd_ratio(spark, sf):
    rows = R.hybrid_scores(_index(spark, sf), V.asked(spark, sf))
    out = rows.groupBy("query_idx").agg(F.stddev_pop(0.4 * F.col("z")).alias("a"), F.stddev_pop(0.6 * F.col("cosine")).alias("b")).where("b > 0.6e-12")
    return out.select("query_idx", F.round(F.col("a") / F.col("b"), 4).alias("ratio"))


_RANKED = "select query_idx, rank() over (partition by query_idx order by round({x}, 9)) + (count(*) over (partition by query_idx, round({x}, 9)) - 1) / 2.0 as rx, rank() over (partition by query_idx order by round({y}, 9)) + (count(*) over (partition by query_idx, round({y}, 9)) - 1) / 2.0 as ry from pool"


@query(f"select query_idx, case when max(rx) > min(rx) and max(ry) > min(ry) then round(corr(rx, ry), 6) end as rho from ({_RANKED.format(x=_composite_sql(), y='evidence')}) group by 1", "pool")
def arm_17_score_drivers(spark, sf):
    score = S.composite(F.col("cosine"), F.col("apply"), F.col("action"), F.col("tau"), F.col("evidence"))
    rows = _pool(spark, sf).select("query_idx", F.round(score, 9).alias("score"), F.round("evidence", 9).alias("evidence"))
    return ST.spearman(rows, "score", "evidence").select("query_idx", r6("rho").alias("rho"))


@query("select query_idx, count(distinct round(cosine, 6)) as cosines, count(distinct evidence) as weights, round(max(tau) - min(tau), 6) as tau_spread, round(median(action), 6) as action_median from pool group by 1", "pool")
def arm_25_pool_spread(spark, sf):
    return _pool(spark, sf).groupBy("query_idx").agg(
        F.countDistinct(F.round("cosine", 6)).alias("cosines"), F.countDistinct("evidence").alias("weights"), r6(F.max("tau") - F.min("tau")).alias("tau_spread"), r6(F.percentile("action", 0.5)).alias("action_median")
    )


@query(f"select arm, query_idx, doc_idx, cast(rank as int) as rank from ({_ranked_sql('composite_oracle', _composite_sql(cosine='(grade / 2)'))})", "pool")
def arm_19_oracle_topic(spark, sf):
    pool = _pool(spark, sf).withColumn("cosine", F.col("grade") / 2)
    return _reranked("composite_oracle", pool)


@query("select query_idx, doc_idx, cast(rank as int) as rank from (select query_idx, doc_idx, row_number() over (partition by query_idx order by round(cosine, 9) desc, doc_idx) as rank from hybrid) where rank <= 100", "hybrid")
def arm_20_full_corpus_cosine(spark, sf):
    return R.vector_search(_index(spark, sf).rows, V.asked(spark, sf)).select("query_idx", "doc_idx", "rank")


@query("select query_idx, doc_idx, cast(rank as int) as rank from (select query_idx, doc_idx, row_number() over (partition by query_idx order by round(cosine, 9) desc, rank) as rank from (select b.*, h.cosine from bm25_top b join hybrid0 h using (query_idx, doc_idx)))", "bm25_top", "hybrid0")
def arm_22_bm25_pool_by_cosine(spark, sf):
    i, asked = _index(spark, sf), V.asked(spark, sf)
    pool = R.bm25_search(i, asked, params.POOL_K).withColumnRenamed("rank", "pool_rank")
    pool = R.relevance_factors(pool.withColumn("cosine", F.lit(0.0)), V.documents(spark, sf), asked, as_of())
    return P.arm(pool, "pool_cos", F.col("cosine")).select("query_idx", "doc_idx", "rank")


# -- gated composition ------------------------------------------------------------------------

_MODULES_SQL = """select query_idx, doc_idx, pool_rank, grade, query_text, bm25, cosine as topical,
  case when doc_idx % 11 = 0 then null else cast(evidence as double) end as evidence, case when publication_date is null or doc_idx % 13 = 0 then null else tau end as temporal,
  cast(apply as double) as applicability, cast(action as double) as actionability,
  (['treatment', 'diagnosis_test', 'prognosis', 'other'])[query_idx % 4 + 1] as question_type from pool"""
_MODS = params.MODULES
_FILL_SQL = "select query_idx, doc_idx, pool_rank, grade, question_type, " + ", ".join(f"coalesce({m}, avg({m}) over (partition by query_idx), 0) as {m}" for m in _MODS) + " from modules"
_Z_SQL = "select query_idx, doc_idx, pool_rank, grade, question_type, " + ", ".join(f"case when max({m}) over w > min({m}) over w then ({m} - avg({m}) over w) / stddev_pop({m}) over w else 0.0 end as z_{m}" for m in _MODS) + " from filled_modules window w as (partition by query_idx)"
_POOL_EXTRA = {"modules": _MODULES_SQL, "filled_modules": _FILL_SQL, "zs": _Z_SQL}


def _modules(spark, sf) -> DataFrame:
    pool = _pool(spark, sf).join(V.documents(spark, sf).select("doc_idx", "publication_date"), "doc_idx")
    kinds = F.array(*[F.lit(t) for t in params.GATES])
    return pool.select(
        "query_idx", "doc_idx", "pool_rank", "grade", "bm25", F.col("cosine").alias("topical"), F.when(F.expr("doc_idx % 11 <> 0"), F.col("evidence")).alias("evidence"),
        F.when(F.col("publication_date").isNotNull() & F.expr("doc_idx % 13 <> 0"), F.col("tau")).alias("temporal"), F.col("apply").alias("applicability"), F.col("action").alias("actionability"),
        F.element_at(kinds, F.expr("cast(query_idx % 4 + 1 as int)")).alias("question_type"),
    )


@query("select query_idx, doc_idx, " + ", ".join(f"round({m}, 6) as {m}" for m in _MODS) + " from filled_modules", "pool", extra={k: _POOL_EXTRA[k] for k in ("modules", "filled_modules")})
def scl_25_fill_pool_mean(spark, sf):
    rows = _modules(spark, sf)
    return rows.select("query_idx", "doc_idx", *[r6(P.filled(F.col(m))).alias(m) for m in _MODS])


@query("select query_idx, doc_idx, " + ", ".join(f"round(z_{m}, 5) as z_{m}" for m in _MODS) + " from zs", "pool", extra=_POOL_EXTRA)
def scl_24_pool_z(spark, sf):
    return P.normalised(_modules(spark, sf)).select("query_idx", "doc_idx", *[F.round(f"z_{m}", 5).alias(f"z_{m}") for m in _MODS])


_GATE_SQL = {m: "case question_type " + " ".join(f"when '{t}' then {g[i]}" for t, g in params.GATES.items()) + " end" for i, m in enumerate(_MODS)}


def _gated_sql(gates: dict[str, str], off=("applicability",)) -> str:
    return " + ".join(f"({gates[m]}) * z_{m}" for m in _MODS if m not in off)


@query(f"select query_idx, doc_idx, round({_gated_sql(_GATE_SQL)}, 5) as gated from zs", "pool", extra=_POOL_EXTRA)
def scl_26_gated_sum(spark, sf):
    rows = P.normalised(_modules(spark, sf)).join(F.broadcast(P.gate_table(spark)), "question_type")
    return rows.select("query_idx", "doc_idx", F.round(P.gated(rows, None), 5).alias("gated"))


_TYPE_PLACE = "case question_type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(params.GATES)) + " end"
_BY_PLACE = " + ".join(f"z_{m} * ({i + 1} + {i + 7} + {len(_MODS)} * ({_TYPE_PLACE}))" for i, m in enumerate(_MODS))


@query(f"select query_idx, doc_idx, {len(_MODS) * (1 + len(params.GATES))} as n, round({_BY_PLACE}, 4) as by_place from zs", "pool", extra=_POOL_EXTRA)
def scl_27_ranker_features(spark, sf):
    """The features, each times its place from 1: a feature in a wrong place changes the sum."""
    rows = P.normalised(_modules(spark, sf))
    x = P.features(rows)
    placed = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rows.select("query_idx", "doc_idx", F.size(x).alias("n"), F.round(placed, 4).alias("by_place"))


_ALL_ON = {m: "1" for m in _MODS}
_COMPOSED = {
    "B0": ("-pool_rank", None), "M": (_gated_sql(_GATE_SQL), None), "U": (_gated_sql(_ALL_ON), None), "V": (_gated_sql(_GATE_SQL, ("applicability", "evidence")), None),
}


def _permuted_gates(seed: int) -> dict[str, str]:
    columns = params.GATE_PERMUTATIONS[seed]
    return {m: "case question_type " + " ".join(f"when '{t}' then {params.GATES[c][i]}" for t, c in zip(params.GATES, columns, strict=True)) + " end" for i, m in enumerate(_MODS)}


_COMPOSED |= {f"R{s}": (_gated_sql(_permuted_gates(s)), None) for s in range(5)}
_COMPOSED_SQL = " union all ".join(f"select '{n}' as arm, query_idx, doc_idx, row_number() over (partition by query_idx order by round({s}, 9) desc, pool_rank) as rank from zs" for n, (s, _) in _COMPOSED.items())


def _composed(spark, sf) -> DataFrame:
    return _composed_arms(spark, cut(P.normalised(_modules(spark, sf))))


def _composed_arms(spark, rows: DataFrame) -> DataFrame:
    own = lambda c=None: rows.join(F.broadcast(P.gate_table(spark, c)), "question_type")
    total = lambda off=("applicability",): reduce(lambda a, b: a + b, [F.col(f"z_{m}") for m in _MODS if m not in off])
    arms = [P.arm(rows, "B0", -F.col("pool_rank")), P.arm(own(), "M", P.gated(rows, None)), P.arm(rows, "U", total()), P.arm(own(), "V", P.gated(rows, None, ("applicability", "evidence")))]
    arms += [P.arm(own(c), f"R{s}", P.gated(rows, None)) for s, c in enumerate(params.GATE_PERMUTATIONS)]
    return reduce(DataFrame.unionByName, arms)


@query("select arm, query_idx, doc_idx, cast(rank as int) as rank from composed where rank <= 10", "pool", extra=_POOL_EXTRA | {"composed": _COMPOSED_SQL})
def arm_26_to_32_composed(spark, sf):
    return _composed(spark, sf).where("rank <= 10")


_COMPOSED_EXTRA = _POOL_EXTRA | {"arms": _COMPOSED_SQL, "metrics": _METRICS_SQL}


def _composed_metrics(spark, sf) -> DataFrame:
    return cut(M.per_query(cut(_composed(spark, sf)), V.judged(spark, sf)))


@query("select count(*) as n, round(avg(d), 6) as mean, round(coalesce(stddev_samp(d), 0), 6) as sd, count(*) filter (d > 0) as wins, count(*) filter (d < 0) as losses, count(*) filter (d = 0) as ties, round(2.8 * coalesce(stddev_samp(d), 0) / sqrt(count(*)), 6) as mde80 from (select round(a.ndcg - b.ndcg, 9) as d from metrics a join metrics b on a.query_idx = b.query_idx and a.arm = 'M' and b.arm = 'B0')", "pool", "judged", "ideal", extra=_COMPOSED_EXTRA)
def sta_02_paired(spark, sf):
    diffs = ST.differences(_composed_metrics(spark, sf), "M", "B0").withColumn("diff", F.round("diff", 9))
    return ST.paired(diffs).select("n", r6("mean").alias("mean"), r6("sd").alias("sd"), "wins", "losses", "ties", r6("mde80").alias("mde80"))


@query("select query_idx, list(doc_idx order by rank) filter (arm = 'M' and rank <= 10) = list(doc_idx order by rank) filter (arm = 'U' and rank <= 10) as same from composed group by 1", "pool", extra=_POOL_EXTRA | {"composed": _COMPOSED_SQL})
def set_06_same_top_lists(spark, sf):
    return ST.same_lists(_composed(spark, sf), "M", "U")


@query("select avg(cast(not same as int)) >= 0.5 as manipulated, round(avg(cast(not same as int)), 6) as share from (select query_idx, list(doc_idx order by rank) filter (arm = 'M' and rank <= 10) = list(doc_idx order by rank) filter (arm = 'U' and rank <= 10) as same from composed where query_idx % 4 = 1 group by 1)", "pool", extra=_POOL_EXTRA | {"composed": _COMPOSED_SQL})
def sta_10_manipulation(spark, sf):
    same = ST.same_lists(_composed(spark, sf), "M", "U").where("query_idx % 4 = 1")
    share = F.avg((~F.col("same")).cast("int"))
    return same.agg((share >= params.MANIPULATION_SHARE).alias("manipulated"), r6(share).alias("share"))


_DRAWN = "cast(('0x' || substr(md5({text}), 1, 12)) as bigint) / 281474976710656.0"
_DIFFS = {"diffs": "select a.query_idx, round(a.ndcg - b.ndcg, 9) as diff, row_number() over (order by a.query_idx) - 1 as place, count(*) over () as n from metrics a join metrics b on a.query_idx = b.query_idx and a.arm = 'M' and b.arm = 'B0'"}


@query(f"select round(quantile_cont(mean, 0.025), 6) as ci_lo, round(quantile_cont(mean, 0.975), 6) as ci_hi from (select draw, avg(d.diff) as mean from (select draw, cast(floor({_DRAWN.format(text=chr(39) + 'b|' + chr(39) + ' || draw || ' + chr(39) + '|' + chr(39) + ' || place')} * n) as bigint) as place from diffs cross join range({params.BOOTSTRAP_DRAWS}) r(draw)) w join diffs d using (place) group by draw)", "pool", "judged", "ideal", extra=_COMPOSED_EXTRA | _DIFFS)
def sta_01_bootstrap_interval(spark, sf):
    diffs = ST.differences(_composed_metrics(spark, sf), "M", "B0").withColumn("diff", F.round("diff", 9))
    return ST.interval(ST.bootstrap_means(diffs, params.BOOTSTRAP_DRAWS)).select(r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"))


@query(f"select round((1 + count(*) filter (m >= seen - 1e-12)) / {params.SIGN_FLIPS + 1}.0, 6) as p from (select draw, abs(avg(diff * case when {_DRAWN.format(text=chr(39) + 's|' + chr(39) + ' || draw || ' + chr(39) + '|' + chr(39) + ' || query_idx')} < 0.5 then -1.0 else 1.0 end)) as m from diffs cross join range({params.SIGN_FLIPS}) r(draw) group by draw), (select abs(avg(diff)) as seen from diffs)", "pool", "judged", "ideal", extra=_COMPOSED_EXTRA | _DIFFS)
def sta_02_sign_flips(spark, sf):
    diffs = ST.differences(_composed_metrics(spark, sf), "M", "B0").withColumn("diff", F.round("diff", 9))
    return ST.sign_flip_p(diffs, params.SIGN_FLIPS).select(r6("p").alias("p"))


@query(
    """select count(*) as differing from (
  (select query_idx, doc_idx, rank from bm25_top except all select query_idx, doc_idx, rank from padded) union all (select query_idx, doc_idx, rank from padded except all select query_idx, doc_idx, rank from bm25_top))""",
    "bm25_top", "bm25", "asked", "docs",
    extra={
        "fillers": "select query_idx, doc_idx, 0.0 as bm25 from asked cross join (select doc_idx from docs order by doc_idx limit 200) anti join bm25 using (query_idx, doc_idx)",
        "padded": "select * from (select query_idx, doc_idx, row_number() over (partition by query_idx order by round(bm25, 9) desc, doc_idx) as rank from (select query_idx, doc_idx, bm25 from bm25 union all select * from fillers)) where rank <= 100",
    },
)
def sta_11_fidelity(spark, sf):
    """Two ways to the same top 100: padded search, and a window over the dense scores."""
    i, asked = _index(spark, sf), V.asked(spark, sf)
    one = R.bm25_search(i, asked, params.POOL_K).select("query_idx", "doc_idx", "rank")
    dense = R.ranked(R.hybrid_scores(i, asked), F.col("bm25"), "doc_idx", params.POOL_K).select("query_idx", "doc_idx", "rank")
    return one.exceptAll(dense).unionAll(dense.exceptAll(one)).agg(F.count(F.lit(1)).alias("differing"))


@query("select query_idx, " + ", ".join(f"printf('%.10f', round(max(ndcg) filter (arm = '{a}'), 6)) as \"{a}\"" for a in ("B0", "M", "U", "V")) + " from metrics group by 1", "pool", "judged", "ideal", extra=_COMPOSED_EXTRA)
def snk_02_per_query_table(spark, sf):
    from ..sources.sinks import per_query_table

    return per_query_table(_composed_metrics(spark, sf).withColumn("ndcg", F.round("ndcg", 6)), ["B0", "M", "U", "V"])


@query("select 'q' || query_idx || ' Q0 d' || doc_idx || ' ' || rank || ' ' || (101 - rank) || ' bm25' as line from bm25_top", "bm25_top")
def snk_03_run_lines(spark, sf):
    from ..sources.sinks import run_lines

    top = R.bm25_search(_index(spark, sf), V.asked(spark, sf), params.POOL_K)
    rows = top.select(F.lit("bm25").alias("arm"), F.concat(F.lit("q"), "query_idx").alias("qid"), F.concat(F.lit("d"), "doc_idx").alias("id"), "rank")
    return run_lines(rows).select(F.col("value").alias("line"))


def learned_scores(spark, sf) -> DataFrame:
    """The pools with held-out scores of the pairwise ranker, five folds and all penalties."""
    from ..operators import ranker

    rows = cut(P.normalised(_modules(spark, sf)))
    items = cut(rows.select("query_idx", "doc_idx", "pool_rank", "grade", P.features(rows).alias("features")))
    scored, _ = ranker.cross_fit(items, V.judged(spark, sf))
    return scored.withColumn("score", F.round("score", 9))


@query()
def arm_34_learned_ranker(spark, sf):
    return learned_scores(spark, sf).select("query_idx", "doc_idx", r6("score").alias("score"))
