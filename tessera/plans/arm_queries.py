"""Arms on the BM25 pool, random orders and controls, and the analysis over them, as queries.

Random numbers come from md5 of a seed and the ids, so that both engines draw the same.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import scores as S
from ..functions import text as T
from ..operators import metrics as M
from ..operators import pool as P
from ..operators import search as R
from ..operators import stats as ST
from ..operators.stages import cut
from . import ranking_queries as Q
from . import views as V
from .registry import query, r6

SEEDS = 5

V.CTES["bpool0"] = (
    ["bm25_top", "hybrid", "factors", "asked"],
    V.CTES["pool0"][1].replace("from hybrid_top h", "from (select b.query_idx, b.doc_idx, b.bm25, x.z, x.cosine, x.hybrid, b.rank from bm25_top b join hybrid x using (query_idx, doc_idx)) h"),
)
V.CTES["bpool"] = (["bpool0", "judged"], V.CTES["pool"][1].replace("from pool0 p", "from bpool0 p"))


def _drawn_sql(seed: str, *parts: str) -> str:
    return Q._DRAWN.format(text=f"'{seed}|' || " + " || '|' || ".join(parts))


def _bm25_pool(spark, sf) -> DataFrame:
    """The best 100 by BM25 with every factor and grade."""
    docs, asked = V.documents(spark, sf), V.asked(spark, sf)
    top = R.bm25_search(Q._index(spark, sf), asked, params.POOL_K)
    rows = R.relevance_factors(top.withColumn("cosine", F.lit(0.0)), docs, asked, Q.as_of())
    rows = rows.join(V.judged(spark, sf), ["query_idx", "doc_idx"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    return cut(rows.withColumnRenamed("rank", "pool_rank"))


def _on(pool: str, name: str, score: str) -> str:
    return Q._ranked_sql(name, score).replace("from pool", f"from {pool}")


# -- mean NDCG over random orders ----------------------------------------------------------------


def _random_sql(pool: str, seed: str, score: str = "0") -> str:
    order = f"round({score}, 9) desc, {_drawn_sql(seed, 'draw', 'query_idx', 'doc_idx')}, doc_idx"
    return f"""select query_idx, round(avg(ndcg), 6) as ndcg from (
      select draw, query_idx, case when coalesce(any_value(idcg), 0) > 0 then sum(case when rank <= 10 then grade / log2(rank + 1) else 0.0 end) / any_value(idcg) else 0.0 end as ndcg
      from (select draw, query_idx, grade, row_number() over (partition by draw, query_idx order by {order}) as rank from {pool} cross join range({params.RANDOM_ORDERS}) r(draw))
      left join ideal using (query_idx) group by draw, query_idx) group by query_idx"""


def _random_orders(pool: DataFrame, qrels: DataFrame, seed: str, score=None) -> DataFrame:
    """Mean NDCG of each query over random orders, ``score`` first and the draw for its ties."""
    orders = P.shuffled(pool, params.RANDOM_ORDERS, seed, score).where(F.col("rank") <= params.CUTOFF)
    rows = orders.join(pool.select("query_idx", "doc_idx", "grade"), ["query_idx", "doc_idx"])
    dcg = rows.groupBy("draw", "query_idx").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = M.ideal_dcg(qrels)
    ndcg = F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0))
    return dcg.join(ideal, "query_idx", "left").groupBy("query_idx").agg(r6(F.avg(ndcg)).alias("ndcg"))


@query(_random_sql("pool", "r"), "pool", "ideal")
def arm_08_random_rerank(spark, sf):
    """Mean NDCG of 200 md5-drawn orders of every pool."""
    return _random_orders(Q._pool(spark, sf), V.judged(spark, sf), "r")


@query(_random_sql("pool", "t", Q._composite_sql(topic="0.0")), "pool", "ideal")
def arm_09_topic_off_random_ties(spark, sf):
    pool = Q._pool(spark, sf)
    score = S.composite(F.col("cosine"), F.col("apply"), F.col("action"), F.col("tau"), F.col("evidence"), S.weights_without("topic"))
    return _random_orders(pool, V.judged(spark, sf), "t", score)


@query(_random_sql("bpool", "r"), "bpool", "ideal")
def arm_22_bm25_pool_random(spark, sf):
    return _random_orders(_bm25_pool(spark, sf), V.judged(spark, sf), "r")


_ORACLE_SQL = "evidence * (0.5 * grade / 2 + 0.3 * apply + 0.2 * action)"


def _oracle(use_evidence: bool = True, use_action: bool = True):
    inner = 0.5 * F.col("grade") / 2 + 0.3 * F.col("apply") + (0.2 * F.col("action") if use_action else F.lit(0.0))
    return F.col("evidence") * inner if use_evidence else inner


@query(_random_sql("bpool", "o", _ORACLE_SQL), "bpool", "ideal")
def arm_24_oracle_random_ties(spark, sf):
    return _random_orders(_bm25_pool(spark, sf), V.judged(spark, sf), "o", _oracle())


# -- orders of the pools --------------------------------------------------------------------------

_BPOOL_ARMS = {"bm25_pool_by_bm25": "bm25", "composite": Q._composite_sql(), "composite_oracle": _ORACLE_SQL, "oracle_ceiling": "grade"}


@query("select arm, query_idx, doc_idx, cast(rank as int) as rank from (" + " union all ".join(_on("bpool", n, s) for n, s in _BPOOL_ARMS.items()) + ")", "bpool")
def arm_22_to_24_bm25_pool(spark, sf):
    pool = _bm25_pool(spark, sf)
    arms = [P.arm(pool, "bm25_pool_by_bm25", F.col("bm25")), Q._reranked("composite", pool), P.arm(pool, "composite_oracle", _oracle()), P.arm(pool, "oracle_ceiling", F.col("grade"))]
    return reduce(DataFrame.unionByName, arms)


_VARIANTS = {"oracle_topic_in_r": _ORACLE_SQL, "evidence_off": "0.5 * grade / 2 + 0.3 * apply + 0.2 * action", "evidence_action_off": "0.5 * grade / 2 + 0.3 * apply"}


@query("select arm, query_idx, doc_idx, cast(rank as int) as rank from (" + " union all ".join(Q._ranked_sql(n, s) for n, s in _VARIANTS.items()) + ")", "pool")
def arm_19_oracle_variants(spark, sf):
    pool = Q._pool(spark, sf)
    scores = dict(zip(_VARIANTS, (_oracle(), _oracle(False), _oracle(False, False)), strict=True))
    return reduce(DataFrame.unionByName, [P.arm(pool, n, s) for n, s in scores.items()])


@query(
    "select query_idx, doc_idx, cast(rank as int) as rank from (select query_idx, doc_idx, row_number() over (partition by query_idx order by round(coalesce(" + V._DOT.format(a="d.embedding", b="q.embedding") + ", 0), 9) desc, doc_idx) as rank from docs d cross join asked q) where rank <= 100",
    "docs", "asked",
)
def arm_21_full_corpus_dot(spark, sf):
    return R.vector_search(Q._index(spark, sf).rows, V.asked(spark, sf), unit=False).select("query_idx", "doc_idx", "rank")


@query("select a.query_idx, coalesce(n, 0) as matched, round(coalesce(k, 0) / 100.0, 6) as overlap from asked a left join (select query_idx, count(*) as n from bm25 where bm25 > 0 group by 1) m using (query_idx) left join (select query_idx, count(*) as k from bm25_top join hybrid_top using (query_idx, doc_idx) group by 1) o using (query_idx)", "asked", "bm25", "bm25_top", "hybrid_top")
def arm_18_matches_and_overlap(spark, sf):
    i, asked = Q._index(spark, sf), V.asked(spark, sf)
    matched = R.bm25_scores(i, asked).where("bm25 > 0").groupBy("query_idx").agg(F.count(F.lit(1)).alias("n"))
    both = R.bm25_search(i, asked, params.POOL_K).select("query_idx", "doc_idx").join(R.hybrid_search(i, asked).select("query_idx", "doc_idx"), ["query_idx", "doc_idx"])
    both = both.groupBy("query_idx").agg(F.count(F.lit(1)).alias("k"))
    rows = asked.select("query_idx").join(matched, "query_idx", "left").join(both, "query_idx", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("query_idx", zero("n").alias("matched"), r6(zero("k") / F.lit(float(params.POOL_K))).alias("overlap"))


# -- random embeddings through the whole pipeline ---------------------------------------------------

NOISE_SIZE = 64


def _gaussians_sql(seed: str, key: str) -> str:
    uniform = "cast(('0x' || substr(md5({text}), {at}, 12)) as bigint) / 281474976710656.0"
    text = f"{seed} || '|' || {key} || '|' || i"
    r, angle = f"sqrt(-2 * ln(1 - {uniform.format(text=text, at=1)}))", f"2 * pi() * {uniform.format(text=text, at=13)}"
    return f"flatten(list_transform(range({NOISE_SIZE // 2}), lambda i: [{r} * cos({angle}), {r} * sin({angle})]))"


_RANDOM_EXTRA = {
    "noise_d": f"select seed, doc_idx, {_gaussians_sql(chr(39) + 'd' + chr(39) + ' || seed', 'doc_idx')} as v from docs cross join range({SEEDS}) r(seed)",
    "noise_q": f"select seed, query_idx, {_gaussians_sql(chr(39) + 'q' + chr(39) + ' || seed', 'query_idx')} as v from asked cross join range({SEEDS}) r(seed)",
    "random_all": f"select d.seed, h.query_idx, h.doc_idx, h.z, {V.cosine_sql('d.v', 'q.v')} as cosine from hybrid0 h join noise_d d on d.doc_idx = h.doc_idx join noise_q q on q.query_idx = h.query_idx and q.seed = d.seed",
    "random_pool": "select * from (select *, row_number() over (partition by seed, query_idx order by round(0.4 * z + 0.6 * cosine, 9) desc, doc_idx) as pool_rank from random_all) where pool_rank <= 100",
    "random_factors": f"select p.*, action, {V._WEIGHT_SQL} as evidence from random_pool p join (select doc_idx, action, {V._LEVEL_SQL} as evidence_level from docs) using (doc_idx)",
    "arms": "select 'random_embedding_seed' || seed as arm, query_idx, doc_idx, row_number() over (partition by seed, query_idx order by round(evidence * (0.5 * cosine + 0.3 * 0.5 + 0.2 * action), 9) desc, pool_rank) as rank from random_factors",
    "metrics": Q._METRICS_SQL,
}


@query("select arm, query_idx, round(ndcg, 6) as ndcg from metrics", "hybrid0", "docs", "asked", "judged", "ideal", extra=_RANDOM_EXTRA)
def arm_15_random_embeddings(spark, sf):
    """NDCG of the whole pipeline (hybrid pool, composite rerank) with noise for embeddings, SEEDS times.

    All seeds share one scan of the index and one BM25.  As in the control they mimic, documents are as
    new as can be (no decay), have no population, and evidence by their keywords.
    """
    index, asked = Q._index(spark, sf), V.asked(spark, sf).select("query_idx", "text")
    names = tuple(f"noise_{s}" for s in range(SEEDS))
    noisy = lambda kind, key: {n: P.gaussians(f"{kind}{s}", F.col(key), NOISE_SIZE) for s, n in enumerate(names)}
    noisy_index = replace(index, rows=index.rows.withColumns(noisy("d", "doc_idx")))
    pool = R.hybrid_searches(noisy_index, asked.withColumns(noisy("q", "query_idx")), names).withColumnRenamed("rank", "pool_rank")
    title, abstract = F.col("title"), F.col("abstract")
    factors = V.documents(spark, sf).select("doc_idx", T.actionability(title, abstract).alias("action"), T.evidence_weight(T.evidence_level(title, abstract)).alias("evidence"))
    rows = pool.join(factors, "doc_idx")
    score = S.composite(F.col("cosine"), F.lit(params.UNKNOWN_APPLICABILITY), F.col("action"), F.lit(1.0), F.col("evidence"))
    order = Window.partitionBy("seed", "query_idx").orderBy(F.round(score, 9).desc(), "pool_rank")
    arms = rows.select(F.concat(F.lit("random_embedding_seed"), F.col("seed").cast("string")).alias("arm"), "query_idx", "doc_idx", F.row_number().over(order).alias("rank"))
    return M.per_query(arms, V.judged(spark, sf)).select("arm", "query_idx", r6("ndcg").alias("ndcg"))


# -- strata by matches ----------------------------------------------------------------------------

_COS_TOP = "select query_idx, doc_idx, row_number() over (partition by query_idx order by round(cosine, 9) desc, doc_idx) as rank from hybrid"
_STRATUM = "case when coalesce(n, 0) < 10 then 'lt10' when n < 100 then '10to99' else 'ge100' end"


@query(
    f"""select {_STRATUM} as stratum, count(*) as n_queries, round(avg(b.ndcg), 6) as bm25, round(avg(c.ndcg), 6) as cosine, round(avg(c.ndcg - b.ndcg), 6) as diff
  from asked a left join (select query_idx, count(*) as n from bm25 where bm25 > 0 group by 1) m using (query_idx)
  join metrics b on b.query_idx = a.query_idx and b.arm = 'bm25' join metrics c on c.query_idx = a.query_idx and c.arm = 'cosine' group by 1""",
    "asked", "bm25", "bm25_top", "hybrid", "judged", "ideal",
    extra={"arms": f"select 'bm25' as arm, query_idx, doc_idx, rank from bm25_top union all select 'cosine', query_idx, doc_idx, rank from ({_COS_TOP}) where rank <= 100", "metrics": Q._METRICS_SQL},
)
def arm_36_strata(spark, sf):
    i, asked, qrels = Q._index(spark, sf), V.asked(spark, sf), V.judged(spark, sf)
    matched = R.bm25_scores(i, asked).where("bm25 > 0").groupBy("query_idx").agg(F.count(F.lit(1)).alias("n"))
    one = R.bm25_search(i, asked, params.POOL_K).select(F.lit("bm25").alias("arm"), "query_idx", "doc_idx", "rank")
    other = R.vector_search(i.rows, asked).select(F.lit("cosine").alias("arm"), "query_idx", "doc_idx", "rank")
    ndcg = M.per_query(one.unionByName(other), qrels).groupBy("query_idx").pivot("arm", ["bm25", "cosine"]).agg(F.first("ndcg"))
    n = F.coalesce("n", F.lit(0))
    rows = asked.select("query_idx").join(matched, "query_idx", "left").join(ndcg, "query_idx")
    stratum = F.when(n < 10, "lt10").when(n < 100, "10to99").otherwise("ge100")
    return rows.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n_queries"), r6(F.avg("bm25")).alias("bm25"), r6(F.avg("cosine")).alias("cosine"), r6(F.avg(F.col("cosine") - F.col("bm25"))).alias("diff"))


# -- version 0.1, noise modules, positive control, and the analysis --------------------------------

_F_SQL = f"coalesce(exp(-0.12 * greatest(floor((epoch_us(timestamp '{V.AS_OF}') - epoch_us(p.publication_date)) / 86400000000.0), 0) / 365.25), 1.0) * ({V._WEIGHT_SQL.replace('evidence_level', 'level')}) * (0.5 * cosine + 0.3 * 0.5 + 0.2 * p.action)"
_F_ROWS = f"select p.query_idx, p.doc_idx, p.pool_rank, {_F_SQL} as f from (select x.*, {V._LEVEL_SQL} as level from pool x join docs1 using (doc_idx)) p"
_F_ARM = f"select 'F' as arm, query_idx, doc_idx, row_number() over (partition by query_idx order by round(f, 9) desc, pool_rank) as rank from ({_F_ROWS})"


def _version_01(spark, sf, pool: DataFrame) -> DataFrame:
    """The ungated composite with evidence from keywords, no population, and no decay without a date."""
    given = V.documents(spark, sf).select("doc_idx", "publication_date", T.evidence_level(F.col("title"), F.col("abstract")).alias("level"))
    rows = pool.select("query_idx", "doc_idx", "pool_rank", "cosine", "action").join(given, "doc_idx")
    tau = F.coalesce(S.temporal_decay(F.col("publication_date"), Q.as_of(), F.lit("pbm")), F.lit(1.0))
    return P.arm(rows, "F", tau * T.evidence_weight(F.col("level")) * (0.5 * F.col("cosine") + 0.3 * 0.5 + 0.2 * F.col("action")))


@query(f"select arm, query_idx, doc_idx, cast(rank as int) as rank from ({_F_ARM})", "pool", "docs1")
def arm_30_version_01(spark, sf):
    return _version_01(spark, sf, Q._pool(spark, sf))


_NOISY = [m for m in params.MODULES if m != "bm25"]
_NOISE_SQL = "select seed, query_idx, doc_idx, pool_rank, question_type, z_bm25, " + ", ".join(f"({_drawn_sql('n' + m, 'seed', 'query_idx', 'doc_idx')}) as u_{m}" for m in _NOISY) + f" from zs cross join range({SEEDS}) r(seed)"
_Z_OF = "case when max({x}) over w > min({x}) over w then ({x} - avg({x}) over w) / stddev_pop({x}) over w else 0.0 end"
_NOISE_Z = "select seed, query_idx, doc_idx, pool_rank, question_type, z_bm25, " + ", ".join(f"{_Z_OF.format(x='u_' + m)} as z_{m}" for m in _NOISY) + " from noise window w as (partition by seed, query_idx)"
_HALF = "(select case when max(grade) > min(grade) then (max(grade) - min(grade)) / 2 else 1.0 end from judged)"
_SYNTH = f"select *, grade + {_HALF} * sqrt(12.0) * ({_drawn_sql('p', 'seed', 'query_idx', 'doc_idx')} - 0.5) as raw from zs cross join range({SEEDS}) r(seed)"
_GATED = Q._gated_sql(Q._GATE_SQL)
_SEEDED_EXTRA = Q._POOL_EXTRA | {
    "noise": _NOISE_SQL, "noise_z": _NOISE_Z, "synth": _SYNTH, "synth_z": f"select *, {_Z_OF.format(x='raw')} as extra from synth window w as (partition by seed, query_idx)",
    "seeded": f"""select 'N' || seed as arm, query_idx, doc_idx, row_number() over (partition by seed, query_idx order by round({_GATED}, 9) desc, pool_rank) as rank from noise_z
      union all select 'P' || seed, query_idx, doc_idx, row_number() over (partition by seed, query_idx order by round({_GATED} + extra, 9) desc, pool_rank) from synth_z""",
}


def _seeded(spark, rows: DataFrame, qrels: DataFrame) -> DataFrame:
    """Arms N (noise in place of every module but BM25) and P (gated sum plus a noisy true grade), SEEDS of each."""
    seeds = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    window = Window.partitionBy("seed", "query_idx")
    draw = lambda name: P.drawn(name, F.col("seed"), F.col("query_idx"), F.col("doc_idx"))
    spread = F.max("grade") - F.min("grade")
    half = qrels.agg(F.when(spread > 0, spread / 2).otherwise(F.lit(1.0)).alias("half"))
    seeds = seeds.crossJoin(F.broadcast(half)).join(F.broadcast(P.gate_table(spark)), "question_type")
    seeds = seeds.withColumns({"raw": F.col("grade") + F.col("half") * F.sqrt(F.lit(12.0)) * (draw("p") - 0.5), **{f"u_{m}": draw("n" + m) for m in _NOISY}})
    seeds = seeds.withColumns({"extra": P.z(F.col("raw"), window), "true": P.gated(seeds, None)}).withColumns({f"z_{m}": P.z(F.col(f"u_{m}"), window) for m in _NOISY})
    place = lambda score: F.row_number().over(window.orderBy(F.round(score, 9).desc(), "pool_rank"))
    noise = seeds.select(F.concat(F.lit("N"), "seed").alias("arm"), "query_idx", "doc_idx", place(P.gated(seeds, None)).alias("rank"))
    return noise.unionByName(seeds.select(F.concat(F.lit("P"), "seed").alias("arm"), "query_idx", "doc_idx", place(F.col("true") + F.col("extra")).alias("rank")))


@query("select arm, query_idx, doc_idx, cast(rank as int) as rank from seeded where rank <= 10", "pool", "judged", extra=_SEEDED_EXTRA)
def arm_31_33_noise_and_positive(spark, sf):
    return _seeded(spark, cut(P.normalised(Q._modules(spark, sf))), V.judged(spark, sf)).where("rank <= 10")


_ALL_EXTRA = _SEEDED_EXTRA | {"arms": f"select arm, query_idx, doc_idx, rank from ({Q._COMPOSED_SQL}) union all select * from seeded union all {_F_ARM}", "metrics": Q._METRICS_SQL}
_BARS = "select case when length(arm) = 2 and arm <> 'B0' then left(arm, 1) || 'bar' else arm end as arm, query_idx, avg(ndcg) as ndcg from metrics group by all"


def _bars(spark, sf) -> DataFrame:
    """(arm, query_idx, ndcg) of all arms; those of several seeds as their mean, N, R and P with 'bar'."""
    qrels = cut(V.judged(spark, sf))
    rows = cut(P.normalised(Q._modules(spark, sf)))
    arms = Q._composed_arms(spark, rows).unionByName(_seeded(spark, rows, qrels)).unionByName(_version_01(spark, sf, Q._pool(spark, sf)))
    metrics = M.per_query(cut(arms), qrels)
    name = F.when(F.col("arm").rlike("^[NRP][0-9]$"), F.concat(F.substring("arm", 1, 1), F.lit("bar"))).otherwise(F.col("arm"))
    return cut(metrics.groupBy(name.alias("arm"), "query_idx").agg(F.avg("ndcg").alias("ndcg")))


@query(f"select arm, query_idx, round(ndcg, 6) as ndcg from ({_BARS}) where arm in ('Nbar', 'Rbar', 'Pbar')", "pool", "judged", "ideal", "docs1", extra=_ALL_EXTRA)
def agg_19_seed_means(spark, sf):
    return _bars(spark, sf).where("arm in ('Nbar', 'Rbar', 'Pbar')").select("arm", "query_idx", r6("ndcg").alias("ndcg"))


_COMPARISONS = {"M-B0": ("M", "B0"), "M-F": ("M", "F"), "M-U": ("M", "U"), "M-V": ("M", "V"), "M-Rbar": ("M", "Rbar"), "Nbar-B0": ("Nbar", "B0"), "Pbar-M": ("Pbar", "M")}


@query(
    f"""select name, count(*) as n, round(avg(d), 6) as mean, round(coalesce(stddev_samp(d), 0), 6) as sd, count(*) filter (d > 0) as wins, count(*) filter (d < 0) as losses, count(*) filter (d = 0) as ties
  from (select name, round(a.ndcg - b.ndcg, 9) as d from (values {', '.join(f"('{n}', '{x}', '{y}')" for n, (x, y) in _COMPARISONS.items())}) c(name, one, other)
  join bars a on a.arm = one join bars b on b.arm = other and b.query_idx = a.query_idx) group by 1""",
    "pool", "judged", "ideal", "docs1", extra=_ALL_EXTRA | {"bars": _BARS},
)
def sta_09_comparisons(spark, sf):
    """The paired comparisons of the analysis, as far as they need no draws."""
    return ST.paired(_compared(_bars(spark, sf)), ["name"]).select("name", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), "wins", "losses", "ties")


def _compared(bars: DataFrame) -> DataFrame:
    """(name, query_idx, diff) of every comparison."""
    return reduce(DataFrame.unionByName, [ST.differences(bars, x, y).select(F.lit(n).alias("name"), "query_idx", F.round("diff", 9).alias("diff")) for n, (x, y) in _COMPARISONS.items()])


# The statistics of all comparisons but the one with the learned arm, whose scores SQL cannot fit.
_STATS_EXTRA = _ALL_EXTRA | {
    "bars": _BARS,
    "compared": f"select name, a.query_idx, round(a.ndcg - b.ndcg, 9) as diff from (values {', '.join(f"('{n}', '{x}', '{y}')" for n, (x, y) in _COMPARISONS.items())}) c(name, one, other) join bars a on a.arm = one join bars b on b.arm = other and b.query_idx = a.query_idx",
    "placed": "select *, dense_rank() over (order by query_idx) - 1 as place from compared",
    "places": "select place, count(*) over () as n from (select distinct place from placed)",
    "resamples": f"select draw, cast(floor({_drawn_sql('b', 'draw', 'place')} * n) as bigint) as place from places cross join range({params.BOOTSTRAP_DRAWS}) r(draw)",
    "boot": "select name, draw, avg(diff) as mean from resamples join placed using (place) group by name, draw",
    "ci": "select name, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from boot group by name",
    "signs": f"select draw, query_idx, case when {_drawn_sql('s', 'draw', 'query_idx')} < 0.5 then -1.0 else 1.0 end as sign from (select distinct query_idx from compared) cross join range({params.SIGN_FLIPS}) r(draw)",
    "nulls": "select name, draw, abs(avg(diff * sign)) as m from signs join compared using (query_idx) group by name, draw",
    "seen": "select name, avg(diff) as mean from compared group by name",
    "tests": f"select name, (1 + count(*) filter (m >= abs(mean) - 1e-12)) / {params.SIGN_FLIPS + 1}.0 as p from nulls join seen using (name) group by name",
    "holms": "select name, least(1.0, max((m - rn + 1) * p) over (order by p, name rows unbounded preceding)) as p_holm from (select name, p, count(*) over () as m, row_number() over (order by p, name) as rn from tests where name in ('M-F', 'M-U', 'M-V', 'M-Rbar'))",
    "stats": "select s.name, mean, lo, hi, p, p_holm from seen s join ci using (name) join tests using (name) left join holms using (name)",
}
_STATS_NEEDS = ("pool", "judged", "ideal", "docs1")


def _statistics(spark, sf) -> DataFrame:
    return cut(ST.statistics(cut(_compared(_bars(spark, sf)))))


@query("select name, round(p, 6) as p, round(p_holm, 6) as p_holm from stats where p_holm is not null", *_STATS_NEEDS, extra=_STATS_EXTRA)
def sta_03_holm(spark, sf):
    return _statistics(spark, sf).where("p_holm is not null").select("name", r6("p").alias("p"), r6("p_holm").alias("p_holm"))


@query("select name, round(lo, 6) as lo, round(hi, 6) as hi, case when lo > -0.03 and hi < 0.03 then 'equivalent' when lo > 0 then 'better' when hi < 0 then 'worse' else 'inconclusive' end as verdict from stats", *_STATS_NEEDS, extra=_STATS_EXTRA)
def sta_04_equivalence(spark, sf):
    return _statistics(spark, sf).select("name", r6("lo").alias("lo"), r6("hi").alias("hi"), ST.equivalence(F.col("lo"), F.col("hi")).alias("verdict"))


@query("select round(median(ratio), 4) as median_sd_ratio, round(any_value(overlap), 6) as mean_overlap, case when median(ratio) > 3 and any_value(overlap) >= 0.7 then 'contradicted' when median(ratio) < 1.5 then 'supported' else 'mixed' end as verdict from (select stddev_pop(0.4 * z) / stddev_pop(0.6 * cosine) as ratio from hybrid group by query_idx having stddev_pop(cosine) > 1e-12), (select avg(coalesce(k, 0) / 100.0) as overlap from asked left join (select query_idx, count(*) as k from bm25_top join hybrid_top using (query_idx, doc_idx) group by 1) using (query_idx))", "hybrid", "asked", "bm25_top", "hybrid_top")
def sta_05_pool_verdict(spark, sf):
    """Whether BM25 dominates the pool, from the spreads of the two parts of the score and the overlap with BM25's own pool."""
    i, asked = Q._index(spark, sf), V.asked(spark, sf)
    spreads = R.hybrid_scores(i, asked).groupBy("query_idx").agg(F.stddev_pop(0.4 * F.col("z")).alias("a"), F.stddev_pop(0.6 * F.col("cosine")).alias("b")).where("b > 0.6e-12")
    both = R.bm25_search(i, asked, params.POOL_K).select("query_idx", "doc_idx").join(R.hybrid_search(i, asked).select("query_idx", "doc_idx"), ["query_idx", "doc_idx"]).groupBy("query_idx").agg(F.count(F.lit(1)).alias("k"))
    overlap = asked.select("query_idx").join(both, "query_idx", "left").agg(F.avg(F.coalesce("k", F.lit(0)) / F.lit(float(params.POOL_K))).alias("overlap"))
    row = spreads.agg(F.percentile(F.col("a") / F.col("b"), 0.5).alias("ratio")).crossJoin(F.broadcast(overlap))
    return row.select(F.round("ratio", 4).alias("median_sd_ratio"), r6("overlap").alias("mean_overlap"), ST.pool_verdict(F.col("ratio"), F.col("overlap")).alias("verdict"))


_MEAN_OF = "(select avg(ndcg) from metrics where arm = '{}')"


@query(
    f"select round(g, 6) as gain, round(a, 6) as artefact, case when g <= 0 then 'nothing to explain' when a >= 0.5 * g then 'artefact' when a < 0.25 * g then 'not an artefact' else 'partial' end as verdict from (select {_MEAN_OF.format('abl_topic_off')} - {_MEAN_OF.format('full_clinical')} as g, {_MEAN_OF.format('abl_topic_off')} - (select avg(ndcg) from random_ties) as a)",
    *Q._NEEDS, extra=Q._EXTRA | {"random_ties": _random_sql("pool", "t", Q._composite_sql(topic="0.0"))},
)
def sta_06_tie_verdict(spark, sf):
    """Whether the gain without topic comes from the order in which ties stand."""
    means = Q._metrics(spark, sf).groupBy().pivot("arm", ["abl_topic_off", "full_clinical"]).agg(F.avg("ndcg"))
    ties = arm_09_topic_off_random_ties(spark, sf).agg(F.avg("ndcg").alias("ties"))
    g, a = F.col("abl_topic_off") - F.col("full_clinical"), F.col("abl_topic_off") - F.col("ties")
    return means.crossJoin(F.broadcast(ties)).select(r6(g).alias("gain"), r6(a).alias("artefact"), ST.tie_verdict(g, a).alias("verdict"))


_ENCODER_EXTRA = Q._EXTRA | {
    "random_orders": _random_sql("pool", "r"),
    "placed": "select query_idx, round(m.ndcg - r.ndcg, 9) as diff, row_number() over (order by query_idx) - 1 as place, count(*) over () as n from metrics m join random_orders r using (query_idx) where m.arm = 'cos_only_rerank'",
    "boot": f"select draw, avg(diff) as mean from (select draw, cast(floor({_drawn_sql('b', 'draw', 'place')} * n) as bigint) as place from placed cross join range({params.BOOTSTRAP_DRAWS}) r(draw)) join placed using (place) group by draw",
}


@query("select round(lo, 6) as lo, round(hi, 6) as hi, case when hi < 0 then 'harmful' when lo > 0 then 'informative' else 'no detectable information' end as verdict from (select quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from boot)", *Q._NEEDS, extra=_ENCODER_EXTRA)
def sta_07_encoder(spark, sf):
    """Whether reranking the pool by cosine alone tells more than a random order does."""
    cosine = Q._metrics(spark, sf).where("arm = 'cos_only_rerank'").select("query_idx", F.col("ndcg").alias("x"))
    rows = cosine.join(arm_08_random_rerank(spark, sf), "query_idx").select("query_idx", F.round(F.col("x") - F.col("ndcg"), 9).alias("diff"))
    ci = ST.intervals(cut(rows), ["diff"], params.BOOTSTRAP_DRAWS)
    return ci.select(r6("lo").alias("lo"), r6("hi").alias("hi"), ST.encoder_verdict(F.col("lo"), F.col("hi")).alias("verdict"))


_SENSITIVE_EXTRA = {k: v for k, v in _RANDOM_EXTRA.items() if k not in ("arms", "metrics")} | {
    "arms": _RANDOM_EXTRA["arms"] + " union all " + Q._ranked_sql("full_clinical", Q._composite_sql()),
    "metrics": Q._METRICS_SQL,
    "seeds": "select arm, avg(ndcg) - (select avg(ndcg) from metrics where arm = 'full_clinical') as d from metrics where arm <> 'full_clinical' group by arm",
}


@query("select round(avg(d), 6) as mean_minus_full, round(max(abs(d)), 6) as worst_seed, case when abs(avg(d)) > 0.03 or max(abs(d)) > 0.04 then 'sensitive' else 'not sensitive' end as verdict from seeds", "hybrid0", "docs", "asked", "pool", "judged", "ideal", extra=_SENSITIVE_EXTRA)
def sta_07_sensitivity(spark, sf):
    """Whether the pipeline's quality depends on its embeddings, from those with noise in their place."""
    full = M.per_query(Q._reranked("full", Q._pool(spark, sf)), V.judged(spark, sf)).agg(F.avg("ndcg").alias("full"))
    seeds = arm_15_random_embeddings(spark, sf).groupBy("arm").agg(F.avg("ndcg").alias("m")).crossJoin(F.broadcast(full)).select((F.col("m") - F.col("full")).alias("d"))
    row = seeds.agg(F.avg("d").alias("mean"), F.max(F.abs(F.col("d"))).alias("worst"))
    return row.select(F.round("mean", 6).alias("mean_minus_full"), F.round("worst", 6).alias("worst_seed"), ST.sensitivity(F.col("mean"), F.col("worst")).alias("verdict"))


def _rho_sql(y: str) -> str:
    ranked = Q._RANKED.format(x=Q._composite_sql(), y=y)
    return f"select query_idx, case when max(rx) > min(rx) and max(ry) > min(ry) then corr(rx, ry) end as rho from ({ranked}) group by 1"


@query(f"select round(e, 6) as rho_evidence, round(c, 6) as rho_cosine, case when e > c + 0.2 then 'evidence weight dominates' else 'evidence weight does not dominate' end as verdict from (select median(rho) as e from ({_rho_sql('evidence')})), (select median(rho) as c from ({_rho_sql('cosine')}))", "pool")
def sta_07_driver(spark, sf):
    """Which factor orders the composite within the pools: medians of rank correlations."""
    score = S.composite(F.col("cosine"), F.col("apply"), F.col("action"), F.col("tau"), F.col("evidence"))
    rows = cut(Q._pool(spark, sf).select("query_idx", F.round(score, 9).alias("score"), F.round("evidence", 9).alias("e"), F.round("cosine", 9).alias("c")))
    e, c = (ST.spearman(rows, "score", x).agg(F.percentile("rho", 0.5).alias(x)) for x in ("e", "c"))
    return e.crossJoin(F.broadcast(c)).select(r6("e").alias("rho_evidence"), r6("c").alias("rho_cosine"), ST.driver_verdict(F.col("e"), F.col("c")).alias("verdict"))


@query(f"select round(d, 6) as difference, abs(d) <= 0.01 as within from (select {_MEAN_OF.format('bm25_rerank_of_pool')} - {_MEAN_OF.format('bm25')} as d)", *Q._NEEDS, extra=Q._EXTRA)
def sta_07_control(spark, sf):
    """The positive control: the pool reranked by BM25 must come close to BM25."""
    means = Q._metrics(spark, sf).groupBy().pivot("arm", ["bm25_rerank_of_pool", "bm25"]).agg(F.avg("ndcg"))
    d = F.col("bm25_rerank_of_pool") - F.col("bm25")
    return means.select(r6(d).alias("difference"), ST.control_ok(d).alias("within"))


def _manipulated(spark, sf) -> DataFrame:
    same = ST.same_lists(Q._composed(spark, sf), "M", "U").where("query_idx % 4 = 1")
    return same.agg(F.coalesce(F.avg((~F.col("same")).cast("int")) >= params.MANIPULATION_SHARE, F.lit(False)).alias("manipulated"))


_OF = "(select {what} from stats where name = '{name}')"
_S = lambda name, what: _OF.format(name=name, what=what)
_GAIN = f"{_S('M-B0', 'mean')} >= 0.05 and {_S('M-B0', 'lo')} > 0"
_SIG = {k: f"({_S(f'M-{k}', 'p_holm')} < 0.05 and {_S(f'M-{k}', 'mean')} > 0)" for k in ("F", "U", "V", "Rbar")}
_DECISION = f"""case when {_S('Pbar-M', 'lo')} <= 0 then 'Test failed' when {_S('M-B0', 'hi')} < 0.05 then 'Refuted' when not manipulated then 'Untestable'
  when {_GAIN} and {_SIG['F']} and {_SIG['U']} and {_SIG['V']} and {_S('Nbar-B0', 'hi')} < 0.05 then 'Supported'
  when {_GAIN} and (not {_SIG['U']} or not {_SIG['V']} or {_S('Nbar-B0', 'hi')} >= 0.05) then 'Gain without attribution' else 'Inconclusive' end"""
_SAME = "select coalesce(avg(cast(not same as int)) >= 0.5, false) as manipulated from (select list(doc_idx order by rank) filter (arm = 'M' and rank <= 10) = list(doc_idx order by rank) filter (arm = 'U' and rank <= 10) as same from composed where query_idx % 4 = 1 group by query_idx)"


@query(f"select {_DECISION} as decision, {_SIG['Rbar']} as mapping_adds, round({_S('M-B0', 'mean')}, 6) as primary_mean, round({_S('M-B0', 'lo')}, 6) as primary_lo, round({_S('M-B0', 'hi')}, 6) as primary_hi, round({_S('Pbar-M', 'lo')}, 6) as positive_lo, round({_S('Nbar-B0', 'hi')}, 6) as noise_hi, manipulated from ({_SAME})", *_STATS_NEEDS, extra=_STATS_EXTRA | {"composed": Q._COMPOSED_SQL})
def sta_08_decisions(spark, sf):
    """The decision on these tables, its family without the learned arm (with it: ``sta_09_analysis``)."""
    return ST.analysis(_statistics(spark, sf), _manipulated(spark, sf)).select("decision", "mapping_adds", "primary_mean", "primary_lo", "primary_hi", "positive_lo", "noise_hi", "manipulated")


@query()
def sta_09_analysis(spark, sf):
    """One row: the decision with all five comparisons, both qualifiers, and what it rests on.

    The learned arm is ``arm_34_learned_ranker``: its held-out scores order the pools.
    """
    bars, qrels = _bars(spark, sf), cut(V.judged(spark, sf))
    order = Window.partitionBy("query_idx").orderBy(F.desc("score"), "pool_rank")
    learned = Q.learned_scores(spark, sf).select(F.lit("L").alias("arm"), "query_idx", "doc_idx", F.row_number().over(order).alias("rank"))
    bars = cut(bars.unionByName(M.per_query(learned, qrels).select("arm", "query_idx", "ndcg")))
    compared = _compared(bars).unionByName(ST.differences(bars, "M", "L").select(F.lit("M-L").alias("name"), "query_idx", F.round("diff", 9).alias("diff")))
    return ST.analysis(cut(ST.statistics(cut(compared))), _manipulated(spark, sf))


# -- joins ----------------------------------------------------------------------------------------


@query("select p.query_idx, p.doc_idx, l.toxic is null as missing, coalesce(l.toxic, -1) as toxic from (select * from bm25_top where rank <= 10) p left join (select doc_id, max(toxic) as toxic from labels group by 1) l on l.doc_id = p.doc_idx", "bm25_top")
def jon_09_types_of_pooled(spark, sf):
    """Pooled documents with a side table by key; what the table lacks is null."""
    top = R.bm25_search(Q._index(spark, sf), V.asked(spark, sf), params.SEARCH_K).where("rank <= 10").select("query_idx", F.col("doc_idx").alias("doc_id"))
    side = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = top.join(side, "doc_id", "left")
    return rows.select("query_idx", F.col("doc_id").alias("doc_idx"), F.col("toxic").isNull().alias("missing"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("select query_idx, qid from asked where query_idx not in (select query_idx from judged where grade = 2)", "asked", "judged")
def jon_13_topics_without_judgments(spark, sf):
    """Queries that no judgment of grade 2 names; ``sources.articles.refuse_missing`` makes such an error."""
    return V.asked(spark, sf).join(V.judged(spark, sf).where("grade = 2"), "query_idx", "left_anti").select("query_idx", "qid")
