"""Scalar functions, filters and dimension tables as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import scores as S
from ..functions import text as T
from . import views as V
from .registry import long, query, r6

_TS = f"timestamp '{V.AS_OF}'"
_DAYS = f"greatest(floor((epoch_us({_TS}) - epoch_us(publication_date)) / 86400000000.0), 0)"

def as_of():
    return F.lit(V.AS_OF).cast("timestamp")


@query("select doc_idx, cast(len(tokens) as int) as n_tokens, md5(array_to_string(tokens, ' ')) as tokens_md5 from tokens", "tokens")
def scl_01_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.tokens(T.doc_text(F.col("title"), F.col("abstract")))
    return V.documents(spark, sf).select("doc_idx", tokens.alias("t")).select("doc_idx", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("select doc_idx, md5(title || ' ' || abstract) as text_md5 from docs", "docs")
def scl_02_doc_text(spark, sf):
    return V.documents(spark, sf).select("doc_idx", F.md5(T.doc_text(F.col("title"), F.col("abstract"))).alias("text_md5"))


@query(f"select doc_idx, round(exp(-rate * {_DAYS} / 365.25), 6) as tau, round(exp(-0.3 * {_DAYS} / 365.25), 6) as tau_given, round(exp(-0.0 * {_DAYS} / 365.25), 6) as tau_zero from docs", "docs")
def scl_03_temporal_decay(spark, sf):
    d, date = V.documents(spark, sf), F.col("publication_date")
    return d.select("doc_idx", r6(S.temporal_decay(date, as_of(), F.col("domain"))).alias("tau"), r6(S.temporal_decay(date, as_of(), F.col("domain"), F.lit(0.3))).alias("tau_given"), r6(S.temporal_decay(date, as_of(), F.col("domain"), F.lit(0.0))).alias("tau_zero"))


@query("select lower(domain) as domain, cast(rate as double) as rate, count(*) as documents from docs group by all", "docs")
def scl_04_decay_table(spark, sf):
    rows = V.documents(spark, sf).select(F.lower("domain").alias("domain"), S.decay_rate(F.col("domain")).alias("rate"))
    return rows.groupBy("domain", "rate").agg(F.count(F.lit(1)).alias("documents"))


@query("select doc_idx, round(ln(2) / rate, 6) as half_life from docs", "docs")
def scl_05_half_life(spark, sf):
    return V.documents(spark, sf).select("doc_idx", r6(S.half_life(F.col("domain"))).alias("half_life"))


@query("select doc_idx, round(-ln(evidence) / rate, 6) as years from factors", "factors")
def scl_06_years_until_threshold(spark, sf):
    """Years until age discounts a document as much as its evidence level does."""
    years = S.years_until(T.evidence_weight(F.col("evidence_level")), F.col("domain"))
    return V.documents(spark, sf).select("doc_idx", r6(years).alias("years"))


@query("select doc_idx, cast(evidence_level as int) as evidence_level, cast(evidence as double) as weight from factors", "factors")
def scl_07_evidence_weight(spark, sf):
    return V.documents(spark, sf).select("doc_idx", "evidence_level", T.evidence_weight(F.col("evidence_level")).alias("weight"))


@query("select doc_idx, name, cast(weight as double) as weight, cast(lo as double) as lo, cast(hi as double) as hi from factors join (values " + ", ".join(f"({x[0]}, '{x[1]}', {x[2]}, {x[3]}, {x[4]})" for x in params.EVIDENCE) + ") v(level, name, weight, lo, hi) on level = evidence_level", "factors")
def scl_08_weight_intervals(spark, sf):
    """Every document with the name, weight and interval of its evidence level."""
    levels = spark.createDataFrame([x[:5] for x in params.EVIDENCE], "evidence_level int, name string, weight double, lo double, hi double")
    return V.documents(spark, sf).select("doc_idx", "evidence_level").join(F.broadcast(levels), "evidence_level").drop("evidence_level")


@query(f"select doc_idx, cast({V._LEVEL_SQL} as int) as level from docs", "docs")
def scl_09_classify_evidence(spark, sf):
    return V.documents(spark, sf).select("doc_idx", T.evidence_level(F.col("title"), F.col("abstract")).alias("level"))


def _pairs(spark, sf):
    d = V.documents(spark, sf).where("embedding is not null").select("doc_idx", "embedding", S.norm(F.col("embedding")).alias("dn"))
    q = V.asked(spark, sf).where("embedding is not null").select("query_idx", F.col("embedding").alias("qe"), S.norm(F.col("embedding")).alias("qn"))
    return d.crossJoin(F.broadcast(q))


_PAIRS = "from docs d join asked q on d.embedding is not null and q.embedding is not null"


@query(f"select query_idx, doc_idx, round({V.cosine_sql('d.embedding', 'q.embedding')}, 6) as cosine {_PAIRS}", "docs", "asked")
def scl_10_cosine(spark, sf):
    return _pairs(spark, sf).select("query_idx", "doc_idx", r6(S.cosine(F.col("embedding"), F.col("qe"), F.col("dn"), F.col("qn"))).alias("cosine"))


@query(f"select query_idx, max(round({V.cosine_sql('d.embedding', 'q.embedding')}, 6)) as topical_max, count(*) as n {_PAIRS} group by 1", "docs", "asked")
def scl_11_topical_relevance(spark, sf):
    return _pairs(spark, sf).groupBy("query_idx").agg(F.max(r6(S.cosine(F.col("embedding"), F.col("qe")))).alias("topical_max"), F.count(F.lit(1)).alias("n"))


@query(f"select query_idx, doc_idx, round({V._DOT.format(a='d.embedding', b='q.embedding')}, 6) as dot {_PAIRS}", "docs", "asked")
def scl_12_dot_product(spark, sf):
    return _pairs(spark, sf).select("query_idx", "doc_idx", r6(S.dot(F.col("embedding"), F.col("qe"))).alias("dot"))


@query(f"select query_idx, round(sum({V.cosine_sql('d.embedding', 'q.embedding')}), 5) as cosine_sum {_PAIRS} group by 1", "docs", "asked")
def scl_13_cosine_rows(spark, sf):
    return _pairs(spark, sf).groupBy("query_idx").agg(F.round(F.sum(S.dot(F.col("embedding"), F.col("qe")) / (F.col("dn") * F.col("qn"))), 5).alias("cosine_sum"))


_LOW, _HIGH = "greatest(coalesce(d.age_min, 0.0), coalesce(q.age_min, 0.0))", "least(coalesce(d.age_max, 120.0), coalesce(q.age_max, 120.0))"
_SPAN = "(coalesce(q.age_max, 120.0) - coalesce(q.age_min, 0.0))"
_APPLY = f"case when coalesce(d.pop, 0) = 0 or coalesce(q.pop, 0) = 0 then 0.5 when {_HIGH} <= {_LOW} or {_SPAN} = 0 then 0.0 else ({_HIGH} - {_LOW}) / {_SPAN} end"


@query(f"select query_idx, doc_idx, round(cast({_APPLY} as double), 6) as applicability from docs d cross join asked q", "docs", "asked")
def scl_14_applicability(spark, sf):
    q = V.asked(spark, sf).select("query_idx", F.col("population").alias("qp"))
    return V.documents(spark, sf).select("doc_idx", "population").crossJoin(F.broadcast(q)).select("query_idx", "doc_idx", r6(S.applicability(F.col("population"), F.col("qp"))).alias("applicability"))


@query("select doc_idx, round(cast(action as double), 6) as actionability from docs", "docs")
def scl_15_actionability(spark, sf):
    return V.documents(spark, sf).select("doc_idx", r6(T.actionability(F.col("title"), F.col("abstract"))).alias("actionability"))


_R = "f.tau * f.evidence * (0.5 * " + V.cosine_sql("f.embedding", "q.embedding") + " + 0.3 * (" + _APPLY.replace("d.", "f.") + ") + 0.2 * f.action)"
_FQ = "from factors f join asked q on f.embedding is not null and q.embedding is not null and f.publication_date is not null"


def _relevance(spark, sf, **options):
    """``S.clinical_relevance`` of every pair; what a document has alone is worked out once, before it meets the queries."""
    d = V.documents(spark, sf).where("embedding is not null and publication_date is not null").select(
        "doc_idx", F.col("embedding").cast("array<double>").alias("embedding"), "population", S.norm(F.col("embedding")).alias("dn"), T.actionability(F.col("title"), F.col("abstract")).alias("action"),
        S.temporal_decay(F.col("publication_date"), as_of(), F.col("domain")).alias("tau"), T.evidence_weight(F.col("evidence_level")).alias("evidence"),
    )
    q = V.asked(spark, sf).where("embedding is not null").select("query_idx", F.col("embedding").cast("array<double>").alias("qe"), F.col("population").alias("qp"), S.norm(F.col("embedding")).alias("qn"))
    topic, apply = S.cosine(F.col("embedding"), F.col("qe"), F.col("dn"), F.col("qn")), S.applicability(F.col("population"), F.col("qp"))
    score = S.composite(topic, apply, F.col("action"), F.col("tau"), F.col("evidence"), **options)
    return d.crossJoin(F.broadcast(q)).select("query_idx", "doc_idx", r6(score).alias("score"))


@query(f"select query_idx, doc_idx, round(cast({_R} as double), 6) as score {_FQ}", "factors", "asked")
def scl_16_clinical_relevance(spark, sf):
    return _relevance(spark, sf)


@query(f"select query_idx, doc_idx, round(cast({_R.replace('f.tau * f.evidence *', '')} as double), 6) as score {_FQ}", "factors", "asked")
def scl_17_score_toggles(spark, sf):
    return _relevance(spark, sf, use_tau=False, use_evidence=False)


@query(f"select query_idx, doc_idx, round(cast({_R.replace('0.5 *', '0.0 *', 1)} as double), 6) as score {_FQ}", "factors", "asked")
def scl_18_weights_without_topic(spark, sf):
    return _relevance(spark, sf, weights=S.weights_without("topic"))


@query(r"""select doc_idx, case when regexp_matches(t, '\b(treat|therap|drug|dose|dosing|supplement|intervention|prevent)') then 'treatment'
  when regexp_matches(t, '\b(diagnos|tests?\b|testing\b|screen|detect|marker|imaging)') then 'diagnosis_test'
  when regexp_matches(t, '\b(prognos|survival|risk of|outcome|mortality|recurrence)') then 'prognosis' else 'other' end as question_type
  from (select doc_idx, lower(title) as t from docs)""", "docs")
def scl_21_question_type(spark, sf):
    return V.documents(spark, sf).select("doc_idx", T.question_type(F.col("title")).alias("question_type"))


_TYPES = [*params.PUBLICATION_LEVELS, "Review", "Journal Article"]
_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "]"
_TYPES_OF = f"case when doc_id % 9 = 0 then null when doc_id % 9 = 1 then [] else [({_TYPE_LIST})[doc_id % {len(_TYPES)} + 1], ({_TYPE_LIST})[(doc_id * 5) % {len(_TYPES)} + 1]] end"
_TYPE_LEVEL = "case x " + " ".join(f"when '{k}' then {v}" for k, v in params.PUBLICATION_LEVELS.items()) + " end"


def _types(column: str = "doc_id"):
    names = F.array(*[F.lit(t) for t in _TYPES])
    pick = lambda e: F.element_at(names, F.expr(f"cast({e} as int)"))
    two = F.array(pick(f"{column} % {len(_TYPES)} + 1"), pick(f"({column} * 5) % {len(_TYPES)} + 1"))
    return F.when(F.expr(f"{column} % 9 = 0"), F.lit(None).cast("array<string>")).when(F.expr(f"{column} % 9 = 1"), F.array().cast("array<string>")).otherwise(two)


@query(f"select doc_id, cast(list_min(list_transform({_TYPES_OF}, lambda x: {_TYPE_LEVEL})) as int) as level from documents")
def scl_22_publication_level(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.publication_level(_types()).alias("level"))


@query("select item_id, case item_id % 4 when 0 then 'diagnosis_test' when 1 then 'diagnosis_test' when 2 then 'treatment' end as topic_column from benchmark")
def scl_23_topic_column(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in (" Diagnosis", "test ", "Treatment", "other")]), F.expr("cast(item_id % 4 + 1 as int)"))
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", T.topic_column(kind).alias("topic_column"))


@query("select doc_id, cast(doc_id as varchar) as normalised from documents")
def scl_28_pmc_id(spark, sf):
    raw = F.concat(F.when(F.expr("doc_id % 3 = 0"), F.lit("PMC")).when(F.expr("doc_id % 3 = 1"), F.lit("pmc")).otherwise(F.lit("")), F.col("doc_id").cast("string"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.pmc_id(raw).alias("normalised"))


@query("select doc_id, sha256(coalesce(text, '')) as sha from documents")
def scl_29_sha256(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query(r"select doc_idx, contains(lower(title), 'rct') as substring_hit, regexp_matches(lower(title), '\brct\b') as word_hit, cast(len(regexp_extract_all(lower(title), '\w*rct\w*')) as int) as words from docs", "docs")
def scl_30_word_boundaries(spark, sf):
    t = F.lower("title")
    return V.documents(spark, sf).select("doc_idx", F.contains(t, F.lit("rct")).alias("substring_hit"), t.rlike(r"\brct\b").alias("word_hit"), F.size(F.regexp_extract_all(t, F.lit(r"\w*rct\w*"), F.lit(0))).alias("words"))


@query("select count(distinct round(sqrt(doc_id % 97), 12)) as n from documents")
def scl_31_rounded_distinct(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").agg(F.countDistinct(F.round(F.sqrt(F.col("doc_id") % 97), 12)).alias("n"))


@query("select item_id, md5(text) as text_md5 from benchmark")
def scl_32_json_round_trip(spark, sf):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.to_json(F.struct("item_id", "text")).alias("line"))
    back = rows.select(F.from_json("line", "item_id long, text string").alias("r"))
    return back.select("r.item_id", F.md5("r.text").alias("text_md5"))


@query("select query_idx, doc_idx from judged where grade > 0", "judged")
def flt_02_relevant(spark, sf):
    return V.judged(spark, sf).where("grade > 0").select("query_idx", "doc_idx")


@query("select doc_id, case when doc_id % 4 <> 1 then true else false end as kept from documents")
def flt_05_abstract_types(spark, sf):
    kind = F.element_at(F.array(F.lit("summary"), F.lit("graphical"), F.lit("plain"), F.lit(None)), F.expr("cast(doc_id % 4 + 1 as int)"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce(~kind.isin("graphical", "teaser", "toc"), F.lit(True)).alias("kept"))


@query("select avg(cast(publication_date is not null as int)) >= 0.95 as temporal_on, round(avg(cast(publication_date is not null as int)), 6) as coverage from docs", "docs")
def flt_07_date_coverage(spark, sf):
    share = F.avg(F.col("publication_date").isNotNull().cast("int"))
    return V.documents(spark, sf).agg((share >= params.DATE_COVERAGE).alias("temporal_on"), r6(share).alias("coverage"))


@query(f"select count(*) as labelled from documents where {_TYPES_OF} is not null")
def flt_08_labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where(_types().isNotNull()).agg(F.count(F.lit(1)).alias("labelled"))


@query("select evidence_level, count(*) as n, round(avg(evidence), 6) as weight from factors group by 1", "factors")
def agg_13_level_histogram(spark, sf):
    return V.documents(spark, sf).groupBy("evidence_level").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(T.evidence_weight(F.col("evidence_level")))).alias("weight"))


@query("select keyword, count(*) as docs from docs join (values " + ", ".join(f"('{w}')" for x in params.EVIDENCE for w in x[5]) + ") k(keyword) on contains(t, keyword) group by 1", "docs")
def arm_35_keyword_audit(spark, sf):
    words = F.array(*[F.lit(w) for x in params.EVIDENCE for w in x[5]])
    text = F.lower(T.doc_text(F.col("title"), F.col("abstract")))
    return V.documents(spark, sf).select(F.explode(F.filter(words, lambda w: F.contains(text, w))).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("docs"))


@query("select doc_id, round(cast(n_chars as double) / 7, 6) as x, date_diff('day', date '2000-01-01', coalesce(d, date '2000-01-01')) as days from (select doc_id, n_chars, case doc_id % 5 when 0 then date '2003-02-01' when 1 then date '2003-01-01' when 2 then date '2003-02-01' when 3 then date '2003-07-09' else date '2003-01-01' end as d from documents)")
def src_10_dates(spark, sf):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.expr("cast(doc_id % 5 + 1 as int)"))
    date = T.parsed_date(F.lit("2003"), pick("2", "13", "02", "7", "Apr"), pick("30", "9", "", "9", None))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.round(F.col("n_chars").cast("double") / 7, 6).alias("x"), long(F.datediff(date, F.lit("2000-01-01").cast("date"))).alias("days"))

