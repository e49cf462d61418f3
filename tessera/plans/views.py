"""Ranking views over the test tables, in Spark and as DuckDB common table expressions.

The tables hold prose without titles, dates or populations, so these are derived from ids by fixed
rules that both engines share: titles carry the evidence keywords and signals, publication dates
are order dates, judgments are containment of a benchmark passage (grade 2) or a quality label in
the same residue class (grade 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.index import Index, kept_index
from ..operators.search import containing, small
from ..operators.stages import spread

AS_OF = "2001-01-01 00:00:00"
TITLES = [
    "A systematic review of outcomes", "Meta-analysis with a guideline", "Cochrane summary", "A randomized comparison", "A randomised comparison", "RCT of a dose", "Clinical trial protocol",
    "Cohort of patients", "A case-control design", "Propensity scores", "Case series", "Case report", "Retrospective chart", "Expert opinion", "Consensus statement", "Editorial",
    "We recommend a threshold", "It should be given", "Infarction and outcome", "", "Editorial on a systematic review", "Plain title", "Dose and protocol guideline", "Case-control and rct",
]
DOMAINS = ["infectious_disease", "oncology", "Cardiology", "pbm", "surgery", "anatomy", "unknown", "PBM"]


def _case(values: list[str], key: str) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents with their embeddings, made once for the tables as they are."""

    def docs() -> DataFrame:
        texts = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
        title = F.expr(_case(TITLES, "doc_id")).alias("title")
        return texts.join(vectors, "doc_id", "left").select(F.col("doc_id").alias("doc_idx"), title, F.coalesce("text", F.lit("")).alias("abstract"), "embedding")

    return kept_index(spark, [f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings")], docs)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_idx, id, title, abstract, embedding, publication_date, evidence_level, population, domain."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    rows = docs.join(vectors, "doc_id", "left").join(dates, "doc_id", "left")
    number = lambda e: F.expr(f"cast({e} as double)")
    population = (
        F.when(F.expr("doc_id % 10 = 6"), F.create_map(F.lit("sex"), F.lit(1.0)))
        .when(F.expr("doc_id % 5 = 1"), F.create_map().cast("map<string,double>"))
        .when(F.expr("doc_id % 5 = 2"), F.create_map(F.lit("age_min"), number("40 + doc_id % 30")))
        .when(F.expr("doc_id % 5 = 3"), F.create_map(F.lit("age_max"), number("50 + doc_id % 40")))
        .when(F.expr("doc_id % 5 = 4"), F.create_map(F.lit("age_min"), number("20 + doc_id % 40"), F.lit("age_max"), number("60 + doc_id % 50")))
    )
    given = F.expr("case when doc_id % 7 = 0 then cast(doc_id % 6 + 1 as int) end")
    title, abstract = F.expr(_case(TITLES, "doc_id")), F.coalesce("text", F.lit(""))
    return rows.select(
        F.col("doc_id").alias("doc_idx"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), title.alias("title"), abstract.alias("abstract"), "embedding",
        F.col("o_orderdate").cast("timestamp").alias("publication_date"), F.coalesce(given, T.evidence_level(title, abstract)).alias("evidence_level"),
        population.alias("population"), F.expr(_case(DOMAINS, "doc_id")).alias("domain"),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_idx, qid, text, embedding, population."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    population = F.when(F.expr("item_id % 3 = 1"), F.create_map(F.lit("age_min"), F.lit(65.0), F.lit("age_max"), F.lit(85.0))).when(F.expr("item_id % 3 = 2"), F.create_map(F.lit("age_min"), F.lit(18.0)))
    return items.join(vectors, "item_id", "left").select(F.col("item_id").alias("query_idx"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), "text", "embedding", population.alias("population"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_idx, doc_idx, grade."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc_idx"), "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    held = containing(docs, items.withColumnRenamed("item_id", "query_idx")).select("query_idx", "doc_idx", F.lit(2.0).alias("grade"))
    alike = labels.join(small(items.select("item_id")), F.expr("doc_id % 40 = item_id % 40")).select(F.col("item_id").alias("query_idx"), F.col("doc_id").alias("doc_idx"), F.lit(1.0).alias("grade"))
    return held.unionByName(alike).groupBy("query_idx", "doc_idx").agg(F.max("grade").alias("grade"))


_LEVEL_SQL = (
    "case when contains(t,'systematic review') or contains(t,'meta-analysis') or contains(t,'cochrane') then 1 "
    "when contains(t,'randomized') or contains(t,'randomised') or contains(t,'rct') or contains(t,'clinical trial') then 2 "
    "when contains(t,'cohort') or contains(t,'case-control') or contains(t,'propensity') then 3 "
    "when contains(t,'case series') or contains(t,'case report') or contains(t,'retrospective') then 4 "
    "when contains(t,'expert opinion') or contains(t,'consensus') or contains(t,'editorial') then 5 else 4 end"
)
_ACTION_SQL = "least((" + " + ".join(f"cast(contains(t,'{s}') as int)" for s in ("recommend", "guideline", "threshold", "should be", "dose", "protocol")) + ") / 6.0, 1.0)"
_RATE_SQL = "case lower(domain) when 'infectious_disease' then 0.2 when 'oncology' then 0.15 when 'cardiology' then 0.1 when 'pbm' then 0.12 when 'surgery' then 0.08 when 'anatomy' then 0.02 else 0.12 end"
_WEIGHT_SQL = "case evidence_level when 1 then 1.0 when 2 then 0.85 when 3 then 0.65 when 4 then 0.45 when 5 then 0.25 else 0.5 end"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"


def cosine_sql(a: str, b: str) -> str:
    dot = _DOT.format(a=a, b=b)
    na, nb = (f"sqrt({_DOT.format(a=x, b=x)})" for x in (a, b))
    return f"coalesce(case when {na} = 0 or {nb} = 0 then 0.0 else {dot} / ({na} * {nb}) end, 0.0)"


#: Common table expressions: name -> (what it needs, SQL).
CTES: dict[str, tuple[list[str], str]] = {
    "docs0": ([], f"select d.doc_id as doc_idx, 'd' || d.doc_id as id, {_case(TITLES, 'd.doc_id')} as title, coalesce(d.text, '') as abstract, e.embedding, cast(o.o_orderdate as timestamp) as publication_date, case when d.doc_id % 7 = 0 then cast(d.doc_id % 6 + 1 as int) end as given, {_case(DOMAINS, 'd.doc_id')} as domain, case when d.doc_id % 10 = 6 then 1 when d.doc_id % 5 = 0 then null when d.doc_id % 5 = 1 then 0 else 1 end as pop, case when d.doc_id % 10 <> 6 and d.doc_id % 5 = 2 then 40 + d.doc_id % 30 when d.doc_id % 5 = 4 then 20 + d.doc_id % 40 end as age_min, case when d.doc_id % 5 = 3 then 50 + d.doc_id % 40 when d.doc_id % 5 = 4 then 60 + d.doc_id % 50 end as age_max from documents d left join embeddings e on e.vec_id = d.doc_id left join orders o on o.o_orderkey = d.doc_id"),
    "docs1": (["docs0"], "select *, lower(title || ' ' || abstract) as t from docs0"),
    "docs": (["docs1"], f"select *, coalesce(given, {_LEVEL_SQL}) as evidence_level, {_ACTION_SQL} as action, {_RATE_SQL} as rate from docs1"),
    "factors": (["docs"], f"select *, {_WEIGHT_SQL} as evidence, coalesce(exp(-rate * greatest(floor((epoch_us(timestamp '{AS_OF}') - epoch_us(publication_date)) / 86400000000.0), 0) / 365.25), 1.0) as tau from docs"),
    "asked": ([], "select item_id as query_idx, 'q' || item_id as qid, b.text, e.embedding, case item_id % 3 when 0 then null else 1 end as pop, case item_id % 3 when 1 then 65.0 when 2 then 18.0 end as age_min, case item_id % 3 when 1 then 85.0 end as age_max from benchmark b left join embeddings e on e.vec_id = b.item_id"),
    "judged": ([], "select query_idx, doc_idx, max(grade) as grade from (select item_id as query_idx, doc_id as doc_idx, cast(2.0 as double) as grade from documents d join benchmark b on b.text <> '' and contains(d.text, b.text) union all select distinct item_id, doc_id, cast(1.0 as double) from labels l join benchmark b on l.quality = 1 and l.doc_id % 40 = b.item_id % 40) group by all"),
    "tokens": (["docs"], r"select doc_idx, regexp_extract_all(t, '[\p{L}\p{N}_]+') as tokens from docs"),
    "lengths": (["tokens"], "select doc_idx, len(tokens) as dl from tokens"),
    "postings": (["tokens"], "select doc_idx, term, count(*) as tf from (select doc_idx, unnest(tokens) as term from tokens) group by all"),
    "terms": (["postings"], "select term, count(*) as df from postings group by term"),
    "corpus": (["lengths"], "select count(*) as n, sum(dl) / greatest(count(*), 1) as avgdl from lengths"),
    "query_terms": (["asked"], r"select query_idx, term, count(*) as times from (select query_idx, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from asked) group by all"),
    "bm25": (["postings", "terms", "corpus", "lengths", "query_terms"], "select query_idx, p.doc_idx, cast(sum(times * cast(round(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) * 1e12) as bigint)) as double) / 1e12 as bm25 from query_terms q join terms using (term) join postings p using (term) join lengths l on l.doc_idx = p.doc_idx cross join corpus group by query_idx, p.doc_idx"),
    "bm25_all": (["bm25", "asked", "docs"], "select query_idx, doc_idx, coalesce(bm25, 0.0) as bm25 from (select query_idx, doc_idx from asked cross join docs) left join bm25 using (query_idx, doc_idx)"),
    "bm25_top": (["bm25_all"], "select * from (select *, row_number() over (partition by query_idx order by round(bm25, 9) desc, doc_idx) as rank from bm25_all) where rank <= 100"),
    "standard": (["bm25", "corpus"], "select query_idx, s / n as mean, case when ss / n - (s / n) * (s / n) > 1e-18 then sqrt(ss / n - (s / n) * (s / n)) else 0.0 end as sd from (select query_idx, sum(bm25) as s, sum(bm25 * bm25) as ss from bm25 group by 1) cross join corpus"),
    "hybrid0": (["bm25_all", "standard", "docs", "asked"], f"select b.query_idx, b.doc_idx, b.bm25, case when coalesce(sd, 0) > 0 then (b.bm25 - mean) / sd else 0.0 end as z, {cosine_sql('d.embedding', 'q.embedding')} as cosine from bm25_all b left join standard s on s.query_idx = b.query_idx join docs d on d.doc_idx = b.doc_idx join asked q on q.query_idx = b.query_idx"),
    "hybrid": (["hybrid0"], "select *, 0.4 * z + 0.6 * cosine as hybrid from hybrid0"),
    "hybrid_top": (["hybrid"], "select * from (select *, row_number() over (partition by query_idx order by round(hybrid, 9) desc, doc_idx) as rank from hybrid) where rank <= 100"),
    "pool0": (["hybrid_top", "factors", "asked"], "select h.query_idx, h.doc_idx, h.bm25, h.z, h.cosine, h.hybrid, h.rank as pool_rank, f.action, f.tau, f.evidence, f.evidence_level, case when coalesce(f.pop, 0) = 0 or coalesce(q.pop, 0) = 0 then 0.5 else (case when least(coalesce(f.age_max, 120.0), coalesce(q.age_max, 120.0)) <= greatest(coalesce(f.age_min, 0.0), coalesce(q.age_min, 0.0)) or coalesce(q.age_max, 120.0) = coalesce(q.age_min, 0.0) then 0.0 else (least(coalesce(f.age_max, 120.0), coalesce(q.age_max, 120.0)) - greatest(coalesce(f.age_min, 0.0), coalesce(q.age_min, 0.0))) / (coalesce(q.age_max, 120.0) - coalesce(q.age_min, 0.0)) end) end as apply, q.text as query_text, f.publication_date from hybrid_top h join factors f using (doc_idx) join asked q on q.query_idx = h.query_idx"),
    "pool": (["pool0", "judged"], "select p.*, coalesce(j.grade, 0.0) as grade from pool0 p left join judged j using (query_idx, doc_idx)"),
    "ideal": (["judged"], "select query_idx, sum(grade / log2(place + 1)) as idcg from (select *, row_number() over (partition by query_idx order by grade desc, doc_idx) as place from judged) where place <= 10 group by 1"),
}


def with_ctes(sql: str, *needed: str, extra: dict[str, str] | None = None) -> str:
    """The SQL after the expressions that it needs, each once and in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for need in CTES[name][0]:
            if need not in done:
                add(need)
        done.setdefault(name, CTES[name][1])

    for name in needed:
        add(name)
    done |= extra or {}
    return "with " + ",\n".join(f"{k} as materialized ({v})" for k, v in done.items()) + "\n" + sql
