from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()], F.lit(0).alias("z")).select(column.alias("r")).first().r


def test_decay(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    decay = lambda d, q, *a: one(spark, S.temporal_decay(ts(d), ts(q), *a))
    assert decay("2024-01-01", "2024-01-01") == 1.0
    assert decay("2030-01-01", "2024-01-01") == 1.0
    assert decay("2014-01-01", "2024-01-01") < decay("2020-01-01", "2024-01-01")
    assert decay("2016-01-01", "2024-01-01", F.lit("anatomy")) > decay("2016-01-01", "2024-01-01", F.lit("infectious_disease"))
    assert decay("2023-12-31 23:59:59", "2024-01-01 00:00:01") == 1.0  # less than a whole day
    assert decay("2014-01-01", "2024-01-01", F.lit("pbm"), F.lit(0.0)) == 1.0
    assert one(spark, S.half_life(F.lit("PBM"))) == pytest.approx(math.log(2) / 0.12)
    with pytest.raises(Exception, match="positive"):
        one(spark, S.years_until(F.lit(0.0), F.lit("pbm")))


def test_evidence(spark):
    level = lambda t, a="", **k: one(spark, T.evidence_level(F.lit(t), F.lit(a), **k))
    assert level("A Systematic Review of RCTs") == 1
    assert level("infarction") == 2  # substrings count
    assert level("infarction", whole_words=True) == 4
    assert level("case", "report") == 4
    assert level("nothing") == 4
    assert one(spark, T.evidence_weight(F.lit(1))) == 1.0
    assert one(spark, T.evidence_weight(F.lit(9))) == 0.5
    assert one(spark, T.evidence_weight(F.lit(None).cast("int"))) == 0.5


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, S.cosine(v(1, 0), v(-1, 0))) == -1.0
    assert one(spark, S.cosine(v(0, 0), v(1, 0))) == 0.0
    with pytest.raises(Exception, match="differ"):
        one(spark, S.cosine(v(1), v(1, 0)))


def test_applicability(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in (kv[0], float(kv[1]))]) if k else F.create_map().cast("map<string,double>")
    f = lambda d, q: one(spark, S.applicability(d, q))
    assert f(m(), m(age_min=1)) == 0.5
    assert f(F.lit(None).cast("map<string,double>"), m(age_min=1)) == 0.5
    assert f(m(age_min=40, age_max=80), m(age_min=60, age_max=100)) == 0.5
    assert f(m(age_min=70), m(age_max=60)) == 0.0
    assert f(m(other=1), m(age_min=20, age_max=40)) == 1.0


def test_composite_may_be_negative(spark):
    score = S.composite(F.lit(-1.0), F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    assert one(spark, score) == pytest.approx(-0.35)


def test_types_and_dates(spark):
    types = lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
    assert one(spark, T.publication_level(types("Review", "Editorial", "Meta-Analysis"))) == 1
    assert one(spark, T.publication_level(types("Review"))) is None
    assert one(spark, T.publication_level(types())) is None
    date = lambda *x: str(one(spark, T.parsed_date(*[F.lit(y) for y in x])))
    assert date("2003", "2", "30") == "2003-02-01"
    assert date("2003", "13", "5") == "2003-01-01"
    assert date("2003", "Apr", "9") == "2003-01-09"
    assert date("x", "1", "1") == "None"
    assert one(spark, T.pmc_id(F.lit("pmc12"))) == "12"
    assert one(spark, T.question_type(F.lit("What tests detect it?"))) == "diagnosis_test"


def test_relevance_of_pairs_reads_texts_once_a_document(spark):
    from tessera.plans import scalar_queries as Q
    from tessera.plans import views as V

    sf = "/root/testdata/sf0.001"
    d = V.documents(spark, sf).where("embedding is not null and publication_date is not null")
    q = V.asked(spark, sf).where("embedding is not null").select("query_idx", F.col("embedding").alias("qe"), F.col("population").alias("qp"))
    doc = {c: F.col(c) for c in ("embedding", "population", "title", "abstract", "publication_date", "domain", "evidence_level")}
    for found, options in ((Q.scl_16_clinical_relevance, {}), (Q.scl_18_weights_without_topic, {"weights": S.weights_without("topic")}), (Q.scl_17_score_toggles, {"use_tau": False, "use_evidence": False})):
        rows = found(spark, sf)
        above = re.split("Join (?:Cross|Inner)", rows._jdf.queryExecution().optimizedPlan().toString())[0]
        assert "contains(" not in above.lower(), "texts are searched for every pair"
        pairs = d.crossJoin(q).select("query_idx", "doc_idx", F.round(S.clinical_relevance(doc, {"embedding": F.col("qe"), "population": F.col("qp")}, Q.as_of(), **options), 6).alias("score"))
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, pairs.collect())) != []
