from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import pool as P
from tessera.operators import ranker
from tessera.operators import search as R
from tessera.operators import stats as ST

P_SHUFFLED = P.shuffled

WORDS = "Blood loss iron's dose α-beta under_score RCT naïve the of anemia".split()
TEXTS = [" ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(i % 7)) for i in range(40)] + ["", "blood blood blood", "blood blood blood"]
ASKED = ["blood iron", "BLOOD blood", "nothing here", "", "!?", "α dose"]


def expected(k):
    toks = [re.findall(r"\b\w+\b", f" {t}".lower()) for t in TEXTS]
    df, avg = Counter(w for t in toks for w in set(t)), sum(map(len, toks)) / len(toks)
    out = {}
    for q, text in enumerate(ASKED):
        scores = []
        for i, t in enumerate(toks):
            tf = Counter(t)
            scores.append((-round(sum(math.log((len(toks) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in re.findall(r"\b\w+\b", text.lower()) if tf[w]), 9), i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, "", t, [1.0, float(i % 3)]) for i, t in enumerate(TEXTS)], "doc_idx long, title string, abstract string, embedding array<double>")
    return R.build_index(docs)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, t, [1.0, 1.0]) for i, t in enumerate(ASKED)], "query_idx long, text string, embedding array<double>")


def test_bm25_search_pads_and_ties(index, asked):
    rows = R.bm25_search(index, asked, 12).collect()
    got = {q: [r.doc_idx for r in sorted(rows, key=lambda r: r["rank"]) if r.query_idx == q] for q in range(len(ASKED))}
    assert got == expected(12)


def test_hybrid_is_dense(index, asked):
    assert R.hybrid_search(index, asked, k=100).count() == len(TEXTS) * len(ASKED)


def test_metrics(spark):
    ranking = spark.createDataFrame([("a", 0, 2, 1), ("a", 0, 1, 2), ("a", 1, 5, 1)], "arm string, query_idx long, doc_idx long, rank int")
    qrels = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (0, 3, 0.0), (1, 9, 1.0)], "query_idx long, doc_idx long, grade double")
    rows = {r.query_idx: r for r in M.per_query(ranking, qrels).collect()}
    assert rows[0].p == pytest.approx(0.2)
    assert rows[0].ndcg == pytest.approx((1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert rows[0].mrr == 1.0 and rows[1].mrr == 0.0 and rows[1].ndcg == 0.0


def test_z_and_fill(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, None, 5.0), (0, 3.0, 5.0), (1, None, 1.0)], "query_idx long, x double, y double")
    rows = df.select("query_idx", P.filled(F.col("x")).alias("f"), P.z(F.col("y")).alias("z")).collect()
    assert [r.f for r in rows if r.query_idx == 0] == [1.0, 2.0, 3.0]
    assert [r.f for r in rows if r.query_idx == 1] == [0.0]
    assert all(r.z == 0 for r in rows)


def test_holm_and_decisions(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert [round(r.p_holm, 9) for r in ST.holm(rows).orderBy("name").collect()] == [0.03, 0.06, 0.06]
    good = {"positive_lo": 0.1, "primary_mean": 0.06, "primary_lo": 0.01, "primary_hi": 0.2, "f_mean": 0.1, "f_p": 0.01, "u_mean": 0.1, "u_p": 0.01, "v_mean": 0.1, "v_p": 0.01, "noise_hi": 0.01}

    def decide(manipulated=True, **change):
        t = {k: F.lit(v) for k, v in (good | change).items()} | {"manipulated": F.lit(manipulated)}
        return spark.range(1).select(ST.decide(t).alias("d")).first().d

    assert decide() == "Supported"
    assert decide(positive_lo=0.0) == "Test failed"
    assert decide(primary_hi=0.049) == "Refuted"
    assert decide(manipulated=False) == "Untestable"
    assert decide(u_p=0.2) == "Gain without attribution"
    assert decide(primary_mean=0.04) == "Inconclusive"


def test_ranker_learns_a_linear_signal(spark):
    rows = [(q, d, d, float(d % 5), [float((d * 7 + q) % 11), float(d % 5)]) for q in range(10) for d in range(15)]
    items = spark.createDataFrame(rows, "query_idx long, doc_idx long, pool_rank long, grade double, features array<double>")
    pairs = ranker.dominance_pairs(items, limit=50)
    assert pairs.groupBy("query_idx").count().where("count > 50").count() == 0
    weights = ranker.fit(pairs, 0.01)
    assert weights[1] > abs(weights[0])


def test_learned_ranker_query_does_the_whole_job(spark, monkeypatch):
    from tessera.plans import ranking_queries as Q

    seen = {}

    def cross_fit(items, qrels, folds=5, grid=None):
        seen.update(folds=folds, grid=grid or ranker.params.PENALTIES)
        return items.withColumn("score", F.lit(0.0)), []

    monkeypatch.setattr(ranker, "cross_fit", cross_fit)
    Q.arm_34_learned_ranker(spark, "/root/testdata/sf0.001")
    assert seen == {"folds": 5, "grid": [0.001, 0.01, 0.1, 1.0, 10.0]}


def newton(x, penalty):
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(x @ w))
        g = -(p @ x) / len(x) + 2 * penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + 2 * penalty * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def ranker_rows(seed=3, queries=30):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(queries):
        for d in range(12):
            x = rng.normal(size=4)
            rows.append((q, d, d, float(x @ [1.0, -0.5, 0.2, 0.0] + rng.normal() > 0.5), x.tolist()))
    return rows


def test_cross_fit_equals_models_fitted_one_by_one(spark):
    rows, folds, grid = ranker_rows(), 3, [0.001, 0.1, 10.0]
    items = spark.createDataFrame(rows, "query_idx long, doc_idx long, pool_rank long, grade double, features array<double>")
    scored, chosen = ranker.cross_fit(items, items.select("query_idx", "doc_idx", "grade"), folds, grid)
    fold = lambda q, seed="": int(hashlib.md5(f"{seed}{q}".encode()).hexdigest()[:8], 16) % folds
    by = {q: [r for r in rows if r[0] == q] for q in {r[0] for r in rows}}

    def weights(seen, penalty):
        x = np.array([np.subtract(a[4], b[4]) for q in sorted(seen) for a in by[q] for b in by[q] if a[3] > b[3]])
        return newton(x, penalty)

    def ndcg(q, w):
        order = sorted(by[q], key=lambda r: (-round(float(np.dot(r[4], w)), 9), r[2]))
        dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g[:10]))
        best = dcg(sorted((r[3] for r in by[q]), reverse=True))
        return dcg([r[3] for r in order]) / best if best else 0.0

    got = {(r.query_idx, r.doc_idx): r.score for r in scored.collect()}
    assert len(got) == len(rows)
    for k in range(folds):
        train = {q for q in by if fold(q) != k}
        mean = {p: np.mean([ndcg(q, weights({t for t in train if fold(t, f"{k}|") != fold(q, f"{k}|")}, p)) for q in train]) for p in grid}
        assert chosen[k] == max(grid, key=lambda p: (round(mean[p], 12), -p))
        w = weights(train, chosen[k])
        for q in set(by) - train:
            assert [got[q, r[1]] for r in by[q]] == pytest.approx([float(np.dot(r[4], w)) for r in by[q]], abs=1e-6)


def test_grades_on_another_scale_change_nothing(spark):
    rows = ranker_rows(4, 15)
    schema = "query_idx long, doc_idx long, pool_rank long, grade double, features array<double>"
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame([(*r[:3], 3 * r[3], r[4]) for r in rows], schema)
    run = lambda items: sorted(map(tuple, ranker.cross_fit(items, items.select("query_idx", "doc_idx", "grade"), 3, [0.01, 1.0])[0].select("query_idx", "doc_idx", F.round("score", 6)).collect()))
    assert run(one) == run(two)


def test_ranker_without_pairs_scores_nothing(spark):
    items = spark.createDataFrame([(q, d, d, 0.0, [1.0, float(d)]) for q in range(4) for d in range(3)], "query_idx long, doc_idx long, pool_rank long, grade double, features array<double>")
    scored, _ = ranker.cross_fit(items, items.select("query_idx", "doc_idx", "grade"), 2, [0.1])
    assert [r.score for r in scored.collect()] == [0.0] * 12


def test_statistics_equal_draws_one_by_one(spark):
    rng = np.random.default_rng(2)
    names, n, draws = ["M-B0", "M-F", "M-U", "M-V", "M-L", "M-Rbar", "Nbar-B0", "Pbar-M"], 23, 300
    x = {k: np.round(rng.normal(0.06 if k[0] == "M" else 0, 0.1, n), 9) for k in names}
    queries = [q * 3 for q in range(n)]
    diffs = spark.createDataFrame([(k, q, float(v)) for k in names for q, v in zip(queries, x[k], strict=True)], "name string, query_idx long, diff double")
    stats = ST.statistics(diffs, draws, draws)
    got = {r.name: r for r in stats.collect()}
    uniform = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2**48
    p = {}
    for k in names:
        means = [np.mean([x[k][int(uniform("b", d, j) * n)] for j in range(n)]) for d in range(draws)]
        null = [abs(np.mean([v * (-1 if uniform("s", d, q) < 0.5 else 1) for q, v in zip(queries, x[k], strict=True)])) for d in range(draws)]
        p[k] = (1 + sum(m >= abs(x[k].mean()) - 1e-12 for m in null)) / (draws + 1)
        assert [got[k].mean, got[k].lo, got[k].hi, got[k].p] == pytest.approx([x[k].mean(), *np.percentile(means, [2.5, 97.5]), p[k]])
    family, running = sorted((p[k], k) for k in ST.FAMILY), 0.0
    for i, (v, k) in enumerate(family):
        running = max(running, (5 - i) * v)
        assert got[k].p_holm == pytest.approx(min(1.0, running))
    assert all(got[k].p_holm is None for k in names if k not in ST.FAMILY)
    sig = {k: got[k].p_holm < 0.05 and got[k].mean > 0 for k in ST.FAMILY}
    row = ST.analysis(stats, spark.range(1).select(F.lit(True).alias("manipulated"))).first()
    b0, gain = got["M-B0"], got["M-B0"].mean >= 0.05 and got["M-B0"].lo > 0
    noise = got["Nbar-B0"].hi < 0.05
    want = "Test failed" if got["Pbar-M"].lo <= 0 else "Refuted" if b0.hi < 0.05 else "Supported" if gain and sig["M-F"] and sig["M-U"] and sig["M-V"] and noise else "Gain without attribution" if gain and not (sig["M-U"] and sig["M-V"] and noise) else "Inconclusive"
    assert (row.decision, row.mapping_adds, row.learned_beats) == (want, sig["M-Rbar"], got["M-L"].p_holm < 0.05 and got["M-L"].mean < 0)


def test_learned_arm_beats_the_designed_one(spark):
    diffs = spark.createDataFrame([(k, q, v + q % 2 / 1000) for k, v in {"M-B0": 0.1, "M-F": 0.1, "M-U": 0.1, "M-V": 0.1, "M-L": -0.1, "M-Rbar": -0.001, "Nbar-B0": 0.0, "Pbar-M": 0.1}.items() for q in range(20)], "name string, query_idx long, diff double")
    row = ST.analysis(ST.statistics(diffs, 500, 500), spark.range(1).select(F.lit(True).alias("manipulated"))).first()
    assert (row.decision, row.learned_beats, row.mapping_adds) == ("Supported", True, False)


def test_draws_are_those_of_the_reference(spark, monkeypatch):
    from tessera.plans import arm_queries  # noqa: F401
    from tessera.plans import ranking_queries as Q
    from tessera.plans.registry import QUERIES, SQL

    seen = []
    monkeypatch.setattr(Q.P, "shuffled", lambda pool, draws, *more: seen.append(draws) or P_SHUFFLED(pool, 1, *more))
    QUERIES["arm_08_random_rerank"](spark, "/root/testdata/sf0.001")
    assert seen == [200]
    assert "range(10000)" in SQL["sta_01_bootstrap_interval"] and "range(10000)" in SQL["sta_02_sign_flips"] and "/ 10001.0" in SQL["sta_02_sign_flips"]


def test_encoder_driver_and_control_verdicts(spark):
    rows = spark.createDataFrame([(0, -0.2, -0.1), (1, 0.05, 0.3), (2, -0.01, 0.1), (3, 0.0, 0.0)], "i int, lo double, hi double")
    lo, hi = F.col("lo"), F.col("hi")
    got = rows.select("i", ST.encoder_verdict(lo, hi).alias("e"), ST.driver_verdict(hi, lo).alias("d"), ST.control_ok(lo).alias("c")).orderBy("i").collect()
    assert [r.e for r in got] == ["harmful", "informative", "no detectable information", "no detectable information"]
    assert [r.d == "evidence weight dominates" for r in got] == [False, True, False, False]
    assert [r.c for r in got] == [False, False, True, True]
