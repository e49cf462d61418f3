from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import runs


class Killed(Exception):
    pass


def setting(spark):
    rows = [(a, q, (q * 3 + r * (1 + (a == "b"))) % 7, r, f"q{q}", f"d{r}") for a in "ab" for q in range(3) for r in range(1, 5)]
    ranking = spark.createDataFrame(rows, "arm string, query_idx long, doc_idx long, rank int, qid string, id string")
    qrels = spark.createDataFrame([(q, d, float((q + d) % 3)) for q in range(3) for d in range(7)], "query_idx long, doc_idx long, grade double")
    return ranking, qrels


def test_a_run_killed_between_its_phases_keeps_its_rankings(spark, tmp_path):
    ranking, qrels = setting(spark)
    folder, calls = str(tmp_path / "run"), []

    def rank():
        calls.append("rank")
        return ranking if calls.count("rank") == 1 else ranking.where("false")

    def judge():
        calls.append("judge")
        if calls.count("judge") == 1:
            raise Killed
        return qrels

    with pytest.raises(Killed):
        runs.evaluated(spark, folder, "plan", rank, judge)
    sealed = sorted(map(tuple, runs.sealed_rankings(spark, folder, "plan", rank).collect()))
    assert sealed == sorted(map(tuple, ranking.collect()))
    order = lambda df: sorted(map(tuple, df.select("arm", "query_idx", F.round("ndcg", 9), "p", "mrr").collect()))
    assert order(runs.evaluated(spark, folder, "plan", rank, judge)) == order(M.per_query(ranking, qrels))
    assert order(runs.evaluated(spark, folder, "plan", rank, judge)) == order(M.per_query(ranking, qrels))
    assert calls == ["rank", "judge", "judge"]


def test_a_run_killed_while_ranking_starts_again(spark, tmp_path):
    ranking, qrels = setting(spark)

    def die():
        raise Killed

    def unread():
        raise AssertionError("judgments before the rankings are sealed")

    broken = ranking.withColumn("rank", F.when(F.col("arm") == "a", F.col("rank")).otherwise(F.raise_error(F.lit("lost"))))
    for rank, fault in ((die, Killed), (lambda: broken, Exception)):
        with pytest.raises(fault):
            runs.evaluated(spark, str(tmp_path), "plan", rank, unread)
    assert runs.evaluated(spark, str(tmp_path), "plan", lambda: ranking, lambda: qrels).count() == 6


def test_another_plan_and_missing_judgments_are_refused(spark, tmp_path):
    ranking, qrels = setting(spark)
    with pytest.raises(ValueError, match=r"without judgments: \[2\]"):
        runs.evaluated(spark, str(tmp_path), "plan", lambda: ranking, lambda: qrels.where("query_idx <> 2"))
    with pytest.raises(ValueError, match="another plan"):
        runs.evaluated(spark, str(tmp_path), "other", lambda: ranking, lambda: qrels)
    lines = spark.read.text(f"{runs._seal_of(spark, str(tmp_path), 'rankings', 'plan')}/runs").where("arm = 'a'").collect()
    assert len(lines) == 12 and all(r.value.split()[1] == "Q0" and r.value.endswith(" a") for r in lines)
