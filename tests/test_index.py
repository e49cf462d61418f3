from __future__ import annotations

import re
import uuid
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import pool as P
from tessera.operators import search as R

DOCS = "doc_idx long, title string, abstract string, embedding array<double>"
TEXTS = ["Blood loss", "", None, "blood BLOOD under_score α-β", "naïve x1 '' iron's", "İstanbul ΑΣ", "blood iron loss", "loss " * 3000]


def frame(spark, texts, first=0, d=4):
    rng = np.random.default_rng(first)
    return spark.createDataFrame([(first + i, "T1" if i % 2 else None, t, None if i % 5 == 3 else rng.normal(size=d).tolist()) for i, t in enumerate(texts)], DOCS)


def fresh(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


def test_index_holds_the_terms_of_each_document(spark):
    index = I.build_index(frame(spark, TEXTS), fresh(spark))
    want = {i: Counter(re.findall(r"\b\w+\b", f"{'T1' if i % 2 else ''} {t or ''}".lower())) for i, t in enumerate(TEXTS)}
    got = {r.doc_idx: dict(zip(r.terms, r.tfs, strict=True)) for r in index.rows.collect()}
    assert got == {i: dict(c) for i, c in want.items()}
    assert {r.term: r.df for r in index.terms.collect()} == Counter(t for c in want.values() for t in c)
    assert (index.n, index.length) == (len(TEXTS), sum(c.total() for c in want.values()))
    assert {(r.doc_idx, r.term, r.tf, r.dl) for r in index.postings.collect()} == {(i, t, n, c.total()) for i, c in want.items() for t, n in c.items()}


def test_appended_documents_count_as_if_built_at_once(spark):
    path, asked = fresh(spark), spark.createDataFrame([(0, "blood loss iron", [1.0, 0.0, 0.0, 0.0])], "query_idx long, text string, embedding array<double>")
    I.append(frame(spark, TEXTS[:4]), path)
    I.append(frame(spark, TEXTS[4:], first=4), path)
    one, two = I.build_index(frame(spark, TEXTS[:4]).unionByName(frame(spark, TEXTS[4:], first=4)), fresh(spark)), I.read(spark, path)
    rows = lambda i: sorted(map(tuple, R.hybrid_search(i, asked).collect()))
    assert rows(one) == rows(two) and len(rows(two)) == len(TEXTS)
    assert (one.n, one.length) == (two.n, two.length)


def test_a_segment_without_its_line_is_not_read(spark):
    path = fresh(spark)
    assert I.read(spark, path) is None
    I.append(frame(spark, TEXTS[:2]), path)
    I.tokenised(frame(spark, TEXTS[2:])).write.parquet(f"{path}/rows/died")
    assert I.read(spark, path).n == I.read(spark, path).rows.count() == 2


def test_kept_index_follows_the_files(spark):
    source, built = fresh(spark), []
    frame(spark, TEXTS[:3]).write.parquet(source)

    def docs():
        built.append(1)
        return spark.read.parquet(source)

    assert I.kept_index(spark, [source], docs).n == I.kept_index(spark, [source], docs).n == 3 and len(built) == 1
    (path,) = [p for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "indexes").iterdir() if I.read(spark, f"file://{p}").n == 3]
    I.append(docs(), f"file://{path}")  # as another session does that found nothing yet
    assert I.kept_index(spark, [source], docs).n == 3 and built.pop() == 1
    frame(spark, TEXTS[3:5], first=3).write.mode("append").parquet(source)
    assert I.kept_index(spark, [source], docs).n == 5 and len(built) == 2


def test_empty_index(spark):
    index = I.build_index(spark.createDataFrame([], DOCS), fresh(spark))
    asked = spark.createDataFrame([(0, "blood", [1.0])], "query_idx long, text string, embedding array<double>")
    assert R.bm25_search(index, asked).count() == R.hybrid_search(index, asked).count() == R.bm25_scores(index, asked).count() == 0


@pytest.mark.parametrize("values", [[0.0], [1.0, 2.0], [1.0, 1.0 + 1e-9, 1.0 - 1e-9, 2.0], list(np.linspace(0, 1, 997))])
def test_best_keeps_all_that_may_rank(values):
    rng = np.random.default_rng(1)
    score = rng.choice(values, (600, 3))
    best = R.Best(10, 3)
    best.most = 500
    docs = rng.permutation(600)
    for s in range(0, 600, 100):
        best.add(docs[s : s + 100], score[s : s + 100])
    left = best.trim()
    for q in range(3):
        order = np.lexsort((docs, -np.round(score[:, q], 9)))[:10]
        held = left[left["f0"] == q]
        again = np.lexsort((held["f1"], -np.round(held["f2"], 9)))[:10]
        assert held["f1"][again].tolist() == docs[order].tolist()
        assert len(held) <= 10 * len(np.unique(np.array(values)))


def test_searches_in_parts_equal_those_at_once(spark, monkeypatch):
    index = I.build_index(frame(spark, TEXTS * 3), fresh(spark))
    asked = spark.createDataFrame([(i, t, [1.0, float(i), 0.5, -1.0]) for i, t in enumerate(["blood", "loss loss", "", "iron α", "none"])], "query_idx long, text string, embedding array<double>")
    searches = [lambda: R.bm25_search(index, asked, 5), lambda: R.hybrid_search(index, asked, k=5), lambda: R.vector_search(index.rows, asked, 5, unit=False), lambda: R.bm25_scores(index, asked), lambda: R.bm25_moments(index, asked)]
    run = lambda: [sorted(tuple(round(x, 9) for x in r) for r in s().collect()) for s in searches]
    whole = run()
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 2)
    assert run() == whole and all(whole)


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(300, 6)), rng.normal(size=(7, 6))
    x[20:40] = x[0]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0])], "doc_idx long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_idx long, embedding array<double>")
    got = R.vector_search(docs, asked, 9).collect()
    cosine = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
    for i in range(7):
        want = sorted([*range(300)], key=lambda d: (-cosine[i, d], d))[:9]
        assert [r.doc_idx for r in sorted(got, key=lambda r: r["rank"]) if r.query_idx == i] == want


def test_containing(spark):
    docs = spark.createDataFrame([(0, "the quick brown fox"), (1, "quick"), (2, None), (3, ""), (4, "brown foxes")], "doc_idx long, text string")
    asked = spark.createDataFrame([(0, "quick"), (1, "brown fox"), (2, ""), (3, None), (4, "quick"), (5, "absent")], "query_idx long, text string")
    assert sorted(map(tuple, R.containing(docs, asked).collect())) == [(0, 0), (0, 1), (1, 0), (1, 4), (4, 0), (4, 1)]
    assert R.containing(docs, asked.where("false")).count() == 0


def test_gaussians_are_standard_and_repeatable(spark):
    rows = spark.range(400).select("id", P.gaussians("g", F.col("id"), 8).alias("v"))
    x = np.array([r.v for r in rows.collect()])
    assert x.shape == (400, 8) and abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.05 and abs(np.corrcoef(x.T) - np.eye(8)).max() < 0.2
    assert (np.array([r.v for r in rows.repartition(3).orderBy("id").collect()]) == x).all()


def test_memory_of_a_task_has_a_bound(spark):
    import pyarrow as pa

    from tessera.operators import stages
    from tessera.operators.index import tokenised

    kept = {k: spark.conf.get(k) for k in stages.BATCH}
    try:
        for k in stages.BATCH:
            spark.conf.set(k, "1000000000")
        tokenised(spark.createDataFrame([(1, "a", "b")], "doc_idx long, title string, abstract string"))
        assert {k: int(spark.conf.get(k)) for k in stages.BATCH} == stages.BATCH
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    batch = pa.RecordBatch.from_pydict({"doc_idx": list(range(600))})
    assert [b.num_rows for b in stages.pieces([batch])] == [256, 256, 88]


def test_searches_of_a_standing_index_bound_their_batches(spark):
    from tessera.operators import stages

    index = I.build_index(frame(spark, TEXTS), fresh(spark))
    asked = spark.createDataFrame([(0, "blood loss iron", [1.0, 0.0, 0.0, 0.0])], "query_idx long, text string, embedding array<double>")
    kept = {k: spark.conf.get(k) for k in stages.BATCH}
    passages = spark.createDataFrame([(0, "loss")], "query_idx long, text string")
    searches = [
        lambda: R.bm25_best(index, asked, 3), lambda: R.bm25_moments(index, asked), lambda: R.vector_best(index.rows, asked, 3, True), lambda: R.hybrid_search(index, asked),
        lambda: R.containing(index.rows.select("doc_idx", F.concat_ws(" ", "terms").alias("text")), passages),
    ]
    try:
        for search in searches:
            for k in stages.BATCH:
                spark.conf.set(k, "1000000000")
            search()
            assert {k: int(spark.conf.get(k)) for k in stages.BATCH} == stages.BATCH
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_tasks_of_the_index_get_and_give_small_batches(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    kept, plain = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}, DataFrame.mapInArrow

    def watched(self, run, *rest, **more):
        def noted(batches):
            def seen():
                for batch in batches:
                    (tmp_path / uuid.uuid4().hex).write_text(f"in {batch.num_rows} {batch.nbytes}")
                    yield batch

            for batch in run(seen()):
                (tmp_path / uuid.uuid4().hex).write_text(f"out {batch.num_rows} {batch.nbytes}")
                yield batch

        return plain(self, noted, *rest, **more)

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    docs = spark.range(0, 1500, numPartitions=1).select(F.col("id").alias("doc_idx"), F.lit("").alias("title"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 1200).alias("abstract"))
    try:
        for k, v in zip(kept, ("10000", str(64 << 20)), strict=True):
            spark.conf.set(k, v)
        assert I.tokenised(docs).agg(F.count("*"), F.sum("dl")).first() == (1500, 1500 * 1200)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    notes = [x.read_text().split() for x in tmp_path.iterdir()]
    assert max(int(n) for way, _, n in notes if way == "in") < 5 << 20 and max(int(n) for way, n, _ in notes if way == "out") <= 256
