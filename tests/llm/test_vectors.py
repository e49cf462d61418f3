from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import top_k, vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def table(spark, x, extra=()):
    rows = [(i, [float(y) for y in v] if v is not None else None, 0, "clash") for i, v in enumerate(x)]
    return spark.createDataFrame(rows + [(i, v, None, None) for i, v in extra], SCHEMA)


ODD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [0.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [None] + [1.0] * 15), (9007, [1.0, 0.0]), (9100, None)]


def data(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(100, 180):  # noisy copies about the threshold
        x[i] = x[i - 100] + rng.normal(scale=0.3 * (i % 5) / 2, size=d)
    x[200:240] = x[3]
    return x.astype(np.float32)


def test_links_recall_and_precision(spark):
    x = data()
    rows = {r.vec_id: r for r in vector_links.vector_links(table(spark, x, ODD)).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    found = np.array([rows[i].n_links for i in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.98 * near.sum()
    assert all(rows[i].component_id == 3 for i in range(200, 240))
    assert all(rows[i].n_links == 0 and rows[i].kept and rows[i].component_id == i for i, _ in ODD)


def shaped(kind, n=1200, d=64, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if kind == "common":  # a mean cosine of 0.85
        x = x * (0.15 / d) ** 0.5 + 0.85**0.5 * np.eye(d)[0]
    elif kind == "clustered":
        x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.33 * x
    elif kind == "low_rank":
        x = x[:, :5] @ rng.normal(size=(5, d))
    else:
        x[n // 2 :] = x[: n - n // 2] + rng.uniform(0.2, 0.6, (n - n // 2, 1)) * x[n // 2 :]
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["isotropic", "common", "clustered", "low_rank"])
def test_links_are_found_whatever_the_shape(spark, kind):
    x = shaped(kind)
    rows = {r.vec_id: r.n_links for r in vector_links.vector_links(table(spark, x)).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.9).sum(axis=1) - 1
    found = np.array([rows[i] for i in range(len(x))])
    assert near.sum() > 300 and (found <= near).all() and found.sum() >= 0.98 * near.sum()


def test_fit_without_pairs_in_the_sample():
    y = shaped("common", 200)
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    one, other = vector_links.threshold_pairs(y.astype(np.float64), 0.999)
    assert len(one) > 1000 and np.allclose((one * other).sum(axis=1), 0.999)
    coding = vector_links.fitted({64: y.astype(np.float64)}, 5_000, 0.97, 0.98)
    assert coding.recall >= 0.98 and coding.radius <= coding.run * coding.tables
    assert vector_links.fitted({1: np.zeros((0, 1))}, 0, 0.9, 0.98).tables >= 1


def test_links_within_each_length(spark):
    one, two, rare = data(5), data(6, d=8), np.array([[1.0, 2.0], [2.0, 4.0], [2.0, -1.0], [1.0, 2.1]])
    rows = [*one, *two, *rare, np.append(one[0], [0.0] * 3), one[0][:2]]
    found = [r.n_links for r in sorted(vector_links.vector_links(table(spark, rows)).collect(), key=lambda r: r.vec_id)]
    for x, at in ((one, 0), (two, 300)):
        y = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        near = (y @ y.T >= 0.9).sum(axis=1) - 1
        own = np.array(found[at : at + 300])
        assert (own <= near).all() and own.sum() >= 0.98 * near.sum()
    assert found[600:604] == [2, 2, 0, 2] and found[604] == 0


def test_links_of_nothing(spark):
    assert vector_links.vector_links(table(spark, [])).count() == 0
    one = vector_links.vector_links(table(spark, [None, None])).collect()
    assert [r.n_links for r in one] == [0, 0]


def brute(x, ids, queries, k):
    v = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    out = set()
    for q in queries:
        s = v @ v[ids.index(q)]
        best = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out |= {(q, n + 1, ids[i], int(s[i])) for n, i in enumerate(best)}
    return out


def test_top_k_is_exact(spark):
    for scale in (1.0, np.linspace(0.05, 3, 300)[:, None]):
        x = (data(1) * scale).astype(np.float32)
        df = top_k.top_k(table(spark, x, ODD), F.col("vec_id") % 20 == 0, bucket_rows=64, query_rows=8)
        got = {tuple(r) for r in df.where("vec_id < 9000 and query_id < 9000").collect()}
        assert got == brute(x, list(range(300)), range(0, 300, 20), 10)


def test_top_k_of_few(spark):
    assert top_k.top_k(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    rows = top_k.top_k(table(spark, np.eye(3, 16)), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_repeated_ids_are_one_candidate(spark):
    x = data(5)[:60]
    df = table(spark, x).unionByName(table(spark, x))
    got = {tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 20 == 0, bucket_rows=16, query_rows=2).collect()}
    assert got == brute(x, list(range(60)), range(0, 60, 20), 10)


def test_queries_of_like_thresholds_share_blocks(spark):
    bounds = [None if i % 3 == 0 else float(i) for i in range(1, 301)]
    asked = spark.createDataFrame([(i, 4, 1.0, b) for i, b in enumerate(bounds)], "id long, d int, length double, bound double")
    longest = spark.createDataFrame([(4, 300.0)], "d int, longest double")
    rows = top_k.with_blocks(asked, longest, 50).collect()
    assert sorted(r.id for r in rows) == list(range(300))
    blocks = {b: [r.bound or 0.0 for r in rows if r.block == b] for b in {r.block for r in rows}}
    assert sorted(blocks) == list(range(6)) and max(map(len, blocks.values())) < 100
    for b in range(5):  # up to a level, blocks are in the order of what they still need
        assert max(blocks[b]) <= min(blocks[b + 1]) + 300 / top_k.LEVELS


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    p = np.floor(1024 * rng.normal(size=(500, 8))).astype(np.int64)
    q = p[:20] + rng.integers(-40, 40, (20, 8))
    full = q @ p.T
    bound = np.sort(full, axis=1)[:, -5].astype(np.float64)
    found = top_k.search_bucket(np.arange(1000, 1020), q, bound, np.arange(500), p, 5)
    for i in range(20):
        best = sorted(range(500), key=lambda j: (-full[i, j], j))[:5]
        assert [b for a, b, _ in found if a == i] == best
