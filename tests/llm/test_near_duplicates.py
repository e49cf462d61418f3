from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tessera.llm import near_duplicates as N
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, k, percent=80):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [None, "", "  \n", "One", "one", "one two", "ONE TWO", "word " * 5000, "word " * 4000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own))
    crowd = [rng.choice(words) for _ in range(60)]
    for n in range(90):  # a large group in which not all link
        own = list(crowd)
        for _ in range(n % 9):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append(" ".join(own))
    return list(enumerate(docs))


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k):
    docs = corpus()
    rows = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text"), shingle=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_ids_may_be_strings(spark):
    docs = [(f"doc-{i}", t) for i, t in corpus(4)]
    rows = N.near_duplicates(spark.createDataFrame(docs, "doc_id string, text string"), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, 2)


def test_without_duplicates_keeps_one_of_each(spark):
    docs = corpus(2)[:60] + [(None, "one two"), (7, "word " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, kept long, id string")
    rows = N.without_duplicates(df, shingle=5).collect()
    expected = sorted(i for i, (_, c) in brute([d for d in docs if d[0] is not None], 5).items() if i == c)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == expected
    assert sum(r.doc_id is None for r in rows) == 1 and rows[0].asDict().keys() == {"doc_id", "text", "kept", "id"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0 and N.without_duplicates(empty).count() == 0


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 40).astype(np.uint64)) for _ in range(12)]
    got = N.common_counts(sets[:5], sets[5:], columns=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 100), (7, 7)]
    rows = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert rows == {i: 0 for i in range(61)} | {100: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
