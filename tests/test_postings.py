from __future__ import annotations

import uuid

import numpy as np
import pytest

from tessera.operators import index as I
from tessera.operators import postings as PO
from tessera.operators import search as R

WORDS = [f"w{i}" for i in range(60)]


def documents(spark, n, first=0, seed=0):
    """Documents of common and rare words; every ninth is empty, and runs of alike ones tie."""
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(WORDS, size=int(rng.integers(1, 40)), p=weight / weight.sum())) for _ in range(n)]
    rows = [(first + i, None, None if i % 9 == 4 else "w59 w58" if 70 <= i < 90 else t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_idx long, title string, abstract string")


def queries(spark):
    texts = ["w0 w1", "w59", "w59 w58 w58", "w40 w41 w42 w0", "unknown", "", None, " ".join(WORDS), "w57 unknown w0 w0 w0"]
    return spark.createDataFrame(list(enumerate(texts)), "query_idx long, text string")


def fresh(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


def near(rows):
    return [(r.query_idx, r["rank"], r.doc_idx, pytest.approx(r.bm25, abs=1e-9)) for r in sorted(rows, key=lambda r: (r.query_idx, r["rank"]))]


def plain(rows):
    return [(r.query_idx, r["rank"], r.doc_idx, r.bm25) for r in sorted(rows, key=lambda r: (r.query_idx, r["rank"]))]


@pytest.fixture(scope="module")
def index(spark):
    return I.build_index(documents(spark, 600), fresh(spark))


@pytest.fixture(scope="module")
def postings(index):
    return PO.postings_of(index, 16)


def test_blocks_hold_every_posting_and_its_maximum(index, postings):
    want = {(r.doc_idx, r.term): (r.tf, r.dl) for r in index.postings.collect()}
    blocks = postings.rows.collect()
    assert {(d, x.term): (t, n) for x in blocks for d, t, n in zip(x.docs, x.tfs, x.dls, strict=True)} == want
    assert len({(x.term, x.block) for x in blocks}) == len(blocks) and all(d // 16 == x.block for x in blocks for d in x.docs) and all(x.n == len(x.docs) for x in blocks)
    impact = lambda tf, dl, k1, b, avgdl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    for k1, b, avgdl in [(1.5, 0.75, 17.0), (0.1, 1.0, 3.0), (9.0, 0.0, 17.0)]:
        for x in blocks:
            best = max(impact(t, n, k1, b, avgdl) for t, n in zip(x.tfs, x.dls, strict=True))
            assert max(impact(f.tf, f.dl, k1, b, avgdl) for f in x.front) == best


@pytest.mark.parametrize(("k", "k1", "b"), [(1, 1.5, 0.75), (10, 1.5, 0.75), (10, 0.4, 0.2), (1000, 1.5, 0.75)])
def test_search_by_blocks_is_the_scan(spark, index, postings, k, k1, b):
    scan = R.bm25_search(index, queries(spark), k, k1, b).collect()
    assert plain(PO.bm25_block_search(postings, queries(spark), k, k1, b).collect()) == near(scan)


def test_blocks_below_the_floor_are_not_scored(spark):
    """A rare word beside a common one: only blocks with the rare word can hold one of the best."""
    texts = [" ".join(["the"] * (1 + i % 7) + ["filler"] * (i % 5)) + (" rare" if i % 50 == 3 else "") for i in range(800)]
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_idx long, title string, abstract string")
    index = I.build_index(docs, fresh(spark))
    asked = spark.createDataFrame([(0, "the rare"), (1, "rare"), (2, "the")], "query_idx long, text string")
    found = PO.block_search(PO.postings_of(index, 16), asked, 5)
    blocks, matched = found.blocks.collect(), found.matched.collect()
    assert plain(matched) == near(R.bm25_search(index, asked, 5).collect())
    own = [x for x in blocks if x.query_idx == 0]
    assert len(own) == 50 and sum(x.postings for x in own) == 816
    assert sum(x.scored for x in own) <= 16 and sum(x.postings for x in own if x.scored) <= 16 * 17
    floor = {r.query_idx: r.bm25 for r in matched if r["rank"] == 5}
    assert all(x.bound < floor[x.query_idx] for x in blocks if not x.scored)
    assert all(x.bound >= r.bm25 - 1e-9 for r in matched for x in blocks if (x.query_idx, x.block) == (r.query_idx, r.doc_idx // 16))


def test_postings_are_made_once_and_appended_to(spark):
    path = fresh(spark)
    I.append(documents(spark, 90), path)
    PO.postings_of(I.read(spark, path), 16)
    I.append(documents(spark, 40, first=90, seed=1), path)
    two = I.read(spark, path)
    made = PO.postings_of(two, 16)
    assert len(PO._posted(two)) == 2 and made.rows.inputFiles() != []
    before = sorted(made.rows.inputFiles())
    assert sorted(PO.postings_of(two, 16).rows.inputFiles()) == before
    scan = R.bm25_search(two, queries(spark)).collect()
    assert plain(PO.bm25_block_search(made, queries(spark)).collect()) == near(scan)
    I.append(documents(spark, 5, first=130, seed=2), path)
    with pytest.raises(ValueError, match="different sizes"):
        PO.postings_of(I.read(spark, path), 32)


def test_postings_of_queries(spark, index, postings):
    got = [(r.query_idx, r.doc_idx, r.term, r.times, r.tf) for r in PO.query_postings(postings, queries(spark)).collect()]
    times = {(r.query_idx, r.term): r.times for r in R.query_terms(queries(spark)).collect()}
    want = [(q, r.doc_idx, r.term, n, r.tf) for r in index.postings.collect() for (q, term), n in times.items() if term == r.term]
    assert sorted(got) == sorted(want) and (8, "w0") in times and times[8, "w0"] == 3


def test_few_folders_are_read(spark, postings):
    terms = PO._weighted(postings.index, queries(spark).where("query_idx = 1"))
    plan = PO._met(postings, terms, "front")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "docs" not in plan.split("ReadSchema")[1]


def test_empty_postings(spark):
    made = PO.postings_of(I.build_index(documents(spark, 0), fresh(spark)))
    assert made.rows.count() == PO.bm25_block_search(made, queries(spark)).count() == 0
    one = PO.postings_of(I.build_index(documents(spark, 3), fresh(spark)))
    assert PO.bm25_block_search(one, queries(spark).limit(0)).count() == 0


def test_documents_of_a_query_are_counted_by_block(spark):
    from tessera.operators import postings as PO
    from tessera.operators.index import build_index

    texts = [(i, "", " ".join(w for w, n in (("all", 1), ("two", 2), ("three", 3)) if i % n == 0)) for i in range(1300)]
    index = build_index(spark.createDataFrame(texts, "doc_idx long, title string, abstract string"))
    queries = spark.createDataFrame([(0, "two three"), (1, "all two all"), (2, "none")], "query_idx long, text string")
    found = PO.query_documents(PO.postings_of(index), queries).orderBy("query_idx").collect()
    two, three = set(range(0, 1300, 2)), set(range(0, 1300, 3))
    assert [tuple(r) for r in found] == [(0, len(two | three), len(two) + len(three)), (1, 1300, 1300 + len(two))]
