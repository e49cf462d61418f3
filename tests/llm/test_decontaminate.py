from __future__ import annotations

import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate

DOCS = "doc_id long, text string, words string, print string, item string, doc string"
ITEMS = "item_id long, text string, window string, words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)


def brute(docs, items, window=10):
    windows = {}
    for i, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for s in range(max(len(w) - window + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[s : s + window]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    left = spark.createDataFrame([(*d, "clash", "clash", None, "clash") for d in docs], DOCS)
    right = spark.createDataFrame([(*i, "clash", None) for i in items], ITEMS)
    return sorted((tuple(r) for r in decontaminate.decontaminated(left, right, **more).collect()), key=str)


def corpus(seed, vocabulary, n=150):
    rng = random.Random(seed)
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, some(rng.randint(10, 40))) for i in range(25)]
    docs = []
    for i in range(n):
        w = some(rng.randint(0, 120))
        for _ in range(i % 3):
            own = rng.choice(items)[1]
            s, k = rng.randrange(len(own)), rng.choice([5, 9, 10, 11, 30])
            at = rng.randint(0, len(w))
            w[at:at] = own[s : s + k]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)))
    return docs, [(i, " ".join(w)) for i, w in items]


@pytest.mark.parametrize("vocabulary", [[f"w{i}" for i in range(400)], ["a", "b", "é"], ["naïve", "ÉTÉ", "x1", "日本", "q"]])
def test_equals_all_windows(spark, vocabulary):
    docs, items = corpus(len(vocabulary), vocabulary)
    assert run(spark, docs, items) == brute(docs, items)


def test_short_items_nulls_and_repeats(spark):
    docs, items = corpus(5, [f"w{i}" for i in range(60)], 60)
    items += [(100, "w1"), (101, "w2 w3"), (102, "W4-w5 w6"), (103, ""), (104, None), (105, "... !!"), (None, items[0][1]), (7, "w8 w9 w10"), (7, items[3][1])]
    docs += [(None, items[0][1]), (None, None), (500, None), (501, ""), (502, "w1"), (3, docs[3][1]), (3, docs[3][1]), (3, items[1][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_nothing(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c"), (2, None)], []) == brute([(1, "a b c"), (2, None)], [])


def test_very_long_text_and_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 16)
    passage = " ".join(f"p{i}" for i in range(24))
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    docs = [(i, f"w{i} {passage} w{i + 1}") for i in range(1200)] + [(5000, long + " " + passage + " " + long), (5001, ("a " * 30_000) + "b")]
    items = [(1, passage), (2, passage + " tail"), (3, "a " * 12), (4, "w5 " + passage)]
    assert run(spark, docs, items) == brute(docs, items)


def test_no_python_in_the_plan(spark):
    df = decontaminate.decontaminated(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
