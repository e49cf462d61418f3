from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tessera.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"
ODD = [(901, None, 0), (902, [], 0), (903, [float("nan")] * 16, 0), (904, [float("inf")] + [0.0] * 15, 1), (905, [None] + [0.0] * 15, 1), (906, [0.5, 0.25], 1)]


def brute(rows, parts=8, entries=16, rounds=6):
    """All distances in full, row by row, in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    whole = [[int(np.floor(4096.0 * float(x))) for x in r[1]] for r in rows]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for v in whole] for p in range(parts)]
    books = [[c[i] for i in range(min(entries, len(rows)))] for c in cut]
    choose = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(choose(x, books[p])[1], []).append(x)
            for i, own in groups.items():
                books[p][i] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    found = [[choose(cut[p][i], books[p]) for p in range(parts)] for i in range(len(rows))]
    print_ = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    label = {}
    for r, e in zip(rows, errors, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{i:02x}" for _, i in f), e, label[r[2]], print_) for r, f, e in zip(rows, found, errors, strict=True))


def table(spark, rows):
    return spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, l, "clash", None) for i, v, l in rows], SCHEMA)


def codes(spark, rows, **more):
    return sorted(tuple(r) for r in vector_codes.vector_codes(table(spark, rows), **more).collect())


@pytest.mark.parametrize("kind", ["normal", "ties", "common"])
def test_codes_equal_full_distances(spark, kind):
    rng = np.random.default_rng(7)
    x = {"normal": rng.normal(size=(160, 16)), "ties": rng.integers(-2, 3, (160, 16)) / 4, "common": 1 + rng.normal(scale=0.05, size=(160, 16))}[kind].astype(np.float32)
    rows = [(int(i), v, None if i % 7 == 0 else int(i) % 3) for i, v in zip(rng.permutation(160), x, strict=True)]
    got = codes(spark, rows + ODD)
    assert got == brute(rows)


def test_repeated_rows_and_few_rows(spark):
    v = np.linspace(-1, 1, 16)
    rows = [(1, v, 0), (1, v, 0), (2, -v, None), (3, v, 0)]
    assert codes(spark, rows) == brute(rows)
    assert codes(spark, [], rounds=2) == [] and codes(spark, ODD) == []


def test_each_length_has_its_own_codebooks(spark):
    rng = np.random.default_rng(3)
    one, two = [(i, rng.normal(size=16).astype(np.float32), 0) for i in range(30)], [(100 + i, rng.normal(size=8).astype(np.float32), 1) for i in range(30)]
    assert codes(spark, one + two) == sorted(brute(one) + brute(two))


def test_hot_label_is_spread(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32), 0 if i % 3 else None) for i in range(900)]
    got = codes(spark, rows, rounds=1)
    total = {k: sum(e for i, _, e, _, _ in got if (i % 3 == 0) == k) for k in (True, False)}
    assert len(got) == 900 and all(r[3] == total[r[0] % 3 == 0] for r in got)


def test_partial_distances_equal_full_ones():
    rng = np.random.default_rng(5)
    for width in (1, 3, 8):
        parts, book = rng.integers(-9, 9, (500, width)), rng.integers(-9, 9, (16, width))
        full = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        best, distance = vector_codes.nearest(parts, book)
        assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="not below"):
        codes(spark, [(1, np.full(8, 4e6), 0)])
