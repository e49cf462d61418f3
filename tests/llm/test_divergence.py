from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """Every term of every pair of sources, zero cells and all."""
    counts, total, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(found)
        total[lang].update(found)
        seen[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        v = len(kept)
        p = {}
        for s in [*sources, None]:
            own = total[lang] if s is None else counts[lang, s]
            n = sum(own[t] for t in kept)
            p[s] = {t: 1 + 1000000000 * (own[t] + 2) // (n + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(sorted(found)[:most])}
    return out


def audit(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in divergence.divergences(df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma7delta", "naïve", "ÉTÉ", "日本", "x", "İstanbul", "non breaking", "don't", "zeta_eta", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "B", "é", "", None, "c"]) if i % 3 else "hot"
        some = words[:20] if source == "a" else words[5:]
        rows.append((i, " ".join(rng.choices(some, k=rng.randint(0, 30))) if i % 17 else None, rng.choice(["en", "en", "fr", None]), source))
    return rows


@pytest.mark.parametrize("sizes", [None, (7, 2, 5)])
def test_equals_all_terms_of_all_pairs(spark, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("BLOCK_CELLS", "BLOCK_SOURCES", "PAIRS"), sizes, strict=True):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus(1)
    assert audit(spark, rows) == brute(rows)


def test_ties_repeats_and_sources_without_terms(spark):
    rows = [(1, "same words here", "en", "a")] * 12 + [(2, "same words here", "en", "b")] * 12 + [(3, "... 123", "en", "c"), (4, None, "en", "d"), (5, "rare", "fr", "a"), (6, "", "fr", "b"), (7, "alone", "de", "a")]
    assert audit(spark, rows) == brute(rows)
    assert audit(spark, rows, least_docs=1, top=2) == brute(rows, 1, 2)


def test_nothing_and_very_long_texts(spark):
    assert audit(spark, []) == set()
    rows = [(1, "ab cd " * 200_000 + "x" * 300_000, "en", "a"), (2, "ab", "en", "b")]
    assert audit(spark, rows, least_docs=1) == brute(rows, 1)


def test_tally_of_two_blocks_counts_pairs_across_only():
    rng = np.random.default_rng(2)
    key = rng.permutation(60)[:40]
    source, term = key % 6, key // 6
    n = rng.integers(1, 4, 40)
    got = divergence.tally("en", source, (source >= 3).astype(np.int8), term, n, same=False).to_pylist()
    held = {(int(t), int(s)): int(c) for t, s, c in zip(term, source, n, strict=True)}
    want = Counter((a, b, held[t, a], held[t, b]) for t in set(term.tolist()) for a in range(3) for b in range(3, 6) if (t, a) in held and (t, b) in held)
    assert {(r["a"], r["b"], r["ca"], r["cb"]): r["k"] for r in got} == dict(want)
