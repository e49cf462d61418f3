from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, token_count
from tessera.llm.common import slices, tokenizer_path
from tessera.llm.transducer import Transducer

TEXTS = [
    None, "", " \n\t", "Hello World!! it's 'sky '''s we've they'RE 'll'd I'M don't", "a" * 5000, "ab " * 3000, "ñandú ÀÉ ΣΑΣ ß İstanbul", "日本語 한국어 <|endoftext|>x<|startoftext|>",
    "é à x　y ½²³ 123 4.5", "🙂👍🏽 zero​width", "__a_b--c''d", "<|endoftext|>", "same text", "same text", "x" * 100_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [7, 64, 1024])
def test_transducer_equals_library(library, chunk):
    rng = random.Random(chunk)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["".join(rng.choice(rng.choice([letters, "eth ", "aeinstr'", "0123 .,!?'-", letters.upper(), "éèñöß "])) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    machine = Transducer(tokenizer_path(), chunk=chunk)
    texts = TEXTS[:-1] + made
    tokens, ends = machine.encode(texts)
    starts = np.concatenate([[0], ends[:-1]])
    expected = [ids(library, t) for t in texts]
    assert [tokens[a:b].tolist() for a, b in zip(starts, ends, strict=True)] == expected
    assert machine.count(texts).tolist() == [len(x) for x in expected]


def test_transducer_on_long_words_special_strings_and_restarts(library):
    """Words that span many chunks and blocks, texts of special strings, and machines that start afresh amid a word."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 7777, "=" * 999 + "ab" * 3000, "".join(rng.choices(letters, k=6000)), "日本" * 2000, "".join(rng.choices("ab", k=5000)), "<|endoftext|>" * 500 + "x" + "<|startoftext|>", "of the quarry " * 2000]
    expected = [ids(library, t) for t in texts]
    for chunk, block, most in ((16, 64, 10), (32, 1024, 300), (64, 4096, 10**6)):
        machine = Transducer(tokenizer_path(), max_transitions=most, chunk=chunk, block=block)
        tokens, ends = machine.encode(texts)
        starts = np.concatenate([[0], ends[:-1]])
        assert [tokens[a:b].tolist() for a, b in zip(starts, ends, strict=True)] == expected
        assert machine.count(texts).tolist() == [len(x) for x in expected]
        assert machine.filled <= most + block


def test_transducer_takes_megabytes_without_blanks_and_many_markers():
    machine = Transducer(tokenizer_path())
    assert machine.count(["a" * 2_000_000, "<|endoftext|>" * 200_000]).tolist() == [250_001, 200_000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_transducer_on_any_text(texts):
    machine = _shared()
    assert machine.count(texts).tolist() == [len(ids(machine.library, t)) for t in texts]


_MACHINE = []


def _shared():
    if not _MACHINE:
        _MACHINE.append(Transducer(tokenizer_path(), max_transitions=5000))
    return _MACHINE[0]


def test_token_counts_keep_columns(spark, library):
    rows = [(i, t, "kept", -1) for i, t in enumerate(TEXTS)]
    df = token_count.with_token_counts(spark.createDataFrame(rows, "doc_id long, text string, other string, n_tokens long"))
    assert df.columns == ["doc_id", "text", "other", "n_tokens"]
    assert {r.doc_id: r.n_tokens for r in df.collect()} == {i: len(ids(library, t)) for i, t in enumerate(TEXTS)}
    assert token_count.with_token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def check_packing(rows, texts, library, capacity):
    places = {}
    for r in rows:
        own = np.array([*ids(library, texts[r.doc_id]), 1], "<u4")[r.start : r.start + r.length]
        assert len(own) == r.length <= capacity and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.start == capacity * r.piece
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_round_trip(spark, library):
    rng = random.Random(2)
    texts = dict(enumerate([*TEXTS, *[" ".join(rng.choice(["of", "the", "stone", "quarry"]) for _ in range(rng.randint(0, 300))) for _ in range(300)]]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = packing.pieces(docs, capacity=512)
    rows = packing.pack(items, 512, per_partition=40).collect()
    assert {(r.doc_id, r.piece) for r in rows} == {(d, k) for d, t in texts.items() for k in range(-(-(len(ids(library, t)) + 1) // 512))}
    used = check_packing(rows, texts, library, 512)
    total = sum(len(ids(library, t)) + 1 for t in texts.values())
    assert used <= -(-total // 512) + 2


def test_packing_of_nothing_and_of_repeats(spark):
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, 0, 0, 3, 9), (5, 0, 0, 3, 9), (5, 0, 0, 3, 9)], schema)).collect()
    assert sorted(r.offset for r in rows) == [0, 3, 6]


def test_sequences_of_many_repeats_and_null_ids(spark):
    n = 100_000
    items = spark.range(n).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "if(id % 2 = 0, 4000L, 90L) as length", "9L as ids_crc32")
    out = packing.pack(items)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count(F.lit(1)).alias("rows"))
    assert out.count() == n
    assert per.where("tokens > 4096 or end <> tokens or places <> rows").count() == 0
    assert per.count() < n // 2 * 1.02


def test_op1_and_op10_queries(spark, library, tmp_path):
    texts = {1: "Hello World", 2: None, 3: "", 4: "quarry stone " * 3000, 5: "<|endoftext|>"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = packing.op1_best_fit_packing(spark, f"file://{tmp_path}")
    assert dict(out.dtypes) | {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"} == dict(out.dtypes)
    check_packing(out.collect(), texts, library, 4096)
    counts = token_count.op10_token_counts(spark, f"file://{tmp_path}")
    assert counts.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    expected = {d: (len((t or "").encode()), n := len(ids(library, t)), n > 2048) for d, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts.collect()} == expected


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_bound_and_fit(sizes):
    x = np.array(sorted(sizes, reverse=True))
    bins, offsets = packing.best_fit_decreasing(x, 100)
    fill = np.bincount(bins, x)
    bound = packing.lower_bound(x, 100)
    assert fill.max() <= 100 and -(-int(x.sum()) // 100) <= bound <= len(fill)
    assert bound >= (x > 50).sum()


def test_slices():
    assert [(s.start, s.stop) for s in slices([5, 5, 20, 1, 1], 10)] == [(0, 2), (2, 3), (3, 5)]
    assert list(slices([], 3)) == []
