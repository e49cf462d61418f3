"""Personal data, mixing, language, quality, WARC packages and the pipeline on small inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, mixing, pii, quality, warc, zip_archive

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PII_TEXTS = [
    None, "", "a@b.c_d@e.f x@y z@@q.r a@b.c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.9", "4111 1111 1111 1111, 4111-1111-1111-11111 4111111111111112", "+1 (017) 555-7713 190.137.223.204 +12 + 3",
    "é🙂 a.b@c.de 🙂+44 20 7946 0958", "9" * 3000 + " " + "8 " * 2000, "a" * 20000 + "@" * 50, "4111 1111 1111 1111" * 3, "mail me: j@x.org, j@x.org",
]


def _found(spark, texts, model=None):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, s string")
    rows = pii.with_spans(df, model or pii.SpanModel()).collect()
    return {r.doc_id: [f"{k}:{x.start}:{x.end}" for k in pii.KINDS for x in r[f"base_{k}"]] for r in rows}


def test_base_spans(spark):
    rng = random.Random(0)
    made = ["".join(rng.choice("ab@.+- ()0123456789%_é") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts = PII_TEXTS + made
    assert _found(spark, texts) == {i: base(t) for i, t in enumerate(texts)}


def test_added_spans_and_redaction(spark):
    rng = random.Random(5)
    texts = [f"word call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} end" for _ in range(120)] + [f"order {rng.randint(10**12, 10**13)} of 20{i % 9}" for i in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = pii.fit(df, trees=3)
    docs = spark.createDataFrame([(1, "call (017) 555-7713 or +1 (017) 555-7713", 40, "x"), (2, None, None, "y"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars long, base_ip string")
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    spans = pii.with_spans(rows, model)
    assert all(len(r.base_phone) == (r.row.doc_id == 1) for r in spans.collect())
    out = {r.doc_id: r for r in pii.redact(spans, "row").collect()}
    assert "+1" not in out[1].text and out[1].text.endswith("[PHONE]") and out[1].n_chars == len(out[1].text) and out[1].base_ip == "x"
    assert out[2].text is None and out[3].text == "clean" and out[3].n_chars == 5
    assert pii.fit(spark.createDataFrame([], "doc_id long, text string")).least == {}


def test_added_formats_are_redacted_and_decoys_stay(spark):
    model = pii.fit(spark.createDataFrame([(i, f"plain text {i}") for i in range(50)], "doc_id long, text string"))
    assert set(model.least) == set(pii.GENERATORS)
    real = {
        "write to clara at example dot org today": "write to [EMAIL] today", "clara (at) example (dot) org": "[EMAIL]", "mail me at jürgen@exämple.de please": "mail me at [EMAIL] please",
        "host 2001:db8:85a3:0:0:8a2e:370:7334 down": "host [IP] down", "ping fe80::1ff:fe23:4567:890a now": "ping [IP] now",
        "call 020 7946 0958 now": "call [PHONE] now", "my phone is 415-555-2671 ok": "my phone is [PHONE] ok", "pay by card 4111.1111.1111.1111 please": "pay by card [CARD] please",
    }
    decoys = [
        "order 415-555-2671 shipped", "isbn 978-0-306-40615-7", "version 10.204.3001 out", "at 12:30:45:100 then", "mac 00:1a:2b:3c:4d:5e up", "arrived at noon dot then",
        "look at example dot com", "pop 12 345 678 people", "order 4111.1111.1111.1112", "4111 1111 1111 1112 no", 'token = "52c4f90819894045335504edb407ca',
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*real, *decoys])], "doc_id long, text string")
    out = pii.redact(pii.with_spans(docs.select("text", F.struct(*docs.columns).alias("row")), model), "row").orderBy("doc_id").collect()
    assert [r.text for r in out] == [*real.values(), *decoys]


def test_long_logs_take_time_by_their_length(spark):
    model = pii.SpanModel(["is_card"], [0.9], [1.0], dict.fromkeys(pii.GENERATORS, 0.5))  # takes every candidate
    lines = [f"{i} mail u{i}@ex.com é from 10.0.0.{i % 250} or 020 7946 {i % 9000 + 1000}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    out = pii.redact(pii.with_spans(docs.select("text", F.struct("doc_id", "text").alias("row")), model), "row").first()
    assert out.text == "\n".join(f"{i} mail [EMAIL] é from [IP] or [PHONE]" for i in range(20_000))


def test_personal_data_query(spark, tmp_path):
    texts = [*PII_TEXTS, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pii.op2_personal_data(spark, str(tmp_path)).collect()}
    expected = {i: base(t or "") for i, t in enumerate(texts)}
    assert rows.keys() == expected.keys()
    for i, listed in expected.items():
        assert [rows[i][f"n_{kind}"] for kind in pii.KINDS] == [sum(x.startswith(kind) for x in listed) for kind in pii.KINDS]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(rows[i].spans.split(",")) | {""}


def test_sainte_lague_equals_seat_by_seat(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 100, 1000):
        votes = [rng.choice([0.0, 1.0, 5.0, 5.0, rng.random() * 50]) for _ in range(12)]
        won = [0] * 12
        for _ in range(seats):
            best = max(range(12), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "key long, vote double, seats long")
        got = [r.quota for r in mixing.sainte_lague(df, "seats").orderBy("key").collect()]
        assert got == won or sorted(v / (2 * g + 1) for v, g in zip(votes, got, strict=True)) == sorted(v / (2 * g + 1) for v, g in zip(votes, won, strict=True))


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 31 == 0 else f"s{min(int(rng.expovariate(0.7)), 4)}", None if i % 17 == 0 else "w " * rng.randint(0, 60)) for i in range(400)]
    rows += [(None, "s0", "a b c"), (5, "s0", "dup dup"), (5, "s0", "dup dup")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.withColumn("size", mixing.word_count(F.col("text"))).withColumn("taken", F.lit("clash"))
    quota = mixing.quotas(sized, per_shard=50)
    out = mixing.mix(sized.drop("taken"), quota).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(sized.drop("taken"), mixing.quotas(sized, per_shard=50)).collect()))
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    size, target, taken = {}, {}, {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.source_size == sum(len((t or "").split()) for _, s, t in rows if s == r.source)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    order = sorted(size, key=lambda s: (s is None, s))
    free, weights = set(order), dict(zip(order, [5, 2, 1] * 9, strict=False))
    expected = {}
    while True:  # the excess over what stops is reshared until none is above
        left = 1.5 * sum(size.values()) - sum(expected.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * size[s]}
        if not above:
            break
        expected |= {s: 2.0 * size[s] for s in above}
        free -= above
    assert target == pytest.approx(expected | share)
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 1 for s in size)
    drawn = mixing.draw(mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row")), quota), "row").collect()
    for s in size:
        assert sum(len(r.text.split()) for r in drawn if r.source == s) == taken[s]
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(empty, mixing.quotas(empty)).count() == 0


def _labelled(spark, table="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{table}/documents.parquet")


def test_language_frequencies_count_all_texts(spark):
    rows = [(lang, f"{lang} text of {i} " + "é" * (i % 3)) for i in range(90) for lang in ("aa", "bb")[: 1 + i % 2]]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for r in language.frequencies(df).collect():
        own = [t for lang, t in rows if lang == r.lang]
        assert r.n == len(own) and (np.frombuffer(r.df, "<i8") == (language.profiles(own) > 0).sum(axis=0)).all()


def test_rows_without_an_id_are_spread_over_shards(spark):
    sized = spark.createDataFrame([(None, "s", i % 97) for i in range(2000)], "doc_id long, source string, size long")
    shards = mixing.quotas(sized, per_shard=100).collect()
    assert len(shards) > 10 and sum(r.words for r in shards) == sum(i % 97 for i in range(2000))
    taken = mixing.mix(sized, mixing.quotas(sized, per_shard=100)).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in taken)
    assert abs(sum(r.taken for r in taken) - taken[0].target) <= 0.03 * taken[0].target


def test_language(spark):
    docs = _labelled(spark)
    model = language.fit(docs, ~language.held_out(F.col("doc_id")), order=F.xxhash64("doc_id"))
    held = language.with_language(docs.where(language.held_out(F.col("doc_id"))), model)
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "z" * 200_000), (4, "é")], "doc_id long, text string")
    rows = language.with_language(odd.withColumn("score", F.lit("clash")), model).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in rows[:3]] == [("und", 0.0, True)] * 3
    assert all(r.lang_pred in model.language and 0 <= r.score <= 1 for r in rows[3:])
    none = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.with_language(odd, none).collect()} == {"und"}


def test_language_of_a_text_does_not_depend_on_its_batch():
    texts = ["der die das", "the of and", "x", "", None, "le la les"]
    whole = language.profiles(texts)
    assert all((whole[i] == language.profiles([t])[0]).all() for i, t in enumerate(texts))


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    rows = quality.with_quality(docs.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))), model).select("quality", "score").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean(np.array(good) >= 0.3) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000)], "doc_id long, text string")
    scores = [r.score for r in quality.with_quality(odd.withColumn("score", F.lit("clash")), model).collect()]
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    nothing = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.with_quality(odd, nothing).collect()} == {0.5}


def test_zip_directories():
    members = [("a", b"x" * 1000), ("dir/é", b""), ("c", bytes(range(256)) * 9)]
    for zip64 in (False, True):
        data = zip_archive.write_stored(members, zip64)
        read = lambda at, n, d=data: d[at : at + n]
        found = zip_archive.directory(read, len(data))
        assert list(found) == [n for n, _ in members]
        for name, body in members:
            at = zip_archive.data_offset(read, found[name])
            assert data[at : at + found[name].size] == body and found[name].crc == zlib.crc32(body)
        import io
        import zipfile

        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    with pytest.raises(ValueError):
        zip_archive.directory(lambda at, n: b"nothing"[at : at + n], 7)


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/é b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "x\r\n\r\ny" * 400), (None, "u", big), (7, "u", "z" * 300_000), (7, "u", "z" * 300_000)]
    out = warc.archive(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size long")).collect()
    assert len(out) == len(rows)
    for r in out:
        body = (next(h for p, _, h in rows if p == r.page_id) or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        assert r.record_type == ("response" if r.refers_to is None else "revisit") and (r.payload is None if r.refers_to else bytes(r.payload) == body)
    refers = {r.page_id: r.refers_to for r in out}
    assert refers[1] == 2 and refers[2] is None and refers[3] is None and refers[None] == 2 and refers[7] is None
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_pages_of_a_hot_payload_are_spread(spark, monkeypatch, most):
    """2,000 pages of one payload among others do not meet in one task, broadcast or not."""
    monkeypatch.setattr(warc, "HOT_ROWS", 100)
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", most)
    html = lambda i: "boilerplate " * 100 if i < 2000 else f"page {i % 2100} " * 200
    pages = spark.createDataFrame([(i, None, html(i)) for i in range(2200)] + [(None, None, html(0)), (None, None, html(2050)), (7000, None, "short"), (7001, None, "short")], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = warc.with_revisits(pages).select("page_id", "refers_to", F.octet_length("payload").alias("n"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(rows) == 2204
    refers = {r.page_id: r.refers_to for r in rows if r.page_id is not None}
    assert all(refers[i] == 1999 for i in range(1999)) and refers[1999] is None
    assert all(refers[i] is None for i in range(2000, 2200))
    assert refers[7000] is None and refers[7001] is None
    assert sorted((r.refers_to, r.n) for r in rows if r.page_id is None) == [(1999, 1200), (2050, 2000)]
    held = [r.task for r in rows if r.refers_to == 1999]
    assert max(held.count(t) for t in set(held)) < 1000


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = [(i, " ".join(random.Random(i % 40).choices(["the", "of", "and", "house", "river", f"n{i % 40}"], k=30)), "en", f"s{i % 3}", 0, i) for i in range(60)]
    rows += [(100, None, None, None, None, 1), (101, "12 34", "en", "s0", 5, 1), (102, "the house of a@b.org and the river of the house", "en", None, 47, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "pack_sequences":
            assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.collect()}
        if name == "language_id":
            assert kept == {*range(60), 102}
        if name == "near_dedup":
            assert kept == {*range(40), 102}
        if name == "personal_data":
            assert out.where("doc_id = 102").first().text == "the house of [EMAIL] and the river of the house"
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_spans_are_learnt_from_all_documents(spark, monkeypatch):
    class Given(Exception):
        pass

    def labelled(docs):
        raise Given(docs.count())

    monkeypatch.setattr(pii, "labelled", labelled)
    with pytest.raises(Given, match="^25000$"):
        pii.fit(spark.range(25_000).selectExpr("concat('plain text ', id) as text"))
