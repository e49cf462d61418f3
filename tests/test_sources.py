from __future__ import annotations

import hashlib
import io
import json
import tarfile
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import archives as AR
from tessera.sources import articles as A
from tessera.sources import corpus as C
from tessera.sources import embedding_cache as EC
from tessera.streaming import incremental

NXML = """<!DOCTYPE article [<!ENTITY x "y">]><article article-type="research-article"><front><article-meta><article-id pub-id-type="pmid">7</article-id>
<article-id pub-id-type="pmc">PMC12</article-id><title-group><article-title>A <i>bold</i> title&nbsp;x</article-title></title-group>
<pub-date pub-type="ppub"><year>2001</year></pub-date><pub-date pub-type="epub"><year>2000</year><month>2</month><day>31</day></pub-date>
<abstract><p>one <b>two</b></p></abstract><abstract abstract-type="graphical"><p>no</p></abstract></article-meta></front></article>"""


def test_qrels(spark):
    lines = spark.createDataFrame([(0, "1 0 PMC5 1"), (1, ""), (2, "1 0 5 2")], "line_no long, value string")
    assert [tuple(r) for r in A.parse_trec_qrels(lines, 2014).collect()] == [("2014-1", "5", 2)]
    bad = spark.createDataFrame([(0, "1 0 PMC5 1 9")], "line_no long, value string")
    with pytest.raises(Exception, match="not a judgment"):
        A.parse_trec_qrels(bad, 2014).collect()
    with pytest.raises(Exception, match="not a judgment"):
        A.parse_trec_qrels(spark.createDataFrame([(0, "1 0 PMC5 +1")], "line_no long, value string"), 2014).collect()
    assert A.parse_trec_qrels(spark.createDataFrame([(0, "1 0 PMC5 -1")], "line_no long, value string"), 2014).first().grade == -1


def test_topics(spark):
    text = '<topics><topic number="3" type=" Diagnosis "><summary>a\n b</summary></topic><topic number="4" type="odd"><summary>c</summary></topic></topics>'
    rows = A.parse_topics(spark.createDataFrame([(text,)], "value string"), 2015).orderBy("qid").collect()
    assert [(r.qid, r.type, r.column, r.summary) for r in rows] == [("2015-3", "diagnosis", "diagnosis_test", "a b"), ("2015-4", "odd", None, "c")]
    with pytest.raises(Exception, match="without summary"):
        A.parse_topics(spark.createDataFrame([('<topics><topic number="3"></topic></topics>',)], "value string"), 2015).collect()


def test_articles(spark):
    files = spark.createDataFrame([("x/PMC99.nxml", NXML), ("x/other.nxml", NXML), ("x/bad.xml", "<a")], "path string, text string")
    rows = {r["_id"]: r for r in A.parse_articles(files).collect()}
    assert set(rows) == {"99", "12"}
    assert rows["99"].title == "A bold title x" and rows["99"].abstract == "one two" and rows["99"].pub_date == "2000-02-01" and rows["99"].pmid == "7"


def test_publication_types(spark):
    text = "<S><PubmedArticle><MedlineCitation><PMID Version='1'>5</PMID><Article><PublicationTypeList><PublicationType UI='a'>Review</PublicationType><PublicationType UI='b'> Letter </PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle></S>"
    row = A.parse_publication_types(spark.createDataFrame([(text,)], "value string")).first()
    assert (row.pmid, row.types) == ("5", ["Review", "Letter"])


def test_first_seen_and_fetch(spark):
    rows = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a"), ("2", 3, "c")], "_id string, at long, pmid string")
    assert {r.pmid for r in A.first_seen(rows, "at").collect()} == {"a", "c"}
    assert [r.pmid for r in A.still_to_fetch(rows, rows.where("pmid = 'a'")).orderBy("pmid").collect()] == ["b", "c"]


def test_stream_of_articles(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"_id": "1", "title": "Cochrane", "abstract": ""}\n{"_id": "2", "title": "x", "abstract": "cohort"}\n')
    query = incremental.write_scored(incremental.article_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"))
    query.awaitTermination(60)
    rows = spark.read.json(str(tmp_path / "out")).orderBy("_id").collect()
    assert [(r.evidence_level, r.evidence_weight) for r in rows] == [(1, 1.0), (3, 0.65)]


def test_clean_xml(spark):
    cases = {
        "<!DOCTYPE a>x": "x", '<!DOCTYPE a PUBLIC "p>q" "s">x': "x", '<!DOCTYPE a SYSTEM "s" [<!ENTITY b "]>"> <!-- it\'s ] --> ] >x': "x", "a&nbsp;b&amp;c&#65;&#x41;&lt;": "a b&amp;c&#65;&#x41;&lt;",
        "&ampx;1 & 2": " 1 & 2", "": "", "<!DOCTYPE a [" + "<!ENTITY e 'v'>" * 3000 + "]>y": "y",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", A.clean_xml(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in rows} == cases


def _file(meta: str) -> str:
    return f"<article><front><article-meta><article-id pub-id-type='pmc'>PMC5</article-id>{meta}</article-meta></front></article>"


def test_sections_titles_and_dates_of_articles(spark):
    metas = {
        "1": "<title-group><article-title>Water H<sub>2</sub>O</article-title></title-group><abstract><sec><title>Aims</title><p>one</p><p>two</p></sec><list><list-item>a</list-item><list-item>b</list-item></list></abstract>",
        "2": "<related-article><article-title>Other</article-title></related-article><pub-date pub-type='epub'><year>n.d.</year></pub-date><pub-date pub-type='ppub'><year>1999</year><month>Apr</month></pub-date>",
        "3": "<pub-date date-type='collection'><year>2004</year><month>2</month><day>3</day></pub-date><abstract abstract-type='toc'>x</abstract>",
    }
    rows = {r["_id"]: r for r in A.parse_articles(spark.createDataFrame([(f"d/PMC{k}.nxml", _file(m)) for k, m in metas.items()], "path string, text string")).collect()}
    assert (rows["1"].title, rows["1"].abstract, rows["1"].pub_date) == ("Water H 2 O", "Aims one two a b", None)
    assert (rows["2"].title, rows["2"].pub_date) == ("", "1999-01-01")
    assert (rows["3"].abstract, rows["3"].pub_date) == ("", "2004-02-03")


def test_archives_of_any_compression(spark, tmp_path):
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz"), ("c.tar.bz2", "w:bz2"), ("d.tgz", "w:gz"), ("e.tar.xz", "w:xz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for k in range(3):
                body = _file(f"<abstract>{name} {k}</abstract>").encode() + (b"\xff" if k == 2 else b"")
                info = tarfile.TarInfo(f"x/PMC{k}{name[0]}.nxml")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
            tar.addfile(tarfile.TarInfo("x/readme.txt"), io.BytesIO(b""))
    rows = AR.article_files(spark, str(tmp_path)).collect()
    assert len(rows) == 15 and {r.path.rpartition("!")[2] for r in rows} == {f"x/PMC{k}{c}.nxml" for k in range(3) for c in "abcde"}
    assert A.read_articles(spark, [str(tmp_path)]).count() == 10  # what follows a root element is no article


def _pack(path, mode, files, **more):
    with tarfile.open(path, mode, **more) as tar:
        for name, body in files:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    inner = tmp_path / "inner"
    _pack(inner, "w", [("no.nxml", b"x" * 700)])
    files = [(f"d/{'long' * 40 if k % 7 == 0 else 'x'}/é {k}.nxml", f"text {k} ".encode() * (k % 50)) for k in range(400)]
    files[100:100] = [("nested.xml", inner.read_bytes()), ("notes.txt", b"z" * 5000), ("empty.XML", b"")]
    want = [(n, b.decode()) for n, b in files if not n.endswith("txt")]
    for name, form in (("a b%20c.tar", tarfile.GNU_FORMAT), ("p.TAR", tarfile.PAX_FORMAT)):
        _pack(tmp_path / name, "w", files, format=form, pax_headers={"comment": "for all"} if form == tarfile.PAX_FORMAT else None)
        ranges = list(AR.archive_ranges(str(tmp_path / name), 4096))
        assert len(ranges) > 20 and all(a[2] == b[1] for a, b in zip(ranges, ranges[1:]))
        assert all(r[4] == ({"comment": "for all"} if form == tarfile.PAX_FORMAT else {}) for r in ranges[1:])
        own = AR.archive_files(spark.createDataFrame([(f"file:{tmp_path}/{name}",)], "path string"), 4096)
        rows = sorted((r.member, r.path.partition("!")[2], r.text) for r in own.collect())
        assert rows == [(i, n, t) for i, (n, t) in enumerate(want)]
        assert own.select(F.spark_partition_id()).distinct().count() > 1
        whole = AR.archive_files(spark.createDataFrame([(str(tmp_path / name),)], "path string"))
        assert {(r.member, r.text) for r in whole.collect()} == {(m, t) for m, _, t in rows}


@pytest.mark.parametrize("packed", [False, True])
def test_archives_written_are_read_back(spark, tmp_path, packed):
    rows = [(f"d {k}/é{k}.xml", None if k == 7 else f"täxt {k}\n" * k) for k in range(40)] + [("d 1/é1.xml", "again")]
    files = spark.createDataFrame(rows, "path string, text string").repartition(3)
    made = AR.write_archives(files, f"file://{tmp_path}/a b", packed)
    assert made.count() == 3 and all(r.path.endswith(".tar.gz" if packed else ".tar") for r in made.collect())
    assert sorted((r.path.partition("!")[2], r.text) for r in AR.archive_files(made, 2048).collect()) == sorted((p, t or "") for p, t in rows)
    none = AR.write_archives(files.limit(0), f"file://{tmp_path}/none", packed)
    assert AR.archive_files(none).count() == 0


def test_damaged_archives_are_errors(spark, tmp_path):
    files = [(f"{k}.nxml", b"abc" * 500) for k in range(20)]
    _pack(tmp_path / "whole.tar", "w", files)
    whole = (tmp_path / "whole.tar").read_bytes()
    one = 512 + 1536
    cases = {"cut.tar": whole[: 7 * one + 900], "header.tar": whole[: 7 * one + 100], "noise.tar": whole[: 7 * one] + b"noise" * 200 + whole[7 * one + 1000 :], "none.tar": b"", "wrong.tar": b"no archive" * 100}
    for name, body in cases.items():
        (tmp_path / name).write_bytes(body)
        with pytest.raises(Exception, match="ReadError"):
            AR.archive_files(spark.createDataFrame([(str(tmp_path / name),)], "path string"), 4096).collect()
    (tmp_path / "open.tar").write_bytes(whole[: 20 * one])  # without the empty blocks at the end, as some writers leave it
    _pack(tmp_path / "void.tar", "w", [])
    frame = spark.createDataFrame([(str(tmp_path / n),) for n in ("open.tar", "void.tar")], "path string")
    assert AR.archive_files(frame, 4096).count() == 20
    assert AR.archive_files(frame.limit(0)).count() == 0


def test_a_large_archive_takes_little_memory(tmp_path):
    path = str(tmp_path / "large.tar")
    with open(path, "wb") as f:  # holes on disk: 3 GB that no file reader takes as one value
        for k in range(3):
            info = tarfile.TarInfo(f"{k}.bin" if k < 2 else "last.nxml")
            info.size = (3 << 29) if k < 2 else 3
            f.write(info.tobuf())
            f.seek(info.size, 1) if k < 2 else f.write(b"end" + bytes(509))
    tracemalloc.start()
    ranges = list(AR.archive_ranges(path, 1 << 20))
    texts = [t for r in ranges for t in AR.range_texts(*r)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts == [(f"{path}!last.nxml", 0, "end")] and most < 5_000_000


def test_checksums_of_files(spark, tmp_path):
    for name, body in (("a", b"1"), ("b c", b"x" * 20_000_000)):
        (tmp_path / name).write_bytes(body)
    got = {r.file: (r.bytes, r.sha256) for r in AR.checksums(spark, str(tmp_path)).collect()}
    assert got == {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir()}


def test_readers_number_rows_in_file_order(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for k in range(3):
        (tmp_path / "c" / f"part-{k}.jsonl").write_text("".join(f'{{"_id": "{k}{i}", "title": "t", "text": "x"}}\n' for i in range(4 + k)))
    rows = A.read_corpus(spark, str(tmp_path / "c")).orderBy("doc_idx").collect()
    assert [r.doc_idx for r in rows] == list(range(15)) and sorted(r.id for r in rows) == sorted(f"{k}{i}" for k in range(3) for i in range(4 + k))
    by_file = [r.id[0] for r in rows]
    assert all(by_file.index(k) + by_file.count(k) - 1 == 14 - by_file[::-1].index(k) for k in "012")
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq2\t01\t1\nq10\t02\t2\n")
    (tmp_path / "q.jsonl").write_text("".join(f'{{"_id": "{q}", "text": "x"}}\n' for q in ("q2", "q3", "q10")))
    qrels = A.read_qrels(spark, str(tmp_path / "q.tsv"), "dev")
    assert sorted(map(tuple, qrels.collect())) == [("q10", "02", 2.0, "dev"), ("q2", "01", 1.0, "dev")]
    queries = A.read_queries(spark, str(tmp_path / "q.jsonl"), qrels)
    assert [(r.query_idx, r.qid) for r in queries.orderBy("query_idx").collect()] == [(0, "q10"), (1, "q2")]
    assert A.refuse_missing(queries, qrels).count() == 2
    with pytest.raises(Exception, match="without judgments: q2"):
        A.refuse_missing(queries, qrels.where("qid = 'q10'")).collect()


def test_prepared_corpus_accounts_for_every_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    abstract, date, pmid = "<abstract>x</abstract>", "<pub-date pub-type='epub'><year>2001</year></pub-date>", "<article-id pub-id-type='pmid'>{}</article-id>"
    files = {"PMC5.nxml": _file(abstract + date), "PMC6.nxml": _file(pmid.format(8)), "PMC7.xml": "<article><", "PMC8.nxml": "<article><front/></article>", "name.nxml": _file(abstract), "PMC9.nxml": _file(pmid.format(""))}
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    with tarfile.open(tmp_path / "more.tar.gz", "w:gz") as tar:
        for name, text in [("z/PMC6.nxml", _file(abstract)), ("z/PMC11.nxml", _file(abstract)), ("z/PMC11.nxml", _file(date))]:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    out = str(tmp_path / "out")
    counts = C.prepare_corpus(spark, [str(tmp_path / "in"), str(tmp_path / "more.tar.gz")], out)
    assert counts == {"parse_error": 1, "no_article_meta": 1, "duplicate_id": 3, "written": 4, "with_abstract": 2, "with_date": 1, "with_pmid": 1, "file_name_differs_from_article_id": 3}
    rows = {r["_id"]: r for r in spark.read.schema(A.ARTICLE).json(out).collect()}
    assert set(rows) == {"5", "6", "9", "11"} and rows["6"].pmid == "8" and rows["9"].pmid is None and rows["11"].abstract == "x" and rows["5"].pub_date == "2001-01-01"
    (meta,) = [json.loads(x) for f in (tmp_path / "out.meta").glob("part-*") for x in f.read_text().splitlines()]
    assert meta["counts"] == counts and [i["file"] for i in meta["inputs"]] == ["more.tar.gz"]
    parts = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / "out").glob("part-*")}
    assert {p["file"]: p["sha256"] for p in meta["parts"]} == parts and C.altered(spark, out).count() == 0
    part = next((tmp_path / "out").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text("{}")
    assert C.altered(spark, out).count() == 1


def test_embedding_cache_is_filled_once(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), str(tmp_path / "seen")
    rows = [(i, t) for i, t in enumerate(["a b", "", None, "a b", "long " * 500, "c"])]
    texts = spark.createDataFrame(rows, "id long, text string")

    def encode(given):
        with open(seen, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in given)
        return EC.hash_encoder(8)(given)

    assert EC.entries(spark, path).count() == 0 and all(r.embedding is None for r in EC.with_embeddings(texts, path, "m").collect())
    assert EC.fill(texts, path, "m", encode) == 4 and EC.fill(texts, path, "m", encode) == 0
    assert EC.fill(texts.unionByName(spark.createDataFrame([(9, "new")], texts.schema)), path, "m", encode) == 1
    encoded = [json.loads(x) for x in open(seen)]
    assert sorted(encoded) == sorted({t for _, t in rows if t is not None} | {"new"}) and encoded[:4] == sorted(encoded[:4], key=len)
    got = {r.id: r.embedding for r in EC.with_embeddings(texts, path, "m").collect()}
    assert len(got) == len(rows) and got[2] is None and got[0] == got[3]
    assert all(np.allclose(got[i], EC.hash_encoder(8)([t])[0]) for i, t in rows if t is not None)
    assert EC.fill(texts, path, "other", EC.hash_encoder(8)) == 4
    EC.encoded(texts.limit(1).select(F.lit("k").alias("key"), "text"), EC.hash_encoder(8)).write.parquet(f"{path}/entries/died")
    assert EC.entries(spark, path).count() == 9
