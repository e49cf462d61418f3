"""The registered queries themselves: columns, types and what their contracts say of every row."""

from __future__ import annotations

import zlib

import pytest

from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op3_vector_links": ("embeddings", "vec_id", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}),
    "op4_quality": ("documents", "doc_id", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op6_near_duplicates": ("documents", "doc_id", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}),
    "op7_language_id": ("documents", "doc_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    "op9_source_mixing": ("documents", "doc_id", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    "op11_vector_codes": ("embeddings", "vec_id", {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}),
    "op12_source_divergence": (None, None, {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}),
    "op13_decontamination": ("documents", "doc_id", {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_query_keeps_its_contract(spark, name):
    source, key, columns = CONTRACTS[name]
    df = QUERIES[name](spark, SF)
    assert dict(df.dtypes).items() >= columns.items()
    rows = df.collect()
    if source:
        given = sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())
        assert sorted(r[key] for r in rows) == given
    fold = {"op4_quality": (5, 0), "op7_language_id": (4, 2)}.get(name)
    if fold:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 for r in rows)
    if "kept" in columns:
        assert all(r.kept == (r[key] == r.component_id) and r.component_id <= r[key] for r in rows)
    if name == "op4_quality":
        assert all(r.predicted == (r.score >= 0.3) for r in rows)
    if name == "op9_source_mixing":
        assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
        total, taken = sum(r["size"] for r in rows), sum(r.taken for r in rows)
        assert abs(taken - 1.5 * total) < 0.01 * total
