"""A stored index: segments of tokenised documents, written once, appended to and read by every search.

A segment holds a row per document with its terms and their numbers, and the document frequencies of
its terms.  A document is counted within its row, so nothing is shuffled but the distinct terms of
each task.  A segment counts from the moment its line is in the table of segments, which is written
last: a build that dies leaves nothing that is read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import bounded_batches, give_back, pieces, shared_folder

SEGMENTS = "segment string, n long, length long"
_TOKEN = re.compile(r"\w+")


@dataclass
class Index:
    """rows (doc_idx, dl, terms, tfs and what came with the documents), terms (term, df), n documents of ``length`` tokens in all; its segments at ``path``."""

    rows: DataFrame
    terms: DataFrame
    n: int
    length: int
    path: str
    segments: tuple[str, ...]

    @property
    def avgdl(self) -> float:
        return self.length / max(self.n, 1)

    @property
    def corpus(self) -> DataFrame:
        """One row: n, avgdl."""
        return self.rows.sparkSession.range(1).select(F.lit(self.n).cast("long").alias("n"), F.lit(float(self.avgdl)).alias("avgdl"))

    @property
    def postings(self) -> DataFrame:
        """(doc_idx, dl, term, tf); empty documents have none."""
        rows = self.rows.select("doc_idx", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        return rows.select("doc_idx", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_idx, dl, terms, tfs, ...) of documents (doc_idx, title, abstract, ...): each distinct term and how often it occurs."""
    rest = [c for c in docs.columns if c not in ("doc_idx", "title", "abstract")]
    given = docs.select("doc_idx", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("text"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts = [Counter(_TOKEN.findall(t.lower())) for t in batch.column(1).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array([t for c in counts for t in c], pa.string()))
            tfs = pa.ListArray.from_arrays(ends, pa.array([n for c in counts for n in c.values()], pa.int32()))
            lengths = pa.array([c.total() for c in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, terms, tfs, *batch.columns[2:]], names=["doc_idx", "dl", "terms", "tfs", *rest])
        give_back()

    bounded_batches(docs.sparkSession)
    kind = lambda c: docs.schema[c].dataType.simpleString()
    return given.mapInArrow(run, ", ".join([f"doc_idx {kind('doc_idx')}, dl long, terms array<string>, tfs array<int>", *(f"`{c}` {kind(c)}" for c in rest)]))


def append(docs: DataFrame, path: str) -> None:
    """Adds documents to the index at ``path``, or begins it; their ids must be new to it."""
    spark, segment = docs.sparkSession, uuid.uuid4().hex
    tokenised(docs).write.parquet(f"{path}/rows/{segment}")
    rows = spark.read.parquet(f"{path}/rows/{segment}")
    rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms/{segment}")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    spark.createDataFrame([(segment, total.n, total.length)], SEGMENTS).coalesce(1).write.mode("append").parquet(f"{path}/segments")


def read(spark: SparkSession, path: str, most: int | None = None) -> Index | None:
    """The index at ``path`` with all its segments, or the first ``most`` by name; None where there is none."""
    try:
        segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").collect()  # a row for each append
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    segments = sorted(segments, key=lambda s: s.segment)[:most]
    rows = spark.read.parquet(*[f"{path}/rows/{s.segment}" for s in segments])
    terms = spark.read.parquet(*[f"{path}/terms/{s.segment}" for s in segments])
    if len(segments) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
    return Index(rows, terms, sum(s.n for s in segments), sum(s.length for s in segments), path, tuple(s.segment for s in segments))


def build_index(docs: DataFrame, path: str | None = None) -> Index:
    """The index of documents (doc_idx, title, abstract, ...), written to ``path`` or the shared folder.

    Empty documents count in n and have no terms; further columns, such as an embedding, go along.
    """
    path = path or f"{shared_folder(docs.sparkSession)}/indexes/{uuid.uuid4().hex}"
    append(docs, path)
    return read(docs.sparkSession, path)


def kept_index(spark: SparkSession, sources: list[str], docs) -> Index:
    """The index of ``docs()``, made once for the files of ``sources`` as they are now.

    Their names, sizes and times are its key, so that changed files have an index of their own.  Two
    sessions that make it at the same time leave two segments of the same documents; one is read.
    """
    files = None
    for path in sources:
        m = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        files = m if files is None else files.unionByName(m)
    key = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "file_path", "file_size", F.col("file_modification_time").cast("string")))), "\n"), 256).alias("key")).first().key
    path = f"{shared_folder(spark)}/indexes/{key}"
    found = read(spark, path, most=1)
    if found is None:
        append(docs(), path)
        found = read(spark, path, most=1)
    return found
