"""Vector codes: product quantisation in whole numbers, entries found by partial-distance search.

Components become floor(``scale`` * x), and a vector is cut into equal consecutive parts.  A part
position has a codebook of its own, which starts as that part of the vectors of the smallest ids and
is improved in rounds: every part goes to its nearest entry, then an entry becomes the floored mean
of its parts.  All of this is integer arithmetic, so the order of the parts never matters and reruns
agree to the last digit.

The nearest entry comes from a partial-distance search.  Each part first gets one complete distance,
that to the entry nearest in the dimension of highest codebook variance.  The other entries are then
measured a dimension at a time, in descending variance; a mask drops the parts whose distance so far
strictly exceeds their best complete distance, so the later dimensions are read for few of them.

A round is one pass over the vectors: tasks add up the parts of each entry, Spark adds up the tasks,
and only codebooks (``entries`` vectors of each length) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, id_map, salted_join, table, written
from .embeddings import usable

#: Codebooks of one length of vectors: (part, entry, position within part).
Codebooks = np.ndarray

#: Largest component after scaling; below it no squared distance leaves 63 bits up to 64 dimensions.
MOST = 1 << 27


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index."""
    n, width = parts.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    # variances as whole numbers: k * sum of squares - square of sum; for very large ones as floats, since only speed depends on them
    wide = book.astype(np.float64)
    order = np.argsort(-(len(book) * (wide * wide).sum(axis=0) - wide.sum(axis=0) ** 2), kind="stable")
    lead = order[0]
    by_lead = np.argsort(book[:, lead], kind="stable")
    sorted_lead = book[by_lead, lead]
    at = np.searchsorted(sorted_lead, parts[:, lead])
    low, high = np.maximum(at - 1, 0), np.minimum(at, len(book) - 1)
    nearer = np.abs(sorted_lead[low] - parts[:, lead]) <= np.abs(sorted_lead[high] - parts[:, lead])
    best = by_lead[np.where(nearer, low, high)]
    difference = parts - book[best]
    distance = (difference * difference).sum(axis=1)
    for entry in range(len(book)):
        rows, total = None, None
        for k in order:
            own = parts[:, k] if rows is None else parts[rows, k]
            step = own - book[entry, k]
            total = step * step if total is None else total + step * step
            alive = total <= (distance if rows is None else distance[rows])
            if rows is None:
                rows, total = np.flatnonzero(alive), total[alive]
            elif not alive.all():
                rows, total = rows[alive], total[alive]
            if not len(rows):
                break
        if len(rows):
            better = (total < distance[rows]) | (entry < best[rows])
            best[rows[better]], distance[rows[better]] = entry, total[better]
    return best, distance


def _matrices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length in a batch."""
    size = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        flat = batch.column(at).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.astype(np.int64).reshape(-1, d)


def _assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entries (row, part) and squared distances summed over the parts."""
    parts, width = len(books), books.shape[2]
    found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1), np.sum([f[1] for f in found], axis=0)


def whole_numbers(df: DataFrame, id_col: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """(id, label, v) of the vectors that can be coded; ``v`` holds floor(scale * x)."""
    able = usable(F.col("v")) & (F.size("v") % parts == 0)
    given = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(able)
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    large = F.exists("v", lambda x: F.abs(x.cast("double")) >= MOST / scale)
    return given.select("id", "label", F.when(large, F.raise_error(F.lit(f"a component is not below {MOST / scale:g}"))).otherwise(scaled).alias("v"))


def first_books(rows: DataFrame, parts: int, entries: int) -> dict[int, Codebooks]:
    """Codebooks of each length: the parts of its vectors of the smallest ids (ties by content, null ids last)."""
    out = {}
    for d in sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect()):
        least = rows.where(F.size("v") == d).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v")
        x = np.array([r.v for r in least.collect()], np.int64)
        out[d] = x.reshape(len(x), parts, d // parts).transpose(1, 0, 2)
    return out


def improved(rows: DataFrame, books: dict[int, Codebooks]) -> dict[int, Codebooks]:
    """Codebooks after a round; entries that no part chose stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros((*b.shape[:2], b.shape[2] + 1), np.int64) for d, b in books.items()}
        for batch in batches:
            for _, x in _matrices(batch, 0):
                own = books[x.shape[1]]
                chosen, _ = _assigned(x, own)
                for p in range(len(own)):
                    order = np.argsort(chosen[:, p], kind="stable")
                    entry, begin = np.unique(chosen[order, p], return_index=True)
                    part = x[order, p * own.shape[2] : (p + 1) * own.shape[2]]
                    total[x.shape[1]][p, entry, :-1] += np.add.reduceat(part, begin, axis=0)
                    total[x.shape[1]][p, entry, -1] += np.diff(np.append(begin, len(part)))
        for d, t in total.items():
            at = [a.ravel() for a in np.indices(t.shape)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, d)), *map(pa.array, at), pa.array(t.ravel())], names=["d", "part", "entry", "position", "total"])

    added = rows.select("v").mapInArrow(sums, "d long, part long, entry long, position long, total long")
    # one row for each component of each entry; sums in decimals, since they have no bound in 64 bits
    added = added.groupBy("d", "part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    found: dict[tuple, int] = {(r.d, r.part, r.entry, r.position): int(r.total) for r in added.collect()}
    out = {}
    for d, b in books.items():
        out[d] = b.copy()
        for p, e in np.ndindex(b.shape[:2]):
            n = found.get((d, p, e, b.shape[2]), 0)
            if n:
                out[d][p, e] = [found[d, p, e, k] // n for k in range(b.shape[2])]
    return out


def trained(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> dict[int, Codebooks]:
    """Codebooks by length of the vectors; ``rows`` as ``whole_numbers`` gives them."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(rows, books)
    return books


def coded(rows: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of rows whose length has a codebook."""
    prints = {d: hashlib.sha256(",".join(map(str, b.ravel().tolist())).encode()).hexdigest() for d, b in books.items()}
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, 2):
                own = books.get(x.shape[1])
                if own is not None:
                    chosen, error = _assigned(x, own)
                    codes = pa.array(["".join(c) for c in hexes[chosen].tolist()])
                    row = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), codes, pa.array(error), pa.array([prints[x.shape[1]]] * len(at))], names=["id", "label", "code", "error", "codebooks_sha256"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind('id')}, label {kind('label')}, code string, error long, codebooks_sha256 string")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over all rows of a label (nulls are one); a label of many rows is spread."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = codes.withColumn("tessera_label", key)
    of_label = rows.groupBy("tessera_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    of_label = written(of_label, "label_errors")
    hot = id_map(of_label.where(F.col("n") > HOT_ROWS).select(F.col("tessera_label").alias("id")))
    spread: Column = F.struct("id", "code")
    return salted_join(rows, of_label.drop("n"), "tessera_label", spread, hot).drop("tessera_label")


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per vector that can be coded: id, code, error, label_error, codebooks_sha256.

    Left out are vectors that are null, empty, hold null or non-finite components, or whose length is
    not a multiple of ``parts``.  Vectors of one length share codebooks; where there are several
    lengths each has its own (``codebooks_sha256`` tells which).  Repeated rows, also of one id, all
    count; null ids sort last among the rows that start a codebook; with fewer than ``entries``
    rows there are fewer entries (at most 256 are allowed).  Null labels are one label.  A component
    of 32768 or more (at the given scale) is an error, since distances would leave 64 bits.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = written(whole_numbers(df, id_col, vector, label, parts, scale), "whole_vectors")
    codes = written(coded(rows, trained(rows, parts, entries, rounds)), "codes")
    out = with_label_errors(codes)
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))
