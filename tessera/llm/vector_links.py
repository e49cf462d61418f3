"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learnt by iterative quantisation turns centred vectors into balanced bits; several
rotations give as many bits as are needed.  Runs of bits index tables: vectors with an equal run in
some table are candidates, and the original vectors decide.  The length of a run grows with the
logarithm of the rows, so that buckets stay small, and the number of tables follows from it and
from the recall wanted at the threshold itself (closer pairs are found more surely).

Equal vectors are one class and enter the tables once, with their number.  Only codes go to the
tables.  A bucket is split into blocks, and pairs of blocks are sieved as matrices of bits: a vector
stays where the Hamming distance of its whole code to another's is within a radius, and only then
is it sent there.  The distance of a pair is the same in every table, so a pair within the radius stays
wherever it meets.  Tables and radius are fitted to sampled pairs at the threshold.  Vectors of different
lengths never meet: a length has codes and buckets of its own.  Blocks of those vectors are compared as
matrices in turn: what leaves a pair of blocks is a count of links and one edge of a spanning star for
each vector, never the pairs.  A pair of vectors counts only in the first table where the two meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_map, marked, salted_join, table, written
from .components import components, local_roots
from .embeddings import matrix, usable

#: Rows of a block; a pair of blocks is what one comparison holds.
BLOCK = 2048
#: Share of the bits of a code in which two vectors may differ and still be compared, at least.
SIEVE = 0.35
#: Of the loss allowed, the part kept in reserve, since recall is measured on the sample that codes are learnt from.
RESERVE = 0.3


def itq_rotation(x: np.ndarray, seed: int, turns: int = 40) -> np.ndarray:
    """Rotation that brings the rows of ``x`` (centred, in principal axes) near the corners of a cube."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(turns):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = vt.T @ u.T
    return r


def learn_codes(sample: np.ndarray, bits: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to ``bits`` bits: principal axes, then one rotation for every d bits."""
    d = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    axes = np.linalg.eigh((sample - mean).T @ (sample - mean))[1] if len(sample) else np.eye(d)
    x = (sample - mean) @ axes
    parts = [axes @ itq_rotation(x, seed + k) for k in range(-(-bits // d))]
    return mean, np.hstack(parts)[:, :bits]


@lru_cache(maxsize=64)
def drawn_codes(d: int, bits: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean (zero) and random directions for a length that the sample has too few vectors of to learn from."""
    return np.zeros(d), np.random.default_rng(seed).normal(size=(d, bits))


def by_length(sample) -> dict[int, np.ndarray]:
    """Unit vectors of an Arrow list column by length: the commonest, and those with at least as many rows as components."""
    size = pc.list_value_length(sample).to_numpy()
    lengths, counts = np.unique(size, return_counts=True)
    out = {}
    for d, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        if n >= d or n == counts.max():
            x = matrix(sample.filter(pa.array(size == d)), d)
            out[d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def threshold_pairs(x: np.ndarray, threshold: float, band: float = 0.03, rows: int = 4096, least: int = 50, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors just above the threshold: those of the sample, or made ones where it has too few.

    A made pair is a vector and one at exactly the threshold from it, on the way to another vector of
    the sample, so that it lies where the data lie.
    """
    own = x[:rows]
    a, b = np.nonzero(np.triu((cosine := own @ own.T) >= threshold, 1) & (cosine < threshold + band)) if len(own) else (np.zeros(0, int),) * 2
    if len(a) >= least:
        some = np.linspace(0, len(a) - 1, min(len(a), most)).astype(int)
        return own[a[some]], own[b[some]]
    rng = np.random.default_rng(11)
    at, to = rng.integers(0, max(1, len(own)), (2, 4096 if len(own) > 1 else 0))
    start = own[at]
    away = own[to] - (own[to] * start).sum(axis=1, keepdims=True) * start
    length = np.linalg.norm(away, axis=1)
    good = length > 1e-6
    start, away = start[good], away[good] / length[good, None]
    return start, threshold * start + math.sqrt(max(0.0, 1 - threshold**2)) * away


def tables_for(rows: int, agree: float, recall: float, bucket: int = 64, most_bits: int = 24) -> tuple[int, int]:
    """Bits of a run so that buckets hold about ``bucket`` vectors, and tables for the recall wanted, if bits were independent."""
    run = min(most_bits, max(1, math.ceil(math.log2(max(2, rows / bucket)))))
    hit = min(1 - 1e-9, max(1e-6, agree**run))
    return run, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


@dataclass
class Coding:
    """Codes of ``tables`` runs of ``run`` bits, by length of the vectors; pairs further apart than ``radius`` bits are not compared.

    ``recall`` is the share of the pairs just above the threshold, in the sample, that are found.
    """

    run: int
    tables: int
    radius: int
    learnt: dict[int, tuple[np.ndarray, np.ndarray]]
    recall: float


def fitted(units: dict[int, np.ndarray], rows: int, threshold: float, recall: float) -> Coding:
    """Tables and radius such that sampled pairs just above the threshold are found.

    Codes are of centred vectors, whose angles may be far wider than the vectors' own (vectors with a
    common direction), so what bits tell is measured and not derived from the threshold: tables are
    added until the recall on the pairs holds, and the radius covers all but a thousandth of them.
    """
    pairs = {d: threshold_pairs(x, threshold) for d, x in units.items()}

    def bits(d: int, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((x - mean) @ axes >= 0 for x in pairs[d])

    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    for d, x in units.items():
        one, other = bits(d, *learn_codes(x, d))
        agree = min(agree, float((one == other).mean())) if len(one) else agree
    run, tables = tables_for(rows, agree, recall)
    while True:
        learnt = {d: learn_codes(x, run * tables) for d, x in units.items()}
        radius, found = math.ceil(SIEVE * run * tables), 1.0
        for d, own in learnt.items():
            one, other = bits(d, *own)
            if len(one):
                apart = (one != other).sum(axis=1)
                radius = max(radius, math.ceil(float(np.quantile(apart, 0.999)) + 0.03 * run * tables))
                found = min(found, float((~(one != other).reshape(len(one), tables, run).any(axis=2)).any(axis=1).mean()))
        if found >= recall + RESERVE * (1 - recall) or run * tables >= 64 * 1024:
            return Coding(run, tables, min(radius, run * tables), learnt, found)
        tables = math.ceil(1.25 * tables) + 1


#: Pairs whose codes are looked at together.
PAIRS = 1 << 16


def _first_meetings(a: np.ndarray, b: np.ndarray, codes: np.ndarray, t: int) -> np.ndarray:
    """Whether pairs of rows have no equal run in a table before ``t``."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a) if t else 0, PAIRS):
        own = slice(s, s + PAIRS)
        out[own] = ~(codes[a[own], :t] == codes[b[own], :t]).any(axis=1)
    return out


def _tiles(block: np.ndarray, i: int, j: int, product, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of blocks i and j whose product is at least ``least``, a part of the left rows at a time."""
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    for s in range(0, len(left) if len(right) else 0, 512):
        rows = left[s : s + 512]
        a, b = np.nonzero(product(rows, right) >= least)
        a, b = rows[a], right[b]
        yield (a[a < b], b[a < b]) if i == j else (a, b)


def _compare(key: tuple, ids, codes, x, weight, block, threshold: float, tie: float = 1e-12):
    """Counts of links and star edges among the rows of one pair of blocks."""
    t, i, j = key
    pairs_a, pairs_b = [], []
    for a, b in _tiles(block, i, j, lambda l, r: x[l] @ x[r].T, threshold - tie):
        keep = _first_meetings(a, b, codes, t)
        keep[keep] = np.einsum("ij,ij->i", x[a[keep]], x[b[keep]]) >= threshold
        pairs_a.append(a[keep])
        pairs_b.append(b[keep])
    if not pairs_a:
        return None
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    if not len(a):
        return None
    count = np.zeros(len(ids), np.int64)
    np.add.at(count, a, weight[b])
    np.add.at(count, b, weight[a])
    order = np.argsort(ids, kind="stable")  # so that the least index is the least id
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = ids[order][local_roots(len(ids), place[a], place[b])][place]
    some = np.flatnonzero(count)
    return ids[some], count[some], root[some]


def vector_links(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.98, fit_rows: int = 20_000) -> DataFrame:
    """One row per vector: id, n_links, component_id (least id reachable), kept.

    Linked are vectors of one length whose cosine, in double precision, is at least ``threshold``, as
    far as the tables bring them together.  Null vectors, zero vectors and those with null or
    non-finite components link with nothing, nor do rows with a null id (component null, kept).  Rows
    of one id are taken as copies of the first.  The rotations of a length are learnt from its share
    of about ``fit_rows`` vectors chosen by a hash (see ``by_length``); lengths too rare for that get
    random directions.  Every vector is indexed.
    """
    spark = df.sparkSession
    given = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    able = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    prints = given.select("id", F.when(able, F.sha2(F.to_json(F.struct("v")).cast("binary"), 256)).alias("print"))
    prints = written(prints, "vectors")
    classes = prints.where("print is not null").groupBy("print").agg(F.min("id").alias("class"), F.countDistinct("id").alias("weight"))
    classes = written(classes, "classes")
    heads = given.where(able).join(classes.select(F.col("class").alias("id"), "weight"), "id").dropDuplicates(["id"])
    heads = written(heads, "heads")
    n = heads.count()

    share = min(1.0, fit_rows / max(1, n))
    sample = heads.where(F.pmod(F.xxhash64("id", F.lit(41)), F.lit(1_000_003)) < share * 1_000_003).select("id", "v").toArrow().sort_by("id")
    units = by_length(sample["v"]) if sample.num_rows else {1: np.zeros((0, 1))}
    coding = fitted(units, n, threshold, recall)
    run, tables, radius, learnt = coding.run, coding.tables, coding.radius, coding.learnt
    powers = 1 << np.arange(run)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            bits = np.zeros((batch.num_rows, run * tables), bool)
            for d in np.unique(size).tolist():
                mean, axes = learnt.get(d) or drawn_codes(d, run * tables)
                own = matrix(batch.column(1).filter(pa.array(size == d)), d)
                own /= np.linalg.norm(own, axis=1, keepdims=True)
                bits[size == d] = (own - mean) @ axes >= 0
            runs = (bits.reshape(-1, tables, run) @ powers).astype("<i4")
            lists = pa.FixedSizeListArray.from_arrays(pa.array(runs.ravel()), tables).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in np.packbits(bits, axis=1)], pa.binary()), lists, pa.array(size, pa.int32())], names=["id", "code", "runs", "d"])

    kind = heads.schema
    coded = heads.select("id", "v").mapInArrow(code, f"id {kind['id'].dataType.simpleString()}, code binary, runs array<int>, d int")
    coded = written(coded, "codes")
    keyed = coded.select("id", "code", "d", F.posexplode("runs").alias("t", "run"))
    # a run has at most 24 bits; above it stand 16 bits of the table and then the length
    keyed = keyed.select("id", "code", F.expr("shiftleft(cast(d as long), 40) | shiftleft(cast(t as long), 24) | run").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = written(sizes.select("key", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "buckets")
    # most keys are met once or fit one block, which maps of keys tell; only the others' rows move to be joined
    met = id_map(sizes.select(F.col("key").alias("id")))
    large = id_map(sizes.where("blocks > 1").select(F.col("key").alias("id")))
    keyed = marked(marked(keyed, met, "key", "met").where("met").drop("met"), large, "key", "large")
    split = marked(sizes.drop("size"), large, "key", "large").where("large").drop("large")
    rows = salted_join(keyed.where("large").drop("large"), split, "key", F.col("id"), large)
    rows = keyed.where("not large").drop("large").withColumn("blocks", F.lit(1)).unionByName(rows)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(43)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("o", other).select("key", F.least("block", "o").cast("int").alias("i"), F.greatest("block", "o").cast("int").alias("j"), "block", "id", "code")

    def sieve(groups: pa.Table) -> pa.Table:
        i, j = (groups[c][0].as_py() for c in ("i", "j"))
        packed = np.frombuffer(b"".join(groups["code"].to_pylist()), np.uint8).reshape(groups.num_rows, -1)
        signs = np.unpackbits(packed, axis=1, count=run * tables).astype(np.float32) * 2 - 1
        near = np.zeros(groups.num_rows, bool)
        for a, b in _tiles(groups["block"].to_numpy(), i, j, lambda l, r: signs[l] @ signs[r].T, run * tables - 2 * radius - 0.5):
            near[a] = near[b] = True
        return groups.select(["key", "i", "j", "block", "id"]).filter(pa.array(near))

    left = rows.groupBy("key", "i", "j").applyInArrow(sieve, rows.drop("code").schema)
    rows = written(left, "sieved").join(heads.select("id", "v", "weight").join(coded.select("id", "runs"), "id"), "id")

    def compare(groups: pa.Table) -> pa.Table:
        key, i, j = (groups[c][0].as_py() for c in ("key", "i", "j"))
        d, t = key >> 40, key >> 24 & 0xFFFF
        ids = groups["id"].to_numpy()
        own = matrix(groups["v"], d)
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        runs = groups["runs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), tables)
        found = _compare((t, i, j), ids, runs, own, groups["weight"].to_numpy(), groups["block"].to_numpy(), threshold)
        a, count, root = found if found else (ids[:0], np.zeros(0, np.int64), ids[:0])
        return pa.table({"a": pa.array(a), "links": pa.array(count), "b": pa.array(root)})

    id_kind = kind["id"].dataType.simpleString()
    stars = rows.groupBy("key", "i", "j").applyInArrow(compare, f"a {id_kind}, links long, b {id_kind}")
    stars = written(stars, "stars")
    labels = components(stars.select("a", "b"))
    counts = stars.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "class", "left").join(labels.withColumnRenamed("node", "class"), "class", "left")
    of_class = of_class.select("print", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    out = prints.join(of_class, "print", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))
