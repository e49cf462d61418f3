"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt by length, longest first, to buckets of about ``bucket_rows``.  Every block of
queries first meets the bucket of the longest vectors, which gives each query a bound: the score of
its k-th best so far.  By that bound and a bucket's longest vector a query has a local cosine
threshold in each other bucket.  Above 1 the bucket cannot matter.  Queries of like thresholds share
a block, and where no query of a block needs a bucket, the two never meet.  A high threshold prunes by coordinates: a vector of at least that
cosine must have each coordinate within a range about the query's, checked on the query's largest
coordinates.  A low one prunes by length: only vectors long enough to reach the bound are looked at.
What remains is verified by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .embeddings import matrix, usable

#: Local cosine thresholds from here on prune by coordinates, lower ones by length.
COORDINATE_COSINE = 0.6
FOCUS = 4
#: Levels of the threshold by which queries are ordered into blocks.
LEVELS = 32


def exact_products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """q @ p.T of integer matrices as int64; through doubles only where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q @ p.T


def search_bucket(q_ids, q, bound, p_ids, p, k: int):
    """(query row, p row, score) of each query's best k in one bucket, none below its bound."""
    q_len = np.linalg.norm(q.astype(np.float64), axis=1)
    p_len = np.linalg.norm(p.astype(np.float64), axis=1)
    order = np.argsort(-p_len, kind="stable")
    p_ids, p, p_len = p_ids[order], p[order], p_len[order]
    unit = p / np.maximum(p_len, 1e-300)[:, None]
    bounded = np.isfinite(bound) & (bound > 0) & (q_len > 0)
    local = np.where(bounded, np.where(bounded, bound, 0) / np.maximum(q_len * max(p_len[0], 1e-300), 1e-300), -1.0)
    out = []

    def keep(row: int, at: np.ndarray, scores: np.ndarray) -> None:
        able = (p_ids[at] != q_ids[row]) & (scores >= bound[row])
        at, scores = at[able], scores[able]
        if len(at) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= least], scores[scores >= least]
        best = np.lexsort((p_ids[at], -scores))[:k]
        out.extend((row, int(order[a]), int(s)) for a, s in zip(at[best].tolist(), scores[best].tolist(), strict=True))

    by_length = np.flatnonzero(local < COORDINATE_COSINE)
    for s in range(0, len(by_length), 128):
        rows = by_length[s : s + 128]
        least = np.where(bounded[rows], bound[rows] / np.maximum(q_len[rows], 1e-300), 0).min() if bounded[rows].all() else 0.0
        long = int(np.searchsorted(-p_len, -(least * (1 - 1e-12)), side="right"))
        scores = exact_products(q[rows], p[:long])
        for r, row in enumerate(rows.tolist()):
            keep(row, np.arange(long), scores[r])
    for row in np.flatnonzero((local >= COORDINATE_COSINE) & (local <= 1 + 1e-9)).tolist():
        direction = q[row] / q_len[row]
        cosine = min(1.0, local[row])
        at = np.arange(int(np.searchsorted(-p_len, -(bound[row] / q_len[row] * (1 - 1e-12)), side="right")))
        for f in np.argsort(-np.abs(direction))[:FOCUS].tolist():
            width = ((1 - cosine**2) * max(0.0, 1 - direction[f] ** 2)) ** 0.5
            # a cosine of at least c puts the coordinate at or beyond c*d - width, towards the query's side
            least = cosine * abs(direction[f]) - width - 1e-9
            at = at[unit[at, f] * np.sign(direction[f]) >= least]
        if len(at):
            keep(row, at, exact_products(q[row : row + 1], p[at])[0])
    return out


def with_blocks(asked: DataFrame, longest: DataFrame, query_rows: int) -> DataFrame:
    """Adds ``block`` to queries (id, d, length, bound): about ``query_rows`` of them, of like thresholds.

    ``longest`` (d, longest) has the greatest length of a candidate; bound / (length * longest) is the
    least cosine that a query still needs anywhere.  Queries go to blocks in the order of its level, by
    hash within a level, so one without a bound does not make well-bounded ones meet every bucket.
    Only the counts of levels, LEVELS + 1 rows at most for each ``d``, are summed in order.
    """
    cosine = F.when(F.col("bound") > 0, F.least(F.lit(1.0), F.col("bound") / (F.col("length") * F.col("longest")))).otherwise(F.lit(0.0))
    leveled = written(asked.join(longest, "d").withColumn("level", F.floor(cosine * LEVELS).cast("int")).drop("longest"), "bounded")
    levels = leveled.groupBy("d", "level").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("d").orderBy("level").rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.withColumn("before", F.coalesce(before, F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("id", F.lit(59)), F.col("n"))
    return leveled.join(levels, ["d", "level"]).withColumn("block", F.floor(place / query_rows).cast("int")).drop("level", "n", "before")


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, bucket_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows, exactly.

    Components are floor(``scale`` * x) in doubles and scores their integer inner products; ties go
    to the smaller id.  Vectors that are null, empty or hold null or non-finite components, and
    rows with a null id, take no part; vectors of different lengths do not meet.  Rows of one id are
    one candidate (its first by content).  A query with fewer candidates has fewer rows.
    """
    spark = df.sparkSession
    given = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable(F.col("v")) & F.col("id").isNotNull())
    whole = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    n, ids = given.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    given = given.withColumn("v", whole)
    if n != ids:
        given = given.groupBy("id").agg(F.min(F.struct("v", "q")).alias("r")).select("id", "r.v", "r.q")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    given = given.withColumn("length", length).withColumn("d", F.size("v"))
    dealt = given.repartitionByRange(max(1, -(-ids // bucket_rows)), F.col("d"), F.desc("length"), "id")
    rows = written(dealt.withColumn("bucket", F.spark_partition_id()), "buckets")
    buckets = written(rows.groupBy("d", "bucket").agg(F.max("length").alias("most"), F.count(F.lit(1)).alias("n")), "bucket_sizes")
    queries = rows.where("q").select("id", "v", "length", "d")
    blocks = max(1, -(-queries.count() // query_rows))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(53)), F.lit(blocks)).cast("int")), "queries")
    first = buckets.groupBy("d").agg(F.max_by("bucket", F.struct("most", (-F.col("bucket")).alias("b"))).alias("bucket"))
    by_block = queries.groupBy("d", "block").agg(F.max("length").alias("longest")).drop("longest")

    def meet(plan: DataFrame, asked: DataFrame) -> DataFrame:
        plan = written(plan.select("d", "bucket", "block"), "plan")
        left = asked.join(plan, ["d", "block"]).groupBy("bucket", "block", "d")
        right = rows.select("id", "v", "d", "bucket").join(plan, ["d", "bucket"]).groupBy("bucket", "block", "d")

        def search(ask: pa.Table, have: pa.Table) -> pa.Table:
            if not ask.num_rows or not have.num_rows:
                return pa.table({"query_id": pa.array([], ask["id"].type), "vec_id": pa.array([], ask["id"].type), "score": pa.array([], pa.int64())})
            d = ask["d"][0].as_py()
            integers = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            bound = ask["bound"].to_numpy().astype(np.float64)
            found = search_bucket(ask["id"].to_numpy(), integers(ask), np.where(np.isnan(bound), -np.inf, bound), have["id"].to_numpy(), integers(have), k)
            q_at, p_at = [f[0] for f in found], [f[1] for f in found]
            return pa.table({"query_id": ask["id"].take(pa.array(q_at, pa.int64())), "vec_id": have["id"].take(pa.array(p_at, pa.int64())), "score": pa.array([f[2] for f in found], pa.int64())})

        kind = df.schema[id_col].dataType.simpleString()
        return written(left.cogroup(right).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score long"), "found")

    start = by_block.join(first, "d")
    found = meet(start, queries.withColumn("bound", F.lit(None).cast("double")))
    bound = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound")).where(F.col("n") >= k)
    asked = queries.drop("block").join(bound.select("id", F.col("bound").cast("double").alias("bound")), "id", "left")
    asked = written(with_blocks(asked, buckets.groupBy("d").agg(F.max("most").alias("longest")), query_rows), "queries")
    # a block needs a bucket if one of its queries could still find something there
    need = asked.groupBy("d", "block").agg(F.max(F.when(F.col("bound") > 0, F.col("length") / F.col("bound")).otherwise(F.lit(float("inf")))).alias("reach"))
    plan = buckets.join(need, "d").where(F.col("reach") * F.col("most") >= 1 - 1e-9).join(first.withColumn("was", F.lit(True)), ["d", "bucket"], "left").where("was is null").select("d", "bucket", "block")
    every = found.unionByName(meet(plan, asked))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return top_k(df, F.col("vec_id") % 100 == 0)
