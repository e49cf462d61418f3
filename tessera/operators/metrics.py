"""Retrieval metrics over rankings (arm, query_idx, doc_idx, rank) and judgments (query_idx, doc_idx, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params


def graded(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ranking with grades; what is not judged has grade 0."""
    return ranking.join(qrels.select("query_idx", "doc_idx", "grade"), ["query_idx", "doc_idx"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def ideal_dcg(qrels: DataFrame, k: int = params.CUTOFF) -> DataFrame:
    """Per query the best DCG@k that its judgments allow; all judged documents count, grades of any sign."""
    place = F.row_number().over(Window.partitionBy("query_idx").orderBy(F.desc("grade"), "doc_idx"))
    return qrels.withColumn("place", place).where(F.col("place") <= k).groupBy("query_idx").agg(F.sum(F.col("grade") / F.log2(F.col("place") + 1)).alias("idcg"))


def per_query(ranking: DataFrame, qrels: DataFrame, k: int = params.CUTOFF) -> DataFrame:
    """(arm, query_idx, p, ndcg, mrr): P@k divides by k; NDCG@k is 0 without a positive ideal; MRR uses the whole list."""
    rows = graded(ranking, qrels)
    hit = F.col("grade") > 0
    out = rows.groupBy("arm", "query_idx").agg(
        (F.countDistinct(F.when(hit & (F.col("rank") <= k), F.col("doc_idx"))) / F.lit(float(k))).alias("p"),
        F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    out = out.join(ideal_dcg(qrels, k), "query_idx", "left")
    ndcg = F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0))
    return out.select("arm", "query_idx", "p", ndcg.alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def compare(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("arm").agg(F.avg("p").alias("p_at_10"), F.avg("ndcg").alias("ndcg_at_10"), F.avg("mrr").alias("mrr"))


def conjecture(baseline: Column, experimental: Column, least: float = params.MINIMUM_IMPROVEMENT) -> Column:
    """(passed, message): whether the gain reaches the absolute bar."""
    gain = experimental - baseline
    message = (
        F.when(gain >= least, F.format_string("PASS: +%.3f", F.bround(gain, 3)))
        .when(gain > 0, F.concat(F.format_string("FAIL: +%.3f", F.bround(gain, 3)), F.lit(f" < {least} required")))
        .otherwise(F.concat(F.lit("FAIL: no improvement ("), F.format_string("%.3f", F.bround(gain, 3)), F.lit(")")))
    )
    return F.struct((gain >= least).alias("passed"), message.alias("message"))


def bars(base: Column, other: Column, least: float = params.MINIMUM_IMPROVEMENT) -> Column:
    """Both readings of the bar: absolute and relative."""
    return F.struct((other >= base + least).alias("absolute"), (other >= base * (1 + least)).alias("relative"))
