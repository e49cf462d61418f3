"""Writers of results: per-query tables, run files, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query_table(metrics: DataFrame, arms: list[str], value: str = "ndcg") -> DataFrame:
    """One row per query, one column per arm, ten decimals."""
    wide = metrics.groupBy("query_idx").pivot("arm", arms).agg(F.first(value))
    return wide.select("query_idx", *[F.format_string("%.10f", F.col(f"`{a}`")).alias(a) for a in arms])


def run_lines(rankings: DataFrame) -> DataFrame:
    """(arm, value): lines 'qid Q0 doc rank score arm' with scores falling from 100."""
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "id", F.col("rank").cast("string"), (100 - (F.col("rank") - 1)).cast("string"), "arm")
    return rankings.select("arm", "qid", "rank", line.alias("value"))


def write_runs(rankings: DataFrame, path: str) -> None:
    run_lines(rankings).repartition("arm").sortWithinPartitions("arm", "qid", "rank").select("arm", "value").write.partitionBy("arm").text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
