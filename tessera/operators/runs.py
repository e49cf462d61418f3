"""An evaluation in two phases: rankings are saved and sealed before any judgment is read.

A phase writes its tables first and its seal last.  A rerun takes up what is sealed and does the rest,
so rankings never change once judgments have been seen; another plan in the same folder is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import write_runs
from . import metrics as M

SEAL = "phase string, plan string, folder string"


def _seal_of(spark: SparkSession, folder: str, phase: str, plan: str) -> str | None:
    """Where a sealed phase lies; None if it is still to do."""
    try:
        rows = spark.read.schema(SEAL).parquet(f"{folder}/seals").where(F.col("phase") == phase).collect()  # one a phase
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    for r in rows:
        if r.plan != plan:
            raise ValueError(f"the {phase} of this folder are of another plan: {r.plan}")
    return rows[0].folder if rows else None


def _sealed(spark: SparkSession, folder: str, phase: str, plan: str, own: str) -> None:
    spark.createDataFrame([(phase, plan, own)], SEAL).coalesce(1).write.mode("append").parquet(f"{folder}/seals")


def sealed_rankings(spark: SparkSession, folder: str, plan: str, rank: Callable[[], DataFrame]) -> DataFrame:
    """(arm, query_idx, doc_idx, rank, qid, id), made by ``rank`` unless they are sealed already; run files lie beside them."""
    own = _seal_of(spark, folder, "rankings", plan)
    if own is None:
        own = f"{folder}/rankings-{uuid.uuid4().hex}"
        rank().select("arm", "query_idx", "doc_idx", "rank", "qid", "id").write.parquet(f"{own}/table")
        write_runs(spark.read.parquet(f"{own}/table"), f"{own}/runs")
        _sealed(spark, folder, "rankings", plan, own)
    return spark.read.parquet(f"{own}/table")


def evaluated(spark: SparkSession, folder: str, plan: str, rank: Callable[[], DataFrame], judge: Callable[[], DataFrame]) -> DataFrame:
    """(arm, query_idx, p, ndcg, mrr) of the sealed rankings; ``judge`` is called only once they are sealed.

    ``plan`` names what is done (a configuration, say); judgments are (query_idx, doc_idx, grade).  A
    query without any judgment is an error.
    """
    rankings = sealed_rankings(spark, folder, plan, rank)
    own = _seal_of(spark, folder, "metrics", plan)
    if own is None:
        own = f"{folder}/metrics-{uuid.uuid4().hex}"
        qrels = judge()
        missing = rankings.select("query_idx").distinct().join(qrels.select("query_idx").distinct(), "query_idx", "left_anti").limit(5).collect()
        if missing:
            raise ValueError(f"queries without judgments: {[r.query_idx for r in missing]}")
        M.per_query(rankings, qrels).write.parquet(own)
        _sealed(spark, folder, "metrics", plan, own)
    return spark.read.parquet(own)
