"""Incremental scoring: articles that arrive as a stream get their evidence level and weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.articles import ARTICLE


def article_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def with_evidence(articles: DataFrame) -> DataFrame:
    """Stateless, so it serves batches and streams alike."""
    level = T.evidence_level(F.col("title"), F.col("abstract"))
    return articles.withColumn("evidence_level", level).withColumn("evidence_weight", T.evidence_weight(F.col("evidence_level")))


def write_scored(articles: DataFrame, path: str, checkpoint: str):
    return with_evidence(articles).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
