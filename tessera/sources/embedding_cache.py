"""A cache of embeddings that is read through: texts that it lacks are encoded once and written back.

Its key is the hash of the model's name and the text, so equal texts share an entry and another model
has entries of its own.  Entries come in segments; a segment counts once its line is in the table of
segments, which is written last.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, embedding array<float>"
SEGMENT = "segment string, entries long"
Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(size: int = 64) -> Encoder:
    """Stands in for a model: signed counts of hashed words, of length 1."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                out[row, h % size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def key_of(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), text), 256)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, embedding) of all segments; empty where there is no cache yet."""
    try:
        segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments").collect()  # a row for each run that had misses
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(*[f"{path}/entries/{s.segment}" for s in segments])


def encoded(misses: DataFrame, encode: Encoder, batch: int = 64, per_part: int = 20_000) -> DataFrame:
    """(key, embedding) of (key, text): texts of like length lie together, so that batches need little padding."""
    parts = max(1, -(-misses.count() // per_part))
    rows = misses.repartitionByRange(parts, F.length("text"), "key").sortWithinPartitions(F.length("text"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for s in range(0, own.num_rows, batch):
                part = own.slice(s, batch)
                vectors = np.asarray(encode(part.column(1).to_pylist()), np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), vectors.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "embedding"])

    return rows.select("key", "text").mapInArrow(run, ENTRY)


def fill(texts: DataFrame, path: str, model: str, encode: Encoder, text: str = "text") -> int:
    """Encodes what the cache at ``path`` lacks of the texts, writes it back, and returns how many entries that were."""
    spark = texts.sparkSession
    wanted = texts.where(F.col(text).isNotNull()).select(key_of(model, F.col(text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    misses = wanted.join(entries(spark, path).select("key"), "key", "left_anti")
    if misses.isEmpty():
        return 0
    segment = uuid.uuid4().hex
    encoded(misses, encode).write.parquet(f"{path}/entries/{segment}")
    n = spark.read.schema(ENTRY).parquet(f"{path}/entries/{segment}").count()
    spark.createDataFrame([(segment, n)], SEGMENT).coalesce(1).write.mode("append").parquet(f"{path}/segments")
    return n


def with_embeddings(texts: DataFrame, path: str, model: str, text: str = "text") -> DataFrame:
    """The texts with what the cache holds for them; null texts have no embedding."""
    own = texts.withColumn("tessera_key", key_of(model, F.col(text)))
    cache = entries(texts.sparkSession, path).withColumnRenamed("key", "tessera_key").dropDuplicates(["tessera_key"])
    return own.join(cache, "tessera_key", "left").drop("tessera_key")
