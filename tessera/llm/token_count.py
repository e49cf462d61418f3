"""Token counts by a tokenizer compiled to a finite-state transducer (see ``transducer``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_parts, tokenizer_path
from .transducer import machine

#: Bytes of text that run through the machine at once.
SLICE_CHARS = 1_000_000


def with_token_counts(docs: DataFrame, text: str = "text", output: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """Adds the number of tokens of each whole text; a narrow pass without a shuffle.

    Special strings inside a text count as the one token they are to the library; none is added.
    A null or empty text has 0 tokens.  All other columns pass unchanged, whatever their names;
    an existing column named ``output`` is replaced.  Repeated rows are counted each.
    """
    path = tokenizer or tokenizer_path()
    kept = [c for c in docs.columns if c != output]
    given = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    schema = given.withColumn(output, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = machine(path)
        for batch in batches:
            for own, texts in text_parts(batch, at, SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(counter.count(texts), pa.int64())], names=[*kept, output])

    return given.mapInArrow(run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )
