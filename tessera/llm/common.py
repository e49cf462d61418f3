"""What the operators share: the shared folder, written intermediate tables, slices of batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import bounded_batches, give_back, shared_folder

#: Words as the contracts have them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]++"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends here, and executors may go."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column, modulus: int):
    """crc32 of the decimal text of an id, modulo: the folds that the contracts name."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


#: Bits of a map of ids that is broadcast; more ids only make it less selective.
MAP_BITS = 1 << 24


def id_map(ids: DataFrame) -> DataFrame:
    """A written bit map of the hashes of ``ids`` (id), at most MAP_BITS bits whatever their number.

    A row that no id meets keeps the map from being empty, so that plans do not depend on the data.
    """
    own = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    bits = ids.where("id is not null").select(own.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("tessera_w"))
    bits = bits.agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("tessera_v"))
    return written(bits.union(ids.sparkSession.range(1).select(F.lit(-1), F.lit(0).cast("long"))), "map")


def marked(df: DataFrame, bits: DataFrame, id_col: str, output: str) -> DataFrame:
    """Adds ``output``: false where the row's id is surely not in the map ``bits``, else true.

    The map is broadcast, so that a join on ids need only move rows that may match.  Null ids are false.
    """
    place = F.pmod(F.xxhash64(id_col), F.lit(MAP_BITS))
    row = df.withColumn("tessera_p", place).withColumn("tessera_w", F.shiftright("tessera_p", 6).cast("int"))
    row = row.join(F.broadcast(bits), "tessera_w", "left")
    hit = F.expr("shiftright(tessera_v, cast(tessera_p % 64 as int)) & 1L") == 1
    columns = [F.col(f"`{c}`") for c in df.columns]
    return row.select(*columns, (F.coalesce(hit, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()).alias(output))


#: Rows of a key from which on it counts as hot, and the parts that a hot key's rows are spread over.
HOT_ROWS, SALTS = 512, 64


def salted_join(rows: DataFrame, side: DataFrame, key: str, spread: Column, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a key; both need distinct column names.

    With ``how`` "left" rows whose key the side lacks stay, with nulls.

    Rows whose key is in the map ``hot`` (see ``id_map``) are spread by ``spread`` over SALTS parts, to
    each of which the side's one row is copied; so no key's rows meet in one task.
    """
    left = marked(rows, hot, key, "tessera_hot").withColumn("tessera_salt", F.when(F.col("tessera_hot"), F.pmod(F.xxhash64(spread, F.lit(71)), F.lit(SALTS)).cast("int")).otherwise(0))
    right = marked(side, hot, key, "tessera_hot").withColumn("tessera_salt", F.explode(F.when(F.col("tessera_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.drop("tessera_hot").join(right.drop("tessera_hot"), [key, "tessera_salt"], how).drop("tessera_salt")


def slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` in total size (an item above it stands alone)."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield slice(begin, i)
            begin = i
            total = 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def text_parts(batch: pa.RecordBatch, at: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batch in pieces of about ``limit`` bytes of the texts in column ``at``, with these texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    for part in slices(sizes, limit):
        own = batch.slice(part.start, part.stop - part.start)
        yield own, own.column(at).to_pylist()
    give_back()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
