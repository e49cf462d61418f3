"""Preparing a corpus of articles: every input file is accounted for, and every file written has its checksum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import stored
from .archives import article_files, checksums, listed
from .articles import ARTICLE, NO_META, PARSE_ERROR, PARSED, article_statuses

COUNTS = ["parse_error", "no_article_meta", "duplicate_id", "written", "with_abstract", "with_date", "with_pmid", "file_name_differs_from_article_id"]
_RECORD = ["_id", "pmc_in_file", "pmid", "title", "abstract", "pub_date", "article_type"]


def first_of_each(parsed: DataFrame) -> DataFrame:
    """The first record of each id, in the order of sources, paths and members; ids of many files are reduced before the shuffle."""
    place = F.struct("source", "path", "member", F.struct(*_RECORD).alias("record"))
    rows = parsed.where(F.col("status") == PARSED).groupBy(F.col("_id").alias("own")).agg(F.min(place).alias("first"))
    return rows.select("first.record.*")


def corpus_counts(parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of COUNTS from all files with their status and from the records kept.

    Both are stored frames: a metric observed in passing would count a task twice that ran twice.
    """
    of = lambda c: F.count(F.when(c, 1))
    files = parsed.agg(of(F.col("status") == PARSE_ERROR).alias("parse_error"), of(F.col("status") == NO_META).alias("no_article_meta"), of(F.col("status") == PARSED).alias("parsed"))
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    records = kept.agg(
        F.count(F.lit(1)).alias("written"), of(there("abstract")).alias("with_abstract"), of(there("pub_date")).alias("with_date"), of(there("pmid")).alias("with_pmid"),
        of(there("pmc_in_file") & (F.col("pmc_in_file") != F.col("_id"))).alias("file_name_differs_from_article_id"),
    )
    row = files.crossJoin(F.broadcast(records)).withColumn("duplicate_id", F.col("parsed") - F.col("written"))
    return row.select(*COUNTS)


def prepare_corpus(spark: SparkSession, sources: list[str], out: str) -> dict[str, int]:
    """Writes the articles of ``sources`` (folders or archives, in this order) to ``out`` as JSON lines, and returns COUNTS.

    Files are parsed once, into a stored table.  ``<out>.meta`` gets one JSON line: the step, the
    counts, and the checksums of the parts written and of the archives read.
    """
    files = [article_files(spark, path).withColumn("source", F.lit(at)) for at, path in enumerate(sources)]
    parsed = stored(article_statuses(reduce(DataFrame.unionByName, files)), "parsed")
    first_of_each(parsed).write.json(out)
    counts = corpus_counts(parsed, spark.read.schema(ARTICLE).json(out)).first().asDict()
    gathered = lambda df: F.array_sort(F.collect_list(F.struct(*df.columns)))
    parts = checksums(spark, out, "part-*").drop("path")
    inputs = [i for i, path in enumerate(sources) if listed(spark, path).select("path").limit(2).count() == 1]
    given = reduce(DataFrame.unionByName, [checksums(spark, sources[i]).drop("path") for i in inputs]) if inputs else parts.limit(0)
    meta = parts.agg(gathered(parts).alias("parts")).crossJoin(given.agg(gathered(given).alias("inputs")))
    total = F.struct(*[F.lit(counts[c]).alias(c) for c in COUNTS]).alias("counts")
    meta.select(F.lit("prepare-corpus").alias("step"), total, "parts", "inputs").coalesce(1).write.json(f"{out}.meta")
    return counts


def altered(spark: SparkSession, out: str) -> DataFrame:
    """(file, sha256): parts of a prepared corpus that its meta file does not name with this checksum; none if all is well."""
    named = spark.read.json(f"{out}.meta").select(F.explode("parts").alias("p")).select("p.file", "p.sha256")
    return checksums(spark, out, "part-*").select("file", "sha256").exceptAll(named)
