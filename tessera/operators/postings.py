"""Postings of a stored index in blocks of documents with their maxima, and an exact search that skips blocks.

The table has a row for each term and block of BLOCK_DOCS document numbers, in folders by a hash of the
term, sorted by term in each.  A search reads the folders of its terms only.  It bounds each block from
the maxima, scores the most promising blocks, and then those whose bound reaches the k-th score found.

The maximum of a block is kept as the pairs (tf, dl) that no other pair of the block beats in both, so it
is exact for any k1, b and mean length: appended documents change neither tables nor bounds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import scores as S
from .index import Index
from .search import MARGIN, UNIT, filled, query_terms, ranked, small
from .stages import stored

BLOCK_DOCS = 512
#: Folders by term: a search of few terms reads as many folders.
FOLDERS = 256
_POSTED = "segment string, folder string, block_docs long"


@dataclass
class Postings:
    """``index`` with its rows (term, block, n, front, docs, tfs, dls) of postings, ``folder`` first for pruning."""

    index: Index
    rows: DataFrame


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def blocks_of(rows: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(folder, term, block, n, front, docs, tfs, dls) of an index's rows; a group is one term in at most block_docs documents."""
    each = rows.select("doc_idx", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    own = F.struct("doc_idx", F.col("p.tfs").alias("tf"), "dl")
    block = F.expr(f"doc_idx div {block_docs}")
    found = each.groupBy(F.col("p.terms").alias("term"), block.alias("block")).agg(F.array_sort(F.collect_list(own)).alias("p"))
    by_length = F.array_sort(F.transform("p", lambda x: F.struct(x["dl"].alias("dl"), (-x["tf"]).alias("less"))))
    none = F.slice(by_length, 1, 0)
    front = F.aggregate(by_length, none, lambda held, x: F.when((F.size(held) == 0) | (x["less"] < F.element_at(held, -1)["less"]), F.concat(held, F.array(x))).otherwise(held))
    part = lambda c: F.transform("p", lambda x: x[c])
    return found.select(
        _folder(F.col("term")).alias("folder"), "term", "block", F.size("p").alias("n"), F.transform(front, lambda x: F.struct((-x["less"]).alias("tf"), x["dl"].alias("dl"))).alias("front"),
        part("doc_idx").alias("docs"), part("tf").alias("tfs"), part("dl").alias("dls"),
    )


def _posted(index: Index) -> dict[str, tuple[str, int]]:
    try:
        lines = index.rows.sparkSession.read.schema(_POSTED).parquet(f"{index.path}/posted").collect()  # a row for each segment
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return {x.segment: (x.folder, x.block_docs) for x in sorted(lines, key=lambda x: x.folder, reverse=True)}


def postings_of(index: Index, block_docs: int = BLOCK_DOCS) -> Postings:
    """The postings of a stored index, made once for each of its segments; a segment's line is written last."""
    spark = index.rows.sparkSession
    have = _posted(index)
    lack = [s for s in index.segments if s not in have]
    for segment in lack:
        folder = uuid.uuid4().hex
        made = blocks_of(spark.read.parquet(f"{index.path}/rows/{segment}"), block_docs)
        made.repartition("folder").sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{index.path}/postings/{folder}")
        spark.createDataFrame([(segment, folder, block_docs)], _POSTED).coalesce(1).write.mode("append").parquet(f"{index.path}/posted")
    have = _posted(index) if lack else have
    if len({have[s][1] for s in index.segments}) > 1:
        raise ValueError("segments have blocks of different sizes")
    schema = blocks_of(index.rows).schema
    read = [spark.read.schema(schema).parquet(f"{index.path}/postings/{have[s][0]}") for s in index.segments]
    return Postings(index, reduce(DataFrame.unionByName, read))


def _impact(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.lit(avgdl)))


def _weighted(index: Index, queries: DataFrame) -> DataFrame:
    """(query_idx, term, times, idf, folder) of the terms that the index knows."""
    idf = S.idf(F.lit(index.n), F.col("df"))
    return query_terms(queries).join(index.terms, "term").select("query_idx", "term", "times", idf.alias("idf"), _folder(F.col("term")).alias("folder"))


def _met(postings: Postings, terms: DataFrame, *columns: str) -> DataFrame:
    """Query terms with the blocks of each; of the postings only ``columns`` are read, and only in the terms' folders."""
    rows = postings.rows.select("folder", "term", "block", *columns)
    folders = [r.folder for r in terms.select("folder").distinct().collect()]  # at most FOLDERS
    return rows.where(F.col("folder").isin(folders)).join(small(terms), ["folder", "term"])


def query_postings(postings: Postings, queries: DataFrame) -> DataFrame:
    """(query_idx, doc_idx, term, times, tf): the postings of each query's terms, from the folders of these terms."""
    met = _met(postings, stored(_weighted(postings.index, queries), "asked"), "docs", "tfs")
    rows = met.select("query_idx", "term", "times", F.explode(F.arrays_zip("docs", "tfs")).alias("p"))
    return rows.select("query_idx", F.col("p.docs").alias("doc_idx"), "term", "times", F.col("p.tfs").alias("tf"))


def query_documents(postings: Postings, queries: DataFrame) -> DataFrame:
    """(query_idx, documents, met): how many documents hold a term of each query, and how many postings they are.

    Documents are counted within their block, so whole blocks move and no posting on its own.
    """
    met = _met(postings, stored(_weighted(postings.index, queries), "asked"), "n", "docs")
    held = F.size(F.array_distinct(F.flatten(F.collect_list("docs"))))
    each = met.groupBy("query_idx", "block").agg(held.alias("documents"), F.sum("n").alias("met"))
    return each.groupBy("query_idx").agg(F.sum("documents").alias("documents"), F.sum("met").alias("met"))


def _scores(postings: Postings, picks: DataFrame, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_idx, doc_idx, bm25) of the documents in the blocks picked (query_idx, block): sums of whole picounits."""
    wanted = picks.select("query_idx", "block").join(terms, "query_idx")
    rows = postings.rows.select("folder", "term", "block", "docs", "tfs", "dls")
    folders = [r.folder for r in terms.select("folder").distinct().collect()]
    met = rows.where(F.col("folder").isin(folders)).join(wanted, ["folder", "term", "block"])
    each = met.select("query_idx", "times", "idf", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    part = F.floor(F.col("idf") * _impact(F.col("p.tfs"), F.col("p.dls"), postings.index.avgdl, k1, b) * UNIT + 0.5) * F.col("times")
    return each.groupBy("query_idx", F.col("p.docs").alias("doc_idx")).agg((F.sum(part) / UNIT).alias("bm25"))


@dataclass
class Searched:
    """``matched`` (query_idx, doc_idx, bm25, rank), and ``blocks`` (query_idx, block, bound, postings, scored): what was read for it."""

    matched: DataFrame
    blocks: DataFrame


def block_search(postings: Postings, queries: DataFrame, k: int = params.SEARCH_K, k1: float = params.K1, b: float = params.B) -> Searched:
    """The k best matches of each query by BM25, exactly those of a scan; blocks that cannot hold one are not scored.

    A query begins with its k best blocks by bound, each of which holds a match at least.  The k-th
    score among them is a floor for the others.  A query with fewer than k blocks and matches has no
    floor, and all its blocks are scored.  Queries without a known term have no rows.
    """
    terms = stored(_weighted(postings.index, queries), "asked")
    most = F.array_max(F.transform("front", lambda x: _impact(x["tf"], x["dl"], postings.index.avgdl, k1, b)))
    met = _met(postings, terms, "n", "front").select("query_idx", "block", "n", (F.col("times") * F.col("idf") * most).alias("bound"))
    bounds = stored(met.groupBy("query_idx", "block").agg(F.sum("bound").alias("bound"), F.sum("n").alias("postings")), "bounds")
    order = Window.partitionBy("query_idx").orderBy(F.col("bound").desc(), "block")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_idx", "block")
    begun = stored(ranked(_scores(postings, first, terms, k1, b), F.col("bm25"), "doc_idx", k), "begun")
    floors = begun.where(F.col("rank") == k).select("query_idx", F.col("bm25").alias("floor"))
    marked = bounds.join(first.withColumn("begun", F.lit(True)), ["query_idx", "block"], "left").join(floors, "query_idx", "left")
    reaches = F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - MARGIN)
    marked = stored(marked.select("query_idx", "block", "bound", "postings", F.col("begun").isNotNull().alias("begun"), (F.col("begun").isNotNull() | reaches).alias("scored")), "blocks")
    rest = _scores(postings, marked.where("scored and not begun"), terms, k1, b)
    matched = ranked(begun.drop("rank").unionByName(rest), F.col("bm25"), "doc_idx", k)
    return Searched(matched, marked.drop("begun"))


def bm25_block_search(postings: Postings, queries: DataFrame, k: int = params.SEARCH_K, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """``bm25_search`` by blocks: the same rows, documents without a match included."""
    return filled(postings.index, queries, block_search(postings, queries, k, k1, b).matched, k)
