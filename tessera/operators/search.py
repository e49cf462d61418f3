"""BM25, vector and hybrid search over a stored index, and reranking.

Positions (doc_idx, query_idx, place in a pool) are columns, since a DataFrame has no order; every
ranking orders by score and then by the position it had before.  A BM25 score is summed in whole
picounits, so the sum does not depend on the order of its parts and equal documents tie exactly.

A document is one row of the index, and up to BROADCAST_QUERIES queries go to every task (more come
in parts).  So a task knows the whole score of each of its pairs: batches of documents meet the
queries as matrices, and only the best of a task leave it, to be ranked among those of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import scores as S
from ..functions import text as T
from .index import Index, build_index  # noqa: F401
from .stages import bounded_batches, cut, pieces, stored

#: Query tables up to so many rows may be broadcast.
BROADCAST_QUERIES = 20_000
UNIT = 1e12


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, if the frame is small enough to be broadcast."""
    return F.broadcast(df) if df.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else df


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_idx, term, times): a term that a query repeats counts as often."""
    return queries.select("query_idx", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_idx", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass
class Asked:
    """Up to BROADCAST_QUERIES queries as the tasks hold them: their terms by term, and their vectors."""

    ids: pa.Array
    terms: pa.Array
    idf: np.ndarray
    begin: np.ndarray  # of a term's queries in ``query`` and ``times``
    query: np.ndarray
    times: np.ndarray
    avgdl: float
    vectors: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None

    def bm25(self, batch: pa.RecordBatch, k1: float, b: float) -> np.ndarray:
        """Scores (document, query) of a batch (doc_idx, dl, terms, tfs, ...): exact sums of whole picounits."""
        terms, tfs = batch.column("terms"), batch.column("tfs")
        size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        at = pc.index_in(terms.flatten(), self.terms)
        there = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.drop_null().to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), size)[there]
        tf = tfs.flatten().to_numpy()[there]
        dl = batch.column("dl").to_numpy()[doc]
        part = np.floor(self.idf[at] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / self.avgdl))) * UNIT + 0.5)
        begin, n = self.begin[at], self.begin[at + 1] - self.begin[at]
        own = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(doc * len(self.ids), n) + self.query[own]
        total = np.bincount(cell, weights=self.times[own] * np.repeat(part, n), minlength=batch.num_rows * len(self.ids))
        return (total / UNIT).reshape(batch.num_rows, len(self.ids))


def query_parts(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts of at most about BROADCAST_QUERIES; nearly always one."""
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        return [queries]
    held, parts = cut(queries), 2 * -(-n // BROADCAST_QUERIES)
    return [held.where(F.pmod(F.xxhash64("query_idx"), F.lit(parts)) == k) for k in range(parts)]


def asked_of(index: Index, queries: DataFrame, vectors: tuple[str, ...] = (), unit: bool = True) -> Asked:
    """One part of the queries, collected, with what the index says of their terms."""
    rows = queries.select("query_idx", *vectors).toArrow()
    ids = rows["query_idx"].combine_chunks()
    known = query_terms(queries).join(index.terms, "term").select("query_idx", "term", "times", "df").toArrow()
    terms = known["term"].combine_chunks().dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False) if len(known) else np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    begin = np.searchsorted(code[order], np.arange(len(terms.dictionary) + 1))
    df = known["df"].to_numpy()[order][begin[:-1]] if len(known) else np.zeros(0)
    query = pc.index_in(known["query_idx"], ids).to_numpy()[order] if len(known) else code
    times = known["times"].to_numpy()[order].astype(np.float64) if len(known) else np.zeros(0)
    found = {}
    for c in vectors:
        given = [v for v in rows[c].to_pylist() if v]
        found[c] = _rows(rows[c], len(given[0]) if given else 1, unit)
    return Asked(ids, terms.dictionary, np.log((index.n - df + 0.5) / (df + 0.5) + 1), begin, query, times, index.avgdl, found)


#: Scores are ranked by 9 decimals; within so much of the k-th a score may still belong to the k best.
MARGIN = 2e-9


class Best:
    """The k best documents of each query among those that one task has seen, and all that may tie with them."""

    def __init__(self, k: int, queries: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.held: list[np.ndarray] = []
        self.size, self.most = 0, max(100_000, 4 * k * queries)

    def add(self, docs: np.ndarray, score: np.ndarray, *more: np.ndarray, where: np.ndarray | None = None) -> None:
        keep = score >= self.floor - MARGIN
        row, query = np.nonzero(keep if where is None else keep & where)
        self.held.append(np.rec.fromarrays([query, docs[row], score[row, query], *[m[row, query] for m in more]]))
        self.size += len(row)
        if self.size > self.most:
            self.trim()

    def trim(self) -> np.ndarray | None:
        """What is left: by query, falling score and document."""
        if not self.held:
            return None
        x = np.concatenate(self.held)
        x = x[np.lexsort((x["f1"], -x["f2"], x["f0"]))]
        query, score = x["f0"], x["f2"]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(x) else np.zeros(0, np.int64)
        last = first + self.k - 1
        full = last < np.append(first[1:], len(x))
        self.floor[query[first[full]]] = score[last[full]]
        run = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (score[1:] != score[:-1]))) if len(x) else first
        place = np.arange(len(x)) - np.repeat(run, np.diff(np.append(run, len(x))))
        x = x[(score >= self.floor[query] - MARGIN) & (place < self.k)]
        self.held, self.size = [x], len(x)
        return x


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _per_part(queries: DataFrame, scored) -> DataFrame:
    bounded_batches(queries.sparkSession)
    return reduce(DataFrame.unionByName, [scored(part) for part in query_parts(queries)])


def bm25_scores(index: Index, queries: DataFrame, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """(query_idx, doc_idx, bm25) of the pairs that share a term; all other pairs score 0.

    A document lies in one row of the index and the queries go to all tasks, so no pair is shuffled.
    """
    rows = index.rows.select("doc_idx", "dl", "terms", "tfs")

    def scored(part: DataFrame) -> DataFrame:
        asked = asked_of(index, part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in pieces(batches):
                score = asked.bm25(own, k1, b)
                doc, query = np.nonzero(score)
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), own.column(0).take(pa.array(doc)), pa.array(score[doc, query])], names=["query_idx", "doc_idx", "bm25"])

        return rows.mapInArrow(run, f"query_idx {_kind(part, 'query_idx')}, doc_idx {_kind(rows, 'doc_idx')}, bm25 double")

    return _per_part(queries, scored)


def bm25_best(index: Index, queries: DataFrame, k: int, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """(query_idx, doc_idx, bm25): of the matches of each query, those that may be among its k best.

    What leaves a task is its own k best and their ties, however many documents match.
    """
    rows = index.rows.select("doc_idx", "dl", "terms", "tfs")

    def scored(part: DataFrame) -> DataFrame:
        asked = asked_of(index, part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k, len(asked.ids))
            for own in pieces(batches):
                score = asked.bm25(own, k1, b)
                best.add(own.column(0).to_numpy(), score, where=score != 0)
            left = best.trim()
            if left is not None:
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(left["f0"])), pa.array(left["f1"]), pa.array(left["f2"])], names=["query_idx", "doc_idx", "bm25"])

        return rows.mapInArrow(run, f"query_idx {_kind(part, 'query_idx')}, doc_idx {_kind(rows, 'doc_idx')}, bm25 double")

    return _per_part(queries, scored)


def ranked(scored: DataFrame, score: Column, position: str, k: int | None, by: str = "query_idx") -> DataFrame:
    """Adds rank from 1 by falling score (to 9 places), ties by position; keeps the first k."""
    order = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), position)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def bm25_search(index: Index, queries: DataFrame, k: int = params.SEARCH_K, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """(query_idx, doc_idx, bm25, rank): the best k; documents without a match fill up in corpus order."""
    return filled(index, queries, ranked(bm25_best(index, queries, k, k1, b), F.col("bm25"), "doc_idx", k), k)


def filled(index: Index, queries: DataFrame, matched: DataFrame, k: int) -> DataFrame:
    """The k best matches (query_idx, doc_idx, bm25, rank), filled up to k with documents that score 0.

    A query with fewer than k matches has a filler among the first 2k documents, so only those meet
    the queries.
    """
    matched = stored(matched, "matched")  # read three times below
    first = index.rows.select("doc_idx").orderBy("doc_idx").limit(2 * k)
    filler = queries.select("query_idx").crossJoin(F.broadcast(first)).withColumn("bm25", F.lit(0.0))
    short = queries.select("query_idx").join(matched.groupBy("query_idx").agg(F.count(F.lit(1)).alias("n")), "query_idx", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_idx")
    filler = filler.join(short, "query_idx", "left_semi").join(matched.select("query_idx", "doc_idx"), ["query_idx", "doc_idx"], "left_anti")
    return ranked(matched.drop("rank").unionByName(filler.select("query_idx", "doc_idx", "bm25")), F.col("bm25"), "doc_idx", k)


def _standard(sums: DataFrame, n: Column) -> DataFrame:
    """(query_idx, mean, sd) of sums (query_idx, s, ss) over n documents; a deviation that is nothing but rounding counts as 0."""
    variance = F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n)
    return sums.select("query_idx", (F.col("s") / n).alias("mean"), F.when(variance > 1e-18, F.sqrt(variance)).otherwise(F.lit(0.0)).alias("sd"))


def bm25_moments(index: Index, queries: DataFrame) -> DataFrame:
    """(query_idx, mean, sd): of BM25 over the whole corpus, zeros included, the mean and population deviation.

    Scores are added up where they are made; a sum and a sum of squares of each query leave a task.
    """
    rows = index.rows.select("doc_idx", "dl", "terms", "tfs")

    def scored(part: DataFrame) -> DataFrame:
        asked = asked_of(index, part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, squares = np.zeros(len(asked.ids)), np.zeros(len(asked.ids))
            for own in pieces(batches):
                score = asked.bm25(own, params.K1, params.B)
                total += score.sum(axis=0)
                squares += (score * score).sum(axis=0)
            yield pa.RecordBatch.from_arrays([asked.ids, pa.array(total), pa.array(squares)], names=["query_idx", "s", "ss"])

        return rows.mapInArrow(run, f"query_idx {_kind(part, 'query_idx')}, s double, ss double")

    sums = _per_part(queries, scored).groupBy("query_idx").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    return _standard(sums.where("s > 0"), F.lit(index.n))


def vector_best(docs: DataFrame, queries: DataFrame, k: int, unit: bool) -> DataFrame:
    """(query_idx, doc_idx, product): what may be among each query's k best products, of unit vectors if ``unit``.

    Every document has a product; it is 0 where a vector is missing, zero or of another length.
    """
    rows = docs.select("doc_idx", "embedding")

    def scored(part: DataFrame) -> DataFrame:
        asked = part.select("query_idx", "embedding").toArrow()
        given = [v for v in asked["embedding"].to_pylist() if v]
        d = len(given[0]) if given else 1
        matrix, ids = _rows(asked["embedding"], d, unit), asked["query_idx"].combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k, len(ids))
            for own in pieces(batches):
                best.add(own.column(0).to_numpy(), _rows(own.column(1), d, unit) @ matrix.T)
            left = best.trim()
            if left is not None:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left["f0"])), pa.array(left["f1"]), pa.array(left["f2"])], names=["query_idx", "doc_idx", "product"])

        return rows.mapInArrow(run, f"query_idx {_kind(part, 'query_idx')}, doc_idx {_kind(rows, 'doc_idx')}, product double")

    return _per_part(queries, scored)


def vector_search(docs: DataFrame, queries: DataFrame, k: int = params.POOL_K, unit: bool = True) -> DataFrame:
    """(query_idx, doc_idx, product, rank): the k best documents by cosine, or by product of the vectors as they are."""
    return ranked(vector_best(docs, queries, k, unit), F.col("product"), "doc_idx", k)


def _rows(vectors, d: int, unit: bool) -> np.ndarray:
    """A matrix of the vectors; of zeros where one is missing, holds nulls or has another length."""
    x = np.array([v if v is not None and len(v) == d and None not in v else [0.0] * d for v in vectors.to_pylist()], np.float64).reshape(-1, d)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if unit else x


def _hybrid(index: Index, queries: DataFrame, beta: float, k: int | None, vectors: tuple[str, ...]) -> DataFrame:
    """(seed, query_idx, doc_idx, bm25, z, cosine, hybrid): all pairs, or with ``k`` those that may be among the best.

    ``vectors`` are columns of both the index and the queries; a seed is a place among them.  They
    share one scan and one BM25, so that several sets of vectors cost little more than one.
    """
    rows = index.rows.select("doc_idx", "dl", "terms", "tfs", *vectors)
    moments = bm25_moments(index, queries)
    names = ["seed", "query_idx", "doc_idx", "bm25", "z", "cosine", "hybrid"]

    def scored(part: DataFrame) -> DataFrame:
        asked = asked_of(index, part, vectors)
        found = moments.join(part.select("query_idx"), "query_idx", "left_semi").toArrow()
        asked.mean, asked.sd = np.zeros(len(asked.ids)), np.zeros(len(asked.ids))
        at = pc.index_in(found["query_idx"], asked.ids).to_numpy()
        asked.mean[at], asked.sd[at] = found["mean"].to_numpy(), found["sd"].to_numpy()

        def batch_of(seed: int, query: np.ndarray, doc: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(query), seed), pa.int32()), asked.ids.take(pa.array(query)), doc, *map(pa.array, columns)], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(k or 1, len(asked.ids)) for _ in vectors]
            for own in pieces(batches):
                bm25 = asked.bm25(own, params.K1, params.B)
                z = np.where(asked.sd > 0, (bm25 - asked.mean) / np.where(asked.sd > 0, asked.sd, 1.0), 0.0)
                for seed, c in enumerate(vectors):
                    matrix = asked.vectors[c]
                    cosine = _rows(own.column(c), matrix.shape[1], True) @ matrix.T
                    hybrid = beta * z + (1 - beta) * cosine
                    if k is None:
                        doc, query = (x.ravel() for x in np.indices(hybrid.shape))
                        yield batch_of(seed, query, own.column(0).take(pa.array(doc)), bm25.ravel(), z.ravel(), cosine.ravel(), hybrid.ravel())
                    else:
                        best[seed].add(own.column(0).to_numpy(), hybrid, bm25, z, cosine)
            for seed, own in enumerate(best):
                left = own.trim()
                if left is not None:
                    yield batch_of(seed, left["f0"], pa.array(left["f1"]), left["f3"], left["f4"], left["f5"], left["f2"])

        kinds = f"seed int, query_idx {_kind(part, 'query_idx')}, doc_idx {_kind(rows, 'doc_idx')}, bm25 double, z double, cosine double, hybrid double"
        return rows.mapInArrow(run, kinds)

    return _per_part(queries, scored)


def hybrid_scores(index: Index, queries: DataFrame, beta: float = params.BETA) -> DataFrame:
    """(query_idx, doc_idx, bm25, z, cosine, hybrid) for every query and document, for sums over all of them.

    Queries have query_idx, text and embedding.  Missing vectors have cosine 0.
    """
    return _hybrid(index, queries, beta, None, ("embedding",)).drop("seed")


def hybrid_search(index: Index, queries: DataFrame, beta: float = params.BETA, k: int = params.POOL_K) -> DataFrame:
    """The k best of ``hybrid_scores`` with their rank; what leaves a task is its own k best a query."""
    return ranked(_hybrid(index, queries, beta, k, ("embedding",)).drop("seed"), F.col("hybrid"), "doc_idx", k)


def hybrid_searches(index: Index, queries: DataFrame, vectors: tuple[str, ...], beta: float = params.BETA, k: int = params.POOL_K) -> DataFrame:
    """``hybrid_search`` for several sets of vectors in one pass; ``seed`` is the place in ``vectors``."""
    found = _hybrid(index, queries, beta, k, vectors)
    order = Window.partitionBy("seed", "query_idx").orderBy(F.round("hybrid", 9).desc(), "doc_idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_idx, doc_idx) of documents (doc_idx, text) that hold the text of a passage (query_idx, text).

    A part of the passages is one automaton, and a text is read once for all of them.  A null text
    holds nothing, and a null or empty passage is held by none.
    """

    def scored(part: DataFrame) -> DataFrame:
        given = part.where("text <> ''").select("query_idx", "text").toArrow()
        ids: dict[str, list[int]] = {}
        for at, text in enumerate(given["text"].to_pylist()):
            ids.setdefault(text, []).append(at)
        names = given["query_idx"].combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = ahocorasick.Automaton()
            for text, own in ids.items():
                found.add_word(text, own)
            found.make_automaton()
            for batch in pieces(batches):
                doc, query = [], []
                for row, text in enumerate(batch.column(1).to_pylist() if ids else []):
                    held = {q for _, own in found.iter(text) for q in own} if text else ()
                    doc += [row] * len(held)
                    query += held
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query, pa.int64())), batch.column(0).take(pa.array(doc, pa.int64()))], names=["query_idx", "doc_idx"])

        return docs.select("doc_idx", "text").mapInArrow(run, f"query_idx {_kind(part, 'query_idx')}, doc_idx {_kind(docs, 'doc_idx')}")

    return _per_part(passages, scored)


def relevance_factors(pool: DataFrame, docs: DataFrame, queries: DataFrame, as_of: Column) -> DataFrame:
    """The pool with each factor of the composite: cosine, apply, action, tau, evidence."""
    asked = queries.select("query_idx", F.col("embedding").alias("q_embedding"), F.col("population").alias("q_population"))
    held = docs.select(
        "doc_idx", "embedding", "population", T.actionability(F.col("title"), F.col("abstract")).alias("action"),
        F.coalesce(S.temporal_decay(F.col("publication_date"), as_of, F.col("domain")), F.lit(1.0)).alias("tau"), T.evidence_weight(F.col("evidence_level")).alias("evidence"),
    )
    rows = pool.drop("cosine").join(held, "doc_idx").join(small(asked), "query_idx")
    rows = rows.withColumn("cosine", F.coalesce(S.cosine(F.col("embedding"), F.col("q_embedding")), F.lit(0.0)))
    return rows.withColumn("apply", S.applicability(F.col("population"), F.col("q_population"))).drop("embedding", "q_embedding", "population", "q_population")


def rerank(factors: DataFrame, k: int | None = params.RERANK_K, weights: dict[str, float] | None = None, use_tau: bool = True, use_evidence: bool = True) -> DataFrame:
    """The pool (query_idx, doc_idx, rank and factors) by the composite; ties keep the pool's order."""
    score = S.composite(F.col("cosine"), F.col("apply"), F.col("action"), F.col("tau"), F.col("evidence"), weights, use_tau, use_evidence)
    scored = factors.withColumn("score", score).withColumnRenamed("rank", "pool_rank")
    return ranked(scored, F.col("score"), "pool_rank", k)
