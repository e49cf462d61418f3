"""A pairwise learned ranker on pool features, with nested cross-fitting by topic.

All folds and penalties are fitted together: a pass over the pairs multiplies each batch with the
weights of all models at once and adds up, for every model, the loss, gradient and curvature of the
pairs that it may see.  Newton steps follow from these sums, so a handful of passes fits them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from .metrics import per_query
from .stages import cut

#: Passes at most, and the largest component of the gradient at which a model is done.
PASSES, SMALL = 60, 1e-9
#: Pairs that a task multiplies at once.
BATCH_PAIRS = 1024


@dataclass(frozen=True)
class Model:
    """Sees the pairs of queries outside ``outer`` and, if there is one, outside ``inner``; a fold of None leaves nothing out."""

    outer: int | None
    inner: int | None
    penalty: float


def dominance_pairs(items: DataFrame, limit: int | None = params.PAIRS_PER_QUERY, seed: str = "p") -> DataFrame:
    """(query_idx, better, worse, diff): pairs of a query's documents with unequal grades.

    ``items`` has query_idx, doc_idx, grade and features.  Where a query has more than ``limit``
    pairs, those of least md5 stay.
    """
    a = items.select("query_idx", F.col("doc_idx").alias("better"), F.col("grade").alias("ga"), F.col("features").alias("xa"))
    b = items.select("query_idx", F.col("doc_idx").alias("worse"), F.col("grade").alias("gb"), F.col("features").alias("xb"))
    pairs = a.join(b, "query_idx").where("ga > gb")
    if limit is not None:
        order = Window.partitionBy("query_idx").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "query_idx", "better", "worse")))
        pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return pairs.select("query_idx", "better", "worse", F.zip_with("xa", "xb", lambda x, y: x - y).alias("diff"))


def fold_of(query: Column, folds: int, seed: str = "") -> Column:
    """A query's fold from the md5 of its id; a seed gives another division."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), query.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def with_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Adds outer, the query's fold, and inner, for each outer fold the query's fold among those left."""
    inner = F.array(*[fold_of(F.col("query_idx"), folds, f"{k}|") for k in range(folds)])
    return rows.withColumns({"outer": fold_of(F.col("query_idx"), folds), "inner": inner})


def _sees(models: list[Model], outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """(row, model): whether a model may see a row of these folds."""
    out = np.ones((len(outer), len(models)), bool)
    for m, model in enumerate(models):
        if model.outer is not None:
            out[:, m] = outer != model.outer
            if model.inner is not None:
                out[:, m] &= inner[:, model.outer] != model.inner
    return out


def _sums(pairs: DataFrame, models: list[Model], weights: np.ndarray) -> dict[int, np.ndarray]:
    """For each model n, loss, gradient and curvature of its pairs, in one array; models without pairs are not there."""
    d = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 2 + d + d * d))
        for batch in batches:
            for s in range(0, batch.num_rows, BATCH_PAIRS):
                own = batch.slice(s, BATCH_PAIRS)
                x = own.column(0).flatten().to_numpy().reshape(-1, d)
                inner = own.column(2).flatten().to_numpy().reshape(len(x), -1)
                sees = _sees(models, own.column(1).to_numpy(), inner).astype(np.float64)
                margin = x @ weights.T
                loss = np.logaddexp(0, -margin)
                p = np.exp(-margin - loss)  # 1 / (1 + exp(margin))
                total[:, 0] += sees.sum(axis=0)
                total[:, 1] += (loss * sees).sum(axis=0)
                total[:, 2 : 2 + d] -= (p * sees).T @ x
                total[:, 2 + d :] += (p * (1 - p) * sees).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        some = np.flatnonzero(total[:, 0])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(some), lists], names=["model", "sums"])

    def added(group: pa.Table) -> pa.Table:
        x = group["sums"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        return pa.table({"model": group["model"].slice(0, 1), "sums": pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64()))})

    kinds = "model long, sums array<double>"
    parts = pairs.select("diff", "outer", "inner").mapInArrow(run, kinds)
    # a row for each model comes back, whatever the number of pairs
    return {r.model: np.array(r.sums) for r in parts.groupBy("model").applyInArrow(added, kinds).collect()}


def fit_all(pairs: DataFrame, models: list[Model], size: int) -> np.ndarray:
    """(model, feature): weights that minimise the mean logistic loss of a model's pairs plus penalty * |w|^2, without intercept.

    ``pairs`` has diff and the folds; a model without pairs has zeros.  A step that does not lower a
    model's loss is halved.
    """
    penalty = np.array([m.penalty for m in models])
    at, step = np.zeros((len(models), size)), np.zeros((len(models), size))
    best, open_ = np.full(len(models), np.inf), np.ones(len(models), bool)
    tried = at.copy()
    for _ in range(PASSES):
        here = np.flatnonzero(open_)
        if not len(here):
            break
        found = _sums(pairs, [models[i] for i in here], tried[here])
        for k, i in enumerate(here.tolist()):
            own = found.get(k)
            if own is None:
                open_[i] = False
                continue
            n = own[0]
            loss = own[1] / n + penalty[i] * tried[i] @ tried[i]
            if loss > best[i] + 1e-13:
                step[i] /= 2
            else:
                at[i], best[i] = tried[i], loss
                gradient = own[2 : 2 + size] / n + 2 * penalty[i] * at[i]
                if np.abs(gradient).max() < SMALL:
                    open_[i] = False
                    continue
                step[i] = -np.linalg.solve(own[2 + size :].reshape(size, size) / n + 2 * penalty[i] * np.eye(size), gradient)
            tried[i] = at[i] + step[i]
            open_[i] = np.abs(step[i]).max() > 1e-15
    return at


def _size(items: DataFrame, column: str) -> int:
    row = items.select(F.size(column).alias("n")).first()
    return row.n if row else 0


def fit(pairs: DataFrame, penalty: float) -> list[float]:
    """The weights of one model that sees all pairs (diff)."""
    rows = pairs.select("diff", F.lit(0).alias("outer"), F.array(F.lit(0)).alias("inner"))
    return fit_all(rows, [Model(None, None, penalty)], _size(pairs, "diff"))[0].tolist()


def scored(items: DataFrame, weights: Column) -> DataFrame:
    """Adds score, the product of features and an array of weights."""
    return items.withColumn("score", F.aggregate(F.zip_with("features", weights, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def _weights(models: dict[tuple, np.ndarray], *key: Column) -> Column:
    """The weights of the model whose key the columns name."""
    known = F.create_map(*[x for k, w in models.items() for x in (F.lit("|".join(map(str, k))), F.array(*[F.lit(float(v)) for v in w]))])
    return F.try_element_at(known, F.concat_ws("|", *[k.cast("string") for k in key]))


def cross_fit(items: DataFrame, qrels: DataFrame, folds: int = 5, grid: list[float] | None = None) -> tuple[DataFrame, list[float]]:
    """Held-out scores of every document, and each fold's penalty, chosen without it.

    In an outer fold the penalty is the one of best mean NDCG over the other queries, each scored by
    the model that has not seen its inner fold; the smaller of those that tie.  A fold without pairs
    to learn from scores 0.
    """
    grid = sorted(grid or params.PENALTIES)
    size = _size(items, "features")
    own = cut(with_folds(items, folds))
    pairs = cut(with_folds(dominance_pairs(items), folds))
    models = [Model(k, i, p) for k in range(folds) for i in [None, *range(folds)] for p in range(len(grid))]
    weights = fit_all(pairs, [Model(m.outer, m.inner, grid[m.penalty]) for m in models], size)
    held = {(m.outer, m.inner, m.penalty): w for m, w in zip(models, weights, strict=True)}

    tried = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("outer <> k")
    tried = tried.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    tried = scored(tried, _weights({k: w for k, w in held.items() if k[1] is not None}, F.col("k"), F.get("inner", F.col("k")), F.col("p")))
    order = Window.partitionBy("k", "p", "query_idx").orderBy(F.round("score", 9).desc(), "pool_rank")
    ranking = tried.select(F.concat_ws("|", "k", "p").alias("arm"), "query_idx", "doc_idx", F.row_number().over(order).alias("rank"))
    means = {r.arm: r.m for r in per_query(ranking, qrels).groupBy("arm").agg(F.round(F.avg("ndcg"), 12).alias("m")).collect()}  # folds x penalties
    chosen = [max(range(len(grid)), key=lambda p: (means.get(f"{k}|{p}", -1.0), -p)) for k in range(folds)]
    final = {(k,): held[k, None, p] for k, p in enumerate(chosen)}
    return scored(own, _weights(final, F.col("outer"))).drop("outer", "inner"), [grid[p] for p in chosen]
