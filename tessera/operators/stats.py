"""Paired statistics and decision rules on per-query results (arm, query_idx, ndcg)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from .stages import cut


def differences(metrics: DataFrame, one: str, other: str, value: str = "ndcg") -> DataFrame:
    """(query_idx, diff) of two arms on the queries that both have."""
    a = metrics.where(F.col("arm") == one).select("query_idx", F.col(value).alias("x"))
    b = metrics.where(F.col("arm") == other).select("query_idx", F.col(value).alias("y"))
    return a.join(b, "query_idx").select("query_idx", (F.col("x") - F.col("y")).alias("diff"))


def paired(diffs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, mean, sample deviation (0 for one row), wins, losses, ties, and the effect seen with 80 % power."""
    sd = F.coalesce(F.stddev_samp("diff"), F.lit(0.0))
    n = F.count(F.lit(1))
    count = lambda c: F.sum(c.cast("long"))
    return diffs.groupBy(*(by or [])).agg(
        n.alias("n"), F.avg("diff").alias("mean"), sd.alias("sd"), count(F.col("diff") > 0).alias("wins"), count(F.col("diff") < 0).alias("losses"),
        count(F.col("diff") == 0).alias("ties"), (2.8 * sd / F.sqrt(n.cast("double"))).alias("mde80"),
    )


#: Draws of a block: its counts are one matrix, which meets the differences in one product.
BLOCK_DRAWS = 256


def _uniforms(seed: str, draws: np.ndarray, keys: list) -> np.ndarray:
    """(draw, key) uniform numbers in [0, 1): those of ``pool.drawn``."""
    out = np.empty((len(draws), len(keys)))
    for i, draw in enumerate(draws.tolist()):
        begun = hashlib.md5(f"{seed}|{draw}|".encode())
        for j, key in enumerate(keys):
            whole = begun.copy()
            whole.update(str(key).encode())
            out[i, j] = int.from_bytes(whole.digest()[:6], "big")
    return out / float(1 << 48)


def _over_draws(wide: DataFrame, names: list[str], draws: int, weights) -> DataFrame:
    """(draw, a mean for each name): ``weights(draws, keys)`` times the differences, over the number of rows.

    ``wide`` has query_idx and a column of differences for each name: a few numbers a query, which go
    to every task.  The draws are spread over the cluster, and one row leaves for each.
    """
    held = wide.select("query_idx", *[F.col(f"`{n}`") for n in names]).orderBy("query_idx").toPandas()
    keys, x = held["query_idx"].tolist(), held[names].to_numpy(np.float64)

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            for s in range(0, len(own), BLOCK_DRAWS):
                block = own[s : s + BLOCK_DRAWS]
                means = weights(block, keys) @ x / max(len(keys), 1)
                yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(means[:, i]) for i in range(len(names))]], names=["draw", *names])

    spark = wide.sparkSession
    rows = spark.range(draws if keys else 0, numPartitions=spark.sparkContext.defaultParallelism)
    return rows.mapInArrow(run, ", ".join(["draw long", *[f"`{n}` double" for n in names]]))


def resampled_means(wide: DataFrame, names: list[str], draws: int, seed: str = "b") -> DataFrame:
    """(draw, means): resamples of the rows with replacement, the same for all names; drawn by md5 so that reruns agree."""

    def counts(block: np.ndarray, keys: list) -> np.ndarray:
        n = len(keys)
        at = np.floor(_uniforms(seed, block, list(range(n))) * n).astype(np.int64)
        return np.bincount((at + np.arange(len(block))[:, None] * n).ravel(), minlength=len(block) * n).reshape(len(block), n).astype(np.float64)

    return _over_draws(wide, names, draws, counts)


def flipped_means(wide: DataFrame, names: list[str], draws: int, seed: str = "s") -> DataFrame:
    """(draw, means) with random signs by md5 of the query, the same for all names."""
    return _over_draws(wide, names, draws, lambda block, keys: np.where(_uniforms(seed, block, keys) < 0.5, -1.0, 1.0))


def bootstrap_means(diffs: DataFrame, draws: int, seed: str = "b") -> DataFrame:
    """(draw, mean): means of resamples of (query_idx, diff)."""
    return resampled_means(diffs, ["diff"], draws, seed).select("draw", F.col("diff").alias("mean"))


#: A mean of flipped differences within so much of the one seen counts as reaching it.
REACHED = 1e-12


def p_values(wide: DataFrame, names: list[str], draws: int, seed: str = "s") -> DataFrame:
    """(name, p), two-sided: (1 + draws whose mean is as far from 0) / (draws + 1)."""
    seen = wide.agg(*[F.abs(F.avg(F.col(f"`{n}`"))).alias(n) for n in names]).first()
    reached = lambda n: F.sum((F.abs(F.col(f"`{n}`")) >= F.lit(seen[n]) - REACHED).cast("long"))
    row = flipped_means(wide, names, draws, seed).agg(*[((1 + F.coalesce(reached(n), F.lit(0))) / (draws + 1.0)).alias(n) for n in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("p")) for n in names])).alias("t")).select("t.*")


def intervals(wide: DataFrame, names: list[str], draws: int, seed: str = "b") -> DataFrame:
    """(name, mean, lo, hi): means and their percentiles 2.5 and 97.5 over resamples."""
    row = resampled_means(wide, names, draws, seed).agg(*[F.percentile(F.col(f"`{n}`"), F.array(F.lit(0.025), F.lit(0.975))).alias(n) for n in names])
    seen = wide.agg(*[F.avg(F.col(f"`{n}`")).alias(f"{n}_mean") for n in names])
    each = [F.struct(F.lit(n).alias("name"), F.col(f"`{n}_mean`").alias("mean"), F.col(f"`{n}`")[0].alias("lo"), F.col(f"`{n}`")[1].alias("hi")) for n in names]
    return row.crossJoin(F.broadcast(seen)).select(F.explode(F.array(*each)).alias("t")).select("t.*")


def in_columns(diffs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(query_idx, a column for each name) of diffs (name, query_idx, diff), and the names in order."""
    names = [r[0] for r in diffs.select("name").distinct().orderBy("name").collect()]  # the comparisons' names
    return diffs.groupBy("query_idx").pivot("name", names).agg(F.first("diff")), names


def interval(means: DataFrame) -> DataFrame:
    """Percentiles 2.5 and 97.5, interpolated."""
    cut = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(cut.alias("c")).select(F.col("c")[0].alias("ci_lo"), F.col("c")[1].alias("ci_hi"))


def sign_flip_p(diffs: DataFrame, draws: int, seed: str = "s") -> DataFrame:
    """One row, p: of the mean of (query_idx, diff)."""
    return p_values(diffs, ["diff"], draws, seed).select("p")


def holm(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Adds p_holm, the step-down adjusted p-value."""
    order = Window.orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    step = (m - F.row_number().over(order) + 1) * F.col(p)
    out = tests.withColumn("tessera_step", step)
    running = F.max("tessera_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("p_holm", F.least(F.lit(1.0), running)).drop("tessera_step")


def spearman(rows: DataFrame, x: str, y: str, by: str = "query_idx") -> DataFrame:
    """Rank correlation per group, ties at their average rank; null where a side is constant."""

    def average_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2.0

    own = rows.select(by, average_rank(x).alias("rx"), average_rank(y).alias("ry"))
    varied = (F.max("rx") > F.min("rx")) & (F.max("ry") > F.min("ry"))
    return own.groupBy(by).agg(F.when(varied, F.corr("rx", "ry")).alias("rho"))


def equivalence(lo: Column, hi: Column, margin: float = params.EQUIVALENCE_MARGIN) -> Column:
    inside = (lo > -margin) & (hi < margin)
    return F.when(inside, "equivalent").when(lo > 0, "better").when(hi < 0, "worse").otherwise("inconclusive")


def pool_verdict(ratio: Column, overlap: Column) -> Column:
    return F.when((ratio > 3) & (overlap >= 0.7), "contradicted").when(ratio < 1.5, "supported").otherwise("mixed")


def tie_verdict(gain: Column, artefact: Column) -> Column:
    return F.when(gain <= 0, "nothing to explain").when(artefact >= 0.5 * gain, "artefact").when(artefact < 0.25 * gain, "not an artefact").otherwise("partial")


def sensitivity(mean: Column, worst: Column) -> Column:
    return F.when((F.abs(mean) > 0.03) | (worst > 0.04), "sensitive").otherwise("not sensitive")


def encoder_verdict(lo: Column, hi: Column) -> Column:
    """Of cosine-only against random reranking, from the interval of their difference."""
    return F.when(hi < 0, "harmful").when(lo > 0, "informative").otherwise("no detectable information")


def driver_verdict(rho_evidence: Column, rho_cosine: Column) -> Column:
    return F.when(rho_evidence > rho_cosine + 0.2, "evidence weight dominates").otherwise("evidence weight does not dominate")


def control_ok(mean: Column) -> Column:
    """Whether the BM25 rerank of the pool stays within 0.01 of BM25."""
    return F.abs(mean) <= 0.01


def decide(t: dict[str, Column]) -> Column:
    """The decision of a test from its statistics, first rule that holds.

    ``t``: positive_lo (P - M), primary_mean, primary_lo, primary_hi (M - B0), manipulated, for f, u
    and v (M - F, U, V) <k>_mean and <k>_p, and noise_hi (N - B0).
    """
    gain = (t["primary_mean"] >= 0.05) & (t["primary_lo"] > 0)
    beats = {k: (t[f"{k}_p"] < 0.05) & (t[f"{k}_mean"] > 0) for k in "fuv"}
    return (
        F.when(t["positive_lo"] <= 0, "Test failed")
        .when(t["primary_hi"] < 0.05, "Refuted")
        .when(~t["manipulated"], "Untestable")
        .when(gain & beats["f"] & beats["u"] & beats["v"] & (t["noise_hi"] < 0.05), "Supported")
        .when(gain & (~beats["u"] | ~beats["v"] | (t["noise_hi"] >= 0.05)), "Gain without attribution")
        .otherwise("Inconclusive")
    )


#: Comparisons that are adjusted together; M-L where the learned arm is there.
FAMILY = ("M-F", "M-U", "M-V", "M-L", "M-Rbar")


def statistics(diffs: DataFrame, draws: int = params.BOOTSTRAP_DRAWS, flips: int = params.SIGN_FLIPS) -> DataFrame:
    """(name, mean, lo, hi, p, p_holm) of comparisons (name, query_idx, diff); p_holm for those of FAMILY.

    All comparisons share their resamples and sign flips.
    """
    wide, names = in_columns(diffs)
    wide = cut(wide)
    tests = p_values(wide, names, flips)
    adjusted = holm(tests.where(F.col("name").isin(*FAMILY))).select("name", "p_holm")
    return intervals(wide, names, draws).join(tests, "name").join(adjusted, "name", "left")


def analysis(stats: DataFrame, manipulated: DataFrame) -> DataFrame:
    """The decision over ``statistics``, one row: decision, qualifiers and what the decision rests on.

    M-B0 is the primary comparison, Nbar-B0 and Pbar-M are the controls.  ``learned_beats``: a learned
    combination beats the designed one; ``mapping_adds``: the question-type mapping adds something
    beyond gating as such.
    """
    every = ("M-B0", "M-F", "M-U", "M-V", "M-L", "M-Rbar", "Nbar-B0", "Pbar-M")
    value = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    row = stats.agg(*[value(n, c).alias(f"{n}_{c}") for n in every for c in ("mean", "lo", "hi", "p_holm")]).crossJoin(F.broadcast(manipulated))
    of = lambda k, what: F.col(f"`{k}_{what}`")
    t = {"positive_lo": of("Pbar-M", "lo"), "primary_mean": of("M-B0", "mean"), "primary_lo": of("M-B0", "lo"), "primary_hi": of("M-B0", "hi"), "manipulated": F.col("manipulated"), "noise_hi": of("Nbar-B0", "hi")}
    t |= {f"{k.lower()}_mean": of(f"M-{k}", "mean") for k in "FUV"} | {f"{k.lower()}_p": of(f"M-{k}", "p_holm") for k in "FUV"}
    mapping = (of("M-Rbar", "p_holm") < 0.05) & (of("M-Rbar", "mean") > 0)
    learned = F.coalesce((of("M-L", "p_holm") < 0.05) & (of("M-L", "mean") < 0), F.lit(False))
    return row.select(decide(t).alias("decision"), learned.alias("learned_beats"), mapping.alias("mapping_adds"), *[F.round(c, 6).alias(k) if k != "manipulated" else c.alias(k) for k, c in t.items()])


def same_lists(rankings: DataFrame, one: str, other: str, k: int = params.CUTOFF) -> DataFrame:
    """(query_idx, same): whether two arms have the same ordered first k."""
    lists = rankings.where((F.col("rank") <= k) & F.col("arm").isin(one, other)).groupBy("query_idx", "arm")
    lists = lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_idx"))), lambda x: x["doc_idx"]).alias("docs"))
    a = lists.where(F.col("arm") == one).select("query_idx", F.col("docs").alias("a"))
    b = lists.where(F.col("arm") == other).select("query_idx", F.col("docs").alias("b"))
    return a.join(b, "query_idx").select("query_idx", (F.col("a") == F.col("b")).alias("same"))
