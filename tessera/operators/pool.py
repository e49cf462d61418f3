"""Arms over a pool of candidates: normalised modules, gates, features and reorderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params

def z(x: Column, window=None) -> Column:
    """Population z-score in the window (a query's pool); 0 throughout where all values are equal."""
    window = window or Window.partitionBy("query_idx")
    spread = F.stddev_pop(x).over(window)
    return F.when(F.max(x).over(window) > F.min(x).over(window), (x - F.avg(x).over(window)) / spread).otherwise(F.lit(0.0))


def filled(x: Column, window=None) -> Column:
    """Missing values take the window's mean; 0 where all are missing."""
    return F.coalesce(x, F.avg(x).over(window or Window.partitionBy("query_idx")), F.lit(0.0))


def gate_table(spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
    """(question_type, one 0/1 column per module); ``columns`` renames the types, as permuted gates do."""
    types = list(params.GATES)
    rows = [(t, *[float(g) for g in params.GATES[c]]) for t, c in zip(types, columns or types, strict=True)]
    return spark.createDataFrame(rows, "question_type string, " + ", ".join(f"g_{m} double" for m in params.MODULES))


def normalised(modules: DataFrame) -> DataFrame:
    """Adds z_<module>: missing scores filled, then z within the query's pool."""
    whole = modules.withColumns({f"f_{m}": filled(F.col(m)) for m in params.MODULES})
    return whole.withColumns({f"z_{m}": z(F.col(f"f_{m}")) for m in params.MODULES}).drop(*[f"f_{m}" for m in params.MODULES])


def gated(rows: DataFrame, gates: DataFrame, off: tuple[str, ...] = ("applicability",)) -> Column:
    """Sum of z over the open gates of ``rows`` (joined with gates on question_type), less modules that are off."""
    parts = [F.col(f"g_{m}") * F.col(f"z_{m}") for m in params.MODULES if m not in off]
    return reduce(lambda a, b: a + b, parts)


def features(rows: DataFrame) -> Column:
    """6 z-scores, then the 6 again for each question type (zeros for the others): 30 numbers."""
    zs = [F.col(f"z_{m}") for m in params.MODULES]
    blocks = [F.when(F.col("question_type") == t, x).otherwise(F.lit(0.0)) for t in params.GATES for x in zs]
    return F.array(*zs, *blocks)


def arm(pool: DataFrame, name: str, score: Column, position: str = "pool_rank") -> DataFrame:
    """The pool reordered by a score, ties in pool order: (arm, query_idx, doc_idx, rank)."""
    order = Window.partitionBy("query_idx").orderBy(F.round(score, 9).desc(), position)
    return pool.select(F.lit(name).alias("arm"), "query_idx", "doc_idx", F.row_number().over(order).alias("rank"))


def drawn(seed: Column | str, *parts: Column) -> Column:
    """A uniform number in [0, 1) from the md5 of a seed and its parts: the same in any engine."""
    text = F.concat_ws("|", F.lit(seed) if isinstance(seed, str) else seed, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def gaussians(seed: str, key: Column, size: int) -> Column:
    """``size`` (even) independent standard normal numbers from md5: two uniforms give two (Box and Muller)."""
    text = lambda i: F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string")))
    uniform = lambda h, at: F.conv(F.substring(h, at, 12), 16, 10).cast("double") / F.lit(float(1 << 48))

    def pair(h: Column) -> Column:
        r, angle = F.sqrt(-2 * F.ln(1 - uniform(h, 1))), 2 * F.pi() * uniform(h, 13)
        return F.array(r * F.cos(angle), r * F.sin(angle))

    return F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.lit(size // 2 - 1)), text), pair))


def shuffled(pool: DataFrame, draws: int, seed: str = "r", score: Column | None = None) -> DataFrame:
    """(draw, query_idx, doc_idx, rank): ``draws`` random orders of every pool, by falling ``score`` first."""
    first = F.round(score, 9) if score is not None else F.lit(0.0)
    rows = pool.select("query_idx", "doc_idx", first.alias("score")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = Window.partitionBy("draw", "query_idx").orderBy(F.desc("score"), drawn(seed, F.col("draw"), F.col("query_idx"), F.col("doc_idx")), "doc_idx")
    return rows.withColumn("rank", F.row_number().over(order)).drop("score")
