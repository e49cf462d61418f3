"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions alone.

Every source gets a target number of words by weight, at most ``cap`` times what it has.  The mix
is counted in blocks of equally many words.  Blocks are apportioned to sources by highest
quotients, and each source's blocks to its shards in the same way, so that every shard has an
integer quota.  The documents of a shard, in seeded order, form a circle of words cut into blocks;
a quota is whole turns of the circle and a run of blocks from a seeded start.  So at most two or
three documents of a shard are taken in part, a document is taken floor or ceiling of the shard's
rate times, and each source's words meet its target up to half a block.

Shards hold about ``per_shard`` documents; a source with a third of all rows just has more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Source tables up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000
WORD_AND_SPACE = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _shard(doc_id: Column, size: Column, count: Column, seed: int) -> Column:
    """The shard of a document; by its size as well, so that rows without an id do not share one."""
    return F.pmod(F.xxhash64(doc_id, size, F.lit(seed)), count)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its size, documents, weight and target.

    Sources in order of code points, null last, take the weights in turn.  Together they get
    ``share`` times all words; no target passes ``cap`` times its source's size, and what is cut
    there is shared again by weight among the others.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    sources = sources.withColumn("level", level).withColumn("place", F.row_number().over(by_level))
    free = F.col("level") * F.col("weight") <= F.col("most")
    first = F.min(F.when(free, F.struct("place", "level"))).over(everything)
    capped = F.col("place") < F.coalesce(first["place"], F.lit(1 << 30))
    target = F.when(capped, F.col("most")).otherwise(F.least(F.col("most"), first["level"] * F.col("weight")))
    return sources.withColumn("target", target).select("source", "source_size", "source_docs", "weight", "target")


def sainte_lague(votes: DataFrame, seats: str, vote: str = "vote", group: list[str] | None = None, key: str = "key") -> DataFrame:
    """Adds ``quota``: the group's seats, given one by one to the highest vote/(2k+1).

    Ties go to the smaller key.  Quotients that must win and those that cannot are known from the
    divisor; only about three a row lie between, and only these are ranked.
    """
    own = Window.partitionBy(*(group or []))
    n = F.count(F.lit(1)).over(own)
    total = F.greatest(F.sum(vote).over(own), F.lit(1e-9))
    low = F.floor(F.col(vote) * F.greatest(F.col(seats) - n, F.lit(0)) / total + 0.5)
    low = F.when(F.col(seats) > n, low).otherwise(F.lit(0)).cast("long")
    high = F.floor(F.col(vote) * (F.col(seats) + n) / total + 0.5).cast("long")
    bounded = votes.withColumn("low", low).withColumn("high", F.greatest(high, F.col("low")))
    bounded = bounded.withColumn("open", F.col(seats) - F.sum("low").over(own))
    between = F.when(F.col("high") > F.col("low"), F.sequence(F.col("low"), F.col("high") - 1))
    ranked = bounded.withColumn("k", F.explode_outer(between))
    order = Window.partitionBy(*(group or [])).orderBy((F.col(vote) / (2 * F.col("k") + 1)).desc_nulls_last(), F.col(key).asc_nulls_last(), "k")
    ranked = ranked.withColumn("won", (F.col("k").isNotNull() & (F.row_number().over(order) <= F.col("open"))).cast("long"))
    return ranked.groupBy(*votes.columns).agg((F.first("low") + F.sum("won")).alias("quota"))


def quotas(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, per_shard: int = 4096, most_words: int = 1024, seed: int = 17) -> DataFrame:
    """One row per shard of ``sized`` (doc_id, source, size): its words, quota and what fixes its run.

    A block has ``most_words`` words, or a 64th of the least positive target where that is less.
    """
    targets = written(source_targets(sized, weights, share, cap), "targets")
    block = F.greatest(F.lit(1), F.least(F.lit(most_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy()) / 64)))
    sources = targets.withColumn("block", F.coalesce(block, F.lit(1)).cast("long"))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_docs") / per_shard)).cast("long"))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("long"))
    sources = sainte_lague(sources, "seats", "target", key="source").withColumnRenamed("quota", "source_quota").drop("seats")
    sources = written(sources, "sources")
    with_shards = _join_sources(sized.select("doc_id", "source", "size"), sources, ["source_size", "target", "block", "shards", "source_quota"])
    with_shards = with_shards.withColumn("shard", _shard(F.col("doc_id"), F.col("size"), F.col("shards"), seed))
    shards = with_shards.groupBy("source", "source_size", "target", "block", "shards", "source_quota", "shard").agg(F.sum("size").alias("words"))
    shards = sainte_lague(shards.withColumn("vote", F.col("words").cast("double")), "source_quota", "vote", ["source"], "shard").drop("vote")
    words = F.greatest(F.col("words"), F.lit(1))
    wanted = F.least(F.col("quota") * F.col("block"), (F.col("words") * cap).cast("long"))
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), F.greatest(F.ceil(F.col("words") / F.col("block")), F.lit(1))) * F.col("block")
    shards = shards.withColumn("turns", F.when(F.col("words") > 0, F.floor(wanted / words)).otherwise(F.lit(0)).cast("long"))
    shards = shards.withColumn("run", F.when(F.col("words") > 0, wanted - F.col("turns") * words).otherwise(F.lit(0)).cast("long"))
    return written(shards.withColumn("start", start.cast("long")), "quotas")


def _join_sources(rows: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    small = sources.count() <= BROADCAST_SOURCES
    side = sources.select(F.col("source").alias("tessera_source"), *columns)
    side = F.broadcast(side) if small else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("tessera_source")), "left").drop("tessera_source")


def mix(docs: DataFrame, quota: DataFrame, seed: int = 17) -> DataFrame:
    """What the mix takes of each row of ``docs``, which must have doc_id, source and size.

    Adds source_size, target, taken, and the word ranges of the partial turn: first_from,
    first_until (from the run's start on) and second_from, second_until (where the run wraps), with
    ``turns`` whole copies before them.  All other columns pass unchanged, whatever their names.  A
    row of size 0 is taken 0 times; null ids and sources are values like others; repeated rows are
    rows of their own, and where they tie their order is of no consequence.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "source", "size")]
    rows = docs.select("doc_id", "source", "size", F.struct(*[F.col(f"`{c}`") for c in extra] or [F.lit(0)]).alias("tessera_others"))
    shards = quota.select("source", "shards").groupBy("source").agg(F.first("shards").alias("shards"))
    rows = _join_sources(rows, shards, ["shards"])
    rows = rows.withColumn("shard", _shard(F.col("doc_id"), F.col("size"), F.col("shards"), seed)).drop("shards")
    side = quota.select(F.col("source").alias("tessera_source"), F.col("shard").alias("tessera_shard"), "source_size", "target", "words", "turns", "run", "start")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id", "size")
    rows = rows.withColumn("until", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("tessera_source")) & (F.col("shard") == F.col("tessera_shard")), "left")
    begin, end = F.col("until") - F.col("size"), F.col("until")
    stop = F.col("start") + F.col("run")
    zero = F.lit(0).cast("long")

    def within(x: Column) -> Column:
        return F.greatest(zero, F.least(F.col("size"), x - begin))

    rows = rows.withColumns({
        "first_from": within(F.col("start")),
        "first_until": within(F.least(stop, F.col("words"))),
        "second_from": zero,
        "second_until": within(F.greatest(zero, stop - F.col("words"))),
    })
    rows = rows.withColumn("taken", F.col("turns") * (end - begin) + F.col("first_until") - F.col("first_from") + F.col("second_until"))
    back = [F.col("tessera_others")[c].alias(c) for c in extra]
    return rows.select("doc_id", *back, "source", "size", "source_size", "target", "taken", "turns", "first_from", "first_until", "second_from", "second_until")


def draw(mixed: DataFrame, row: str, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The mix itself: a row for each whole copy of a document and for each part taken of one.

    ``row`` is a column of ``mixed`` that holds the document's own columns.  A part is the words of
    its range with the white space between them; ``n_chars``, if there, follows the text.  Rows of
    size 0, of which the mix takes nothing, go.
    """
    size, fields = F.col("size"), mixed.schema[row].dataType
    whole = (F.col("first_from") == 0) & (F.col("first_until") == size)
    ranges = F.concat(
        F.when(F.col("turns") > 0, F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), size.alias("b")), F.col("turns").cast("int"))).otherwise(F.array()),
        F.when(whole | (F.col("first_until") > F.col("first_from")), F.array(F.struct(F.col("first_from").alias("a"), F.col("first_until").alias("b")))).otherwise(F.array()),
        F.when(F.col("second_until") > 0, F.array(F.struct(F.col("second_from").alias("a"), F.col("second_until").alias("b")))).otherwise(F.array()),
    )
    rows = mixed.where(size > 0).withColumn("tessera_range", F.explode(ranges))
    a, b, own = F.col("tessera_range.a"), F.col("tessera_range.b"), F.col(row)[text]
    words = F.regexp_extract_all(own, F.lit(f"({WORD_AND_SPACE})"), F.lit(1))
    part = F.regexp_replace(F.array_join(F.slice(words, (a + 1).cast("int"), (b - a).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    rows = rows.select(row, F.when((a == 0) & (b == size), own).otherwise(part).alias("tessera_text"))
    return rows.select(*[_field(row, f, text, n_chars) for f in fields])


def _field(row: str, field, text: str, n_chars: str) -> Column:
    if field.name == text:
        return F.col("tessera_text").alias(text)
    if field.name == n_chars:
        return F.length("tessera_text").cast(field.dataType).alias(n_chars)
    return F.col(row)[field.name].alias(field.name)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return mix(sized, quotas(sized)).select("doc_id", "size", "source_size", "target", "taken", "source", "turns")
