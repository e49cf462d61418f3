"""Source divergence audit: how far the sources of a language are from each other, term by term.

A source's chance of a term depends on the term's count there alone, so the divergence of two sources
is a sum over their joint count histogram: how many terms have count a in one and count b in the
other.  Tasks tally the distinct combinations of blocks of terms, with one number for each; Spark adds
the tallies up.  Terms that one source lacks are implied: the source's own histogram less what the
tally holds gives the cells (a, 0), and the number of terms gives (0, 0).  The divergence is worked
out once for each combination and taken times its number.  All arithmetic is on whole numbers.

Texts are cut into terms with Arrow: the bytes of all terms of a slice lie in one buffer, are
numbered by a dictionary, and counted by number.  No hash stands for a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, id_map, salted_join, table, text_parts, written
from .hashing import joined

SLICE_BYTES = 2_000_000
#: Counts of terms in a block, and sources of a block of sources; a task tallies pairs of such blocks.
BLOCK_CELLS, BLOCK_SOURCES = 65_536, 256
#: Pairs of counts looked at together.
PAIRS = 1 << 20

# [^\x00-\x40\x5B-\x60\x7B-\x7F]: ASCII letters and everything beyond ASCII
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(texts: list[str | None]) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of the texts in order, A-Z lower-cased, and each text's terms end."""
    data, ends = joined(texts)
    inner = _TERM[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inner]]))
    return found, np.searchsorted(begin, ends)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents with the term, of (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in text_parts(batch, 2, SLICE_BYTES):
                found, ends = terms_of(texts)
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                names, term = coded.dictionary, coded.indices.to_numpy()
                groups = pa.StructArray.from_arrays([own.column(0), own.column(1)], names=["l", "s"])
                pairs = [(r["l"], r["s"]) for r in groups.to_pylist()]
                number = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
                of_doc = np.array([number[p] for p in pairs])
                doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
                key, times = np.unique(doc * len(names) + term, return_counts=True)
                key = of_doc[key // len(names)] * len(names) + key % len(names)
                key, place = np.unique(key, return_inverse=True)
                n, in_docs = np.bincount(place, weights=times).astype(np.int64), np.bincount(place)
                at = list(number)
                lang, source = (pa.array([p[i] for p in at], pa.string()).take(pa.array(key // len(names))) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, names.take(pa.array(key % len(names))), pa.array(n), pa.array(in_docs)], names=["lang", "source", "term", "n", "docs"])

    found = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chance(count: Column, n: Column, v: Column, unit: int = 1_000_000_000) -> Column:
    """1 + floor(unit * (count + 2) / (n + 2 * v)), exactly; ``v`` is not 0 where a count exists."""
    wide = lambda c: c.cast("decimal(18,0)")
    over = F.greatest(n + 2 * v, F.lit(1))
    return (F.call_function("div", F.lit(unit).cast("decimal(10,0)") * wide(count + 2), wide(over)) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 and a few."""
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def tally(lang, source: np.ndarray, side: np.ndarray, term: np.ndarray, n: np.ndarray, same: bool) -> pa.Table:
    """(lang, a, b, ca, cb, k): terms with count ca in source a and cb in b, a < b, both above 0.

    ``side`` is 0 or 1 by the block of sources; where the blocks differ only pairs across them count.
    """
    order = np.argsort(term, kind="stable")
    source, side, term = source[order], side[order], term[order]
    counts, code = np.unique(n[order], return_inverse=True)
    names, place = np.unique(source, return_inverse=True)
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(term)))
    first, width = np.repeat(begin, size), np.repeat(size, size)
    keys, totals = [], []
    done = 0
    ends = np.cumsum(width)
    while done < len(term):
        # all of the next cells whose pairs fit, one at least
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
        left = np.repeat(np.arange(done, stop), width[done:stop])
        within = np.arange(len(left)) - np.repeat(np.cumsum(width[done:stop]) - width[done:stop], width[done:stop])
        right = first[left] + within
        keep = source[left] < source[right]
        if not same:
            keep &= side[left] != side[right]
        left, right = left[keep], right[keep]
        key = ((place[left] * len(names) + place[right]) * len(counts) + code[left]) * len(counts) + code[right]
        key, k = np.unique(key, return_counts=True)
        keys.append(key)
        totals.append(k)
        done = stop
    key, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    k = np.bincount(at, weights=np.concatenate(totals)).astype(np.int64) if len(key) else key
    key, cb = np.divmod(key, len(counts) or 1)
    key, ca = np.divmod(key, len(counts) or 1)
    a, b = np.divmod(key, len(names) or 1)
    return pa.table({"lang": pa.array([lang] * len(k), pa.string()), "a": pa.array(names[a]), "b": pa.array(names[b]), "ca": pa.array(counts[ca]), "cb": pa.array(counts[cb]), "k": pa.array(k)})


def _to_pairs(rows: DataFrame, *kept: str) -> DataFrame:
    """Rows of sources once for every pair (i, j) of blocks of sources of the language that theirs is in."""
    own = F.floor(F.col("sid") / BLOCK_SOURCES)
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / BLOCK_SOURCES)))
    rows = rows.withColumn("own", own).withColumn("other", other)
    return rows.select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", *kept)


def joint_counts(cells: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, k) over all terms, of cells (lang, sid, term, n, sources, blocks)."""
    rows = _to_pairs(cells.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))), "block", "term", "n")

    def run(groups: pa.Table) -> pa.Table:
        term = groups["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        i, j = groups["i"][0].as_py(), groups["j"][0].as_py()
        return tally(groups["lang"][0].as_py(), groups["sid"].to_numpy(), (groups["own"].to_numpy() == j).astype(np.int8), term, groups["n"].to_numpy(), i == j)

    kinds = "lang string, a long, b long, ca long, cb long, k long"
    found = rows.groupBy("lang", "i", "j", "block").applyInArrow(run, kinds)
    return found.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("k").alias("k"))


def pair_values(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources of a language, a < b; groups are (lang, sid, sources, n, v)."""
    tallied = written(joint_counts(cells), "joint_counts")
    own = cells.groupBy("lang", "sid", "n").agg(F.count(F.lit(1)).alias("m"))
    own = own.groupBy("lang", "sid").agg(F.collect_list(F.struct(F.col("n").alias("c"), "m")).alias("histogram"), F.sum("m").alias("held"))
    blocks = _to_pairs(groups.join(own, ["lang", "sid"], "left"), "n", "v", "histogram", "held")
    left = blocks.select("lang", "i", "j", F.col("own").alias("ba"), F.col("sid").alias("a"), F.col("n").alias("na"), "v", F.col("histogram").alias("ha"), F.coalesce("held", F.lit(0)).alias("ma"))
    right = blocks.select("lang", "i", "j", F.col("own").alias("bb"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("histogram").alias("hb"), F.coalesce("held", F.lit(0)).alias("mb"))
    # sources of one block meet under (i, i) alone, those of two blocks under theirs
    pairs = left.join(right, ["lang", "i", "j"]).where("a < b and (i = j or ba <> bb)")
    cell = lambda ca, cb, k: F.struct(ca.cast("long").alias("ca"), cb.cast("long").alias("cb"), k.cast("long").alias("k"))
    none = F.lit(0)
    alone = F.concat(
        F.transform(F.coalesce("ha", F.array().cast("array<struct<c:bigint,m:bigint>>")), lambda x: cell(x["c"], none, x["m"])),
        F.transform(F.coalesce("hb", F.array().cast("array<struct<c:bigint,m:bigint>>")), lambda x: cell(none, x["c"], x["m"])),
        F.array(cell(none, none, F.col("v") - F.col("ma") - F.col("mb"))),
    )
    alone = pairs.select("lang", "a", "b", F.explode(alone).alias("x")).select("lang", "a", "b", "x.ca", "x.cb", "x.k")
    # a term that both have is in neither of the two histograms' cells beside 0, and was taken off (0, 0) twice
    shared = tallied.select("lang", "a", "b", F.explode(F.array(cell(F.col("ca"), F.col("cb"), F.col("k")), cell(F.col("ca"), none, -F.col("k")), cell(none, F.col("cb"), -F.col("k")), cell(none, none, F.col("k")))).alias("x"))
    cells_ = alone.unionByName(shared.select("lang", "a", "b", "x.ca", "x.cb", "x.k")).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("k").alias("k")).where("k <> 0")
    f = divergence(chance(F.col("ca"), F.col("na"), F.col("v")), chance(F.col("cb"), F.col("nb"), F.col("v")))
    summed = cells_.join(pairs.select("lang", "a", "b", "na", "nb", "v"), ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f * F.col("k")).alias("value"))
    return pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0)).alias("value"))


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): sources against each other, and each one's marked terms.

    Null texts, languages and sources are empty strings; every row is a document, repeated ones too.
    A language keeps the terms that ``least_docs`` of its documents hold.  Part ``pair`` has every other
    source of the language, part ``term`` the ``top`` terms commoner in the source than in the
    language; ranks fall with the value, ties go by the item's UTF-8 bytes.  Sources without kept
    terms take part; without any kept term in the language all pairs are 0.  No documents: no rows.
    The result has a row for any two sources of a language, so that is what its size goes by.
    """
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = written(counted(given), "term_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(kept, "kept_terms")
    cells = written(counts.drop("docs").join(kept, ["lang", "term"]), "cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
    groups = given.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["n", "cells"])
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    of_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("cells").alias("lang_cells")).join(langs, "lang", "left").fillna(0, ["v", "lang_n"])
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("sid")
    key = F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), F.col("source"))
    groups = groups.select("lang", "source", "n", "cells", place).join(of_lang, "lang").withColumn("blocks", F.ceil(F.greatest("lang_cells", F.lit(1)) / BLOCK_CELLS)).withColumn("tessera_group", key)
    groups = written(groups, "sources")
    hot = id_map(groups.where(F.col("cells") > HOT_ROWS).select(F.col("tessera_group").alias("id")))
    side = groups.select("tessera_group", "sid", "sources", "blocks", F.col("n").alias("source_n"), "v", "lang_n")
    cells = written(salted_join(cells.withColumn("tessera_group", key), side, "tessera_group", F.col("term"), hot).drop("tessera_group"), "source_cells")

    values = pair_values(groups.select("lang", "sid", "sources", "n", "v"), cells.select("lang", "sid", "term", "n", "sources", "blocks"))
    both = F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other")), F.struct(F.col("b").alias("sid"), F.col("a").alias("other")))).alias("x")
    both = written(values.select("lang", both, "value").select("lang", "x.sid", "x.other", "value"), "pair_values")
    names = groups.select("lang", "sid", "source")
    pair = both.join(names, ["lang", "sid"]).join(names.select("lang", F.col("sid").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    p, q = chance(F.col("n"), F.col("source_n"), F.col("v")), chance(F.col("total"), F.col("lang_n"), F.col("v"))
    term = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", order.alias("rank"))
    return rows(pair, "pair").unionByName(rows(term, "term").where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))
