"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars.

A document's shingles are hashed once.  The leading bits of a hash name a bin, and each bin keeps
its least hash; an empty bin takes the value of another, found by a probe sequence that depends on
the bin alone.  Runs of ``rows`` bins are bands; documents with an equal band share a bucket.

Documents of equal shingle sets are one class, and only its least id enters the buckets.  In each
bucket the least id is a hub and stands in candidate pairs with the others: a star, not all pairs.
Every id is confirmed, on the full sets, against the hub that it shares most buckets with, and the
components of these links close most buckets.  In what stays open, ids of different components are
compared exactly: pair by pair in small buckets, as products of matrices in large ones, where only
ids outside the largest component meet the others and only a spanning forest leaves.  So any two
ids that share a bucket have been compared or are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, id_map, marked, salted_join, table, text_parts, written
from .components import components, local_roots
from .hashing import mixed, words
from .transducer import forget

BINS = 256
ROWS = 6
SLICE_CHARS = 500_000
#: Open buckets up to this size compare all pairs across components; larger ones form crowds.
SMALL_BUCKET = 24
#: Pairs of one hub that are compared in a row; a hub of more has several runs.
RUN_ROWS = 128
#: Shingles of the two sides of a comparison in a crowd, and the most rows of each.
BLOCK_FEW, BLOCK_ALL = 100_000, 400_000
ROWS_FEW, ROWS_ALL = 256, 1024


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    hashed, ends = words(texts)
    out, begin = [], 0
    rolled = np.zeros(len(hashed), np.uint64)
    n = max(0, len(hashed) - size + 1)
    for k in range(size):
        rolled[:n] = mixed(rolled[:n] * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n] + np.uint64(size))
    for end in ends.tolist():
        if end - begin >= size:
            out.append(np.unique(rolled[begin : end - size + 1]))
        elif end > begin:
            whole = np.zeros(1, np.uint64)
            for h in hashed[begin:end]:
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(end - begin))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of bins for each non-empty set: the least hash of the bin, empty bins densified."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    shift = np.uint64(64 - (bins - 1).bit_length())
    key = np.repeat(np.arange(len(sets)) * bins, sizes) + (flat >> shift).astype(np.int64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sig = np.zeros(len(sets) * bins, np.uint64)
    full = np.zeros(len(sets) * bins, bool)
    sig[key[first]], full[key[first]] = flat[first], True
    empty = np.flatnonzero(~full)
    row, own, turn = empty // bins * bins, (empty % bins).astype(np.uint64), 0
    while empty.size:
        turn += 1
        probe = row + (mixed(own * np.uint64(0x100000001B3) + np.uint64(turn << 20)) >> shift).astype(np.int64)
        hit = full[probe]
        sig[empty[hit]] = sig[probe[hit]]
        empty, row, own = empty[~hit], row[~hit], own[~hit]
    return sig.reshape(len(sets), bins)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n = sig.shape[1] // rows
    out = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(sig), 1))
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, k : n * rows : rows])
    return out.view(np.int64)


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, fingerprint of the set, bands); the last two are null for empty sets."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for own, texts in text_parts(batch, 1, SLICE_CHARS):
                sets = shingle_sets(texts, size)
                full = [s for s in sets if len(s)]
                flat = bands(signatures(full)) if full else np.zeros((0, 1), np.int64)
                places = np.concatenate([[0], np.cumsum([flat.shape[1] * (len(s) > 0) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(flat.ravel()))
                there = pa.array([len(s) > 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pc.if_else(there, lists, pa.scalar(None, lists.type)),
                    ],
                    names=["id", "n_shingles", "print", "bands"],
                )

    return docs.mapInArrow(run, f"id {kind}, n_shingles long, print binary, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles): the sorted distinct shingle hashes, as bytes, of ids among ``ids`` and perhaps a few others."""
    rows = marked(docs, id_map(ids), "id", "tessera_wanted").where("tessera_wanted").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in text_parts(batch, 1, SLICE_CHARS):
                sets = pa.array([x.astype("<u8").tobytes() for x in shingle_sets(texts, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), sets], names=["id", "shingles"])

    return rows.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a similarity of at least percent/100.

    Pairs lie in runs of one ``a``, whose set comes first and once, so that a task holds one set of a
    hub and a batch of its partners.  A hub of many pairs is spread over several runs.
    """
    degree = pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    runs = F.ceil(F.col("n") / RUN_ROWS).cast("int")
    degree = written(degree.select("id", runs.alias("runs")), "degree")
    many = id_map(degree.where("runs > 1").select("id"))
    hubs = degree.withColumnRenamed("id", "a")
    partners = salted_join(pairs.select("a", "b"), hubs, "a", F.col("b"), many)
    partners = partners.select("a", F.pmod(F.xxhash64("b", F.lit(73)), F.col("runs")).cast("int").alias("run"), "b")
    partners = partners.join(sets.select(F.col("id").alias("b"), "shingles"), "b").select("a", "run", "b", "shingles")
    heads = sets.join(degree, "id").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "shingles")
    rows = heads.unionByName(partners).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hub, own = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            shingles = batch.column(3)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                other = np.frombuffer(shingles[i].as_buffer(), "<u8")
                if b is None:
                    hub, own = a, other.copy()
                elif hub == a:
                    keep[i] = _similar(own, other, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(keep))

    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * common >= percent * union; small sets cannot hold a large one."""
    n = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (n - both)


def _labelled(buckets: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """Open buckets: those whose ids lie in more than one component, with each id's component."""
    own = labels.select(F.col("node").alias("id"), "component")
    rows = written(buckets.join(own, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    open_ = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    return salted_join(rows, open_.select("bucket", "size"), "bucket", F.col("id"), hot)


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: all pairs of a bucket's ids that lie in different components, where the sizes allow a link."""
    x = rows.select("bucket", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    y = rows.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = x.join(y, "bucket").where("a < b and ca <> cb").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return pairs.select("a", "b").distinct()


def _crowds(rows: DataFrame, sets: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of all links across components in large open buckets.

    Ids that such buckets tie together are a crowd.  Those outside its largest component are few
    beside it; blocks of them meet blocks of the whole crowd, and a pair of blocks counts common
    shingles as a product of matrices.  Blocks are bounded by the shingles in them.  Only edges leave
    it, at most one for each id.
    """
    hubs = rows.groupBy("bucket").agg(F.min("id").alias("hub"))
    ids = salted_join(rows, hubs, "bucket", F.col("id"), hot).select("id", "component", "hub")
    crowd = components(ids.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    member = rows.select("id", "component", "n").distinct().join(crowd.select(F.col("node").alias("id"), F.col("component").alias("crowd")), "id")
    member = written(member, "crowds")
    sizes = member.groupBy("crowd", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"))
    most = F.min(F.struct((-F.col("k")).alias("less"), "component", "k", "shingles")).alias("most")  # the largest, ties to the least id
    sizes = sizes.groupBy("crowd").agg(F.sum("k").alias("k"), F.sum("shingles").alias("shingles"), most)
    blocks = lambda k, shingles, rows, size: F.greatest(F.ceil(k / rows), F.ceil(shingles / size)).cast("int")
    sizes = sizes.select(
        "crowd", F.col("most.component").alias("main"),
        blocks(F.col("k") - F.col("most.k"), F.col("shingles") - F.col("most.shingles"), ROWS_FEW, BLOCK_FEW).alias("few"),
        blocks(F.col("k"), F.col("shingles"), ROWS_ALL, BLOCK_ALL).alias("whole"),
    )
    crowded = id_map(member.groupBy(F.col("crowd").alias("id")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_ROWS).select("id"))
    member = salted_join(member.select("crowd", "id", "component"), sizes, "crowd", F.col("id"), crowded)
    own = lambda column, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(column)).cast("int")
    every = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    few = member.where("component <> main").select("crowd", "id", "component", F.lit(True).alias("few"), own("few", 61).alias("i"), every("whole").alias("j"))
    whole = member.select("crowd", "id", "component", F.lit(False).alias("few"), every("few").alias("i"), own("whole", 67).alias("j"))
    parts = few.unionByName(whole.select("crowd", "id", "component", "few", "i", "j")).join(sets, "id")
    kind = rows.schema["id"].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        side = np.array(group["few"].to_pylist())
        ids, component = group["id"].to_numpy(), group["component"].to_numpy()
        own = [np.frombuffer(x.as_buffer(), "<u8") for x in group["shingles"]]
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        none = pa.table({"a": pa.array([], group["id"].type), "b": pa.array([], group["id"].type)})
        if not len(left) or not len(right):
            return none
        both = common_counts([own[i] for i in left], [own[i] for i in right])
        n = np.array([len(x) for x in own])
        linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        linked &= component[left][:, None] != component[right][None, :]
        x, y = np.nonzero(linked)
        if not len(x):
            return none
        distinct, place = np.unique(ids, return_inverse=True)
        root = local_roots(len(distinct), place[left[x]], place[right[y]])
        moved = np.flatnonzero(root != np.arange(len(distinct)))
        return pa.table({"a": pa.array(distinct[moved], group["id"].type), "b": pa.array(distinct[root[moved]], group["id"].type)})

    return written(parts.groupBy("crowd", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}"), "crowds")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets (sorted, distinct)."""
    known = np.unique(np.concatenate(left))
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for sets in (left, right):
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], row[hit][order], len(sets)))
    for begin in range(0, len(known), columns):
        dense = []
        for at, row, n in sides:
            s, e = np.searchsorted(at, [begin, begin + columns])
            m = np.zeros((n, min(columns, len(known) - begin)), np.float32)
            m[row[s:e], at[s:e] - begin] = 1
            dense.append(m)
        out += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    return out


def _stars(buckets: DataFrame, percent: int) -> DataFrame:
    """Each bucket's least id, its hub, with every other: (a, b, shared), where the sizes allow a link."""
    pairs = buckets.where("id <> hub and 100 * least(n, hub_n) >= " + str(percent) + " * greatest(n, hub_n)")
    return pairs.groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links), kept.

    Two documents are linked if their sets of ``shingle``-word shingles (ASCII letters lower-cased)
    have a Jaccard similarity of at least ``percent``/100.  Null and empty texts have no shingles
    and link with nothing.  A null id is its own component (null) and kept.  Rows of one id are one
    document and must agree; other columns do not matter.  Ties go to the lesser id.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sketch = written(_sketch(given, shingle), "sketch")
    known = sketch.where("print is not null and id is not null")
    classes = written(known.groupBy("print").agg(F.min("id").alias("class")), "classes")
    first = sketch.join(classes.select(F.col("class").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    banded = written(first.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "bands")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "n")).alias("h")).where("k > 1")
    shared = written(shared.select("bucket", "k", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n")), "shared")
    hot = id_map(shared.where(F.col("k") > HOT_ROWS).select(F.col("bucket").alias("id")))
    buckets = written(salted_join(banded, shared.drop("k"), "bucket", F.col("id"), hot), "buckets")
    stars = written(_stars(buckets, percent), "stars")
    sets = written(_sets(given, buckets.select("id").distinct(), shingle), "sets")

    best = stars.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    best = written(best, "best")
    links = written(_confirmed(best, sets, percent), "links")
    rows = written(_labelled(buckets.select("bucket", "id", "n"), components(links), hot), "open")
    cross = _cross_pairs(rows.where(F.col("size") <= SMALL_BUCKET), percent).join(best, ["a", "b"], "left_anti")
    links = links.unionByName(written(_confirmed(written(cross, "cross"), sets, percent), "links"))
    links = links.unionByName(_crowds(rows.where(F.col("size") > SMALL_BUCKET), sets, percent, hot))
    labels = components(links)
    root = classes.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").select("print", F.coalesce("component", "class").alias("component_id"))
    out = sketch.select("id", "n_shingles", "print").join(root, "print", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, all columns.

    Rows of one id are one document, of which one row stays; rows with a null id stay.  Only rows
    that may go are moved: the others pass where they are.
    """
    found = near_duplicates(docs, text, id_col, shingle, percent)
    gone = written(found.where("not kept").select(F.col(id_col).alias("id")), "gone")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    rows = marked(docs, id_map(gone.union(again)), id_col, "tessera_maybe")
    maybe = rows.where("tessera_maybe").drop("tessera_maybe")
    maybe = maybe.join(gone.distinct(), maybe[id_col] == gone["id"], "left_anti").dropDuplicates([id_col])
    return rows.where("not tessera_maybe").drop("tessera_maybe").unionByName(maybe)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
