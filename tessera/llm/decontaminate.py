"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are words.  Runs of ``gram`` words are hashed, and of every ``window - gram + 1`` consecutive
hashes the least is kept with its place: the text's fingerprints.  What is kept depends on the words
of the window alone, so a window that a document shares with an item has a fingerprint in both, and
joining fingerprints finds every shared window.  Items shorter than a window are one fingerprint, and
documents are also looked through for runs of those lengths, where there are any.

A fingerprint travels with the words about it.  A map of the items' fingerprints, of bounded size, is
broadcast, so that nearly all of a document's stay where they are; the others are joined exactly.  A
hit is extended to the windows that hold it, and these are joined to the items' windows by their
words, not by a hash.  Windows that the same items hold carry one name for that set of items, and
documents with the same names share one list, so a passage that very many documents copy costs each
of them one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, id_map, marked, salted_join, table, written

#: Words after lower-casing: runs of digits, letters a-z and anything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits of a fingerprint: the place of its first word; a text has fewer words than these can hold.
PLACE_BITS = 30
#: Words of a document whose cover is added up together.
CHUNK = 4096


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(place.cast("long"))


def _run(hashes: Column, begin: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(hashes, begin + k) for k in range(size)])


def with_fingerprints(rows: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """Rows (with an array ``words``) once for each fingerprint, and once with none, a null ``print``.

    Adds n_words, print, place, size (words of the windows that it stands for) and about (the words
    from which those windows can be cut).  ``lengths`` are those of items shorter than a window.
    """
    n = F.col("n_words")
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    none = F.array().cast("array<bigint>")
    grams = F.when(n >= window, F.transform(F.sequence(F.lit(0).cast("long"), n - gram), lambda i: _packed(_run(F.col("hashes"), i.cast("int"), gram), i))).otherwise(none)
    rows = rows.withColumn("grams", grams)
    least = F.transform(F.sequence(F.lit(1).cast("long"), n - window + 1), lambda s: F.array_min(F.slice("grams", s.cast("int"), window - gram + 1)))
    kept = F.when(n >= window, F.array_distinct(least)).otherwise(none)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    begin = lambda p: F.greatest(p - (window - gram), F.lit(0))
    entry = lambda x, size, about: F.struct(F.shiftright(x, PLACE_BITS).alias("print"), place(x).alias("place"), F.lit(size).alias("size"), about.alias("about"))
    found = [F.transform(kept, lambda x: entry(x, window, F.slice("words", (begin(place(x)) + 1).cast("int"), 2 * window - gram)))]

    def whole(size: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0).cast("long"), n - size), lambda i: _packed(_run(F.col("hashes"), i.cast("int"), size), i))
        return F.transform(F.when(n >= size, runs).otherwise(none), lambda x: entry(x, size, F.slice("words", (place(x) + 1).cast("int"), size)))

    other = [c for c in rows.columns if c not in ("words", "hashes", "grams")]
    nothing = F.array(F.lit(None).cast("struct<print:bigint,place:bigint,size:int,about:array<string>>"))
    return rows.select(*other, F.explode(F.concat(nothing, *found, *map(whole, lengths))).alias("x")).select(*other, "x.*")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, window): the distinct windows of items (item, words) as words with a space between."""
    n = F.size("words")
    joined = lambda s, size: F.array_join(F.slice("words", s + 1, size), " ")
    own = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda s: joined(s, window))).when(n > 0, F.array(F.array_join("words", " ")))
    return items.select("item", F.explode(F.array_distinct(own)).alias("window"))


def hit_windows(prints: DataFrame, window: int, gram: int) -> DataFrame:
    """Document fingerprints, each extended to the windows that hold it: (..., begin, size, window)."""
    first = F.greatest(F.col("place") - (window - gram), F.lit(0))
    begins = F.when(F.col("size") == window, F.sequence(first, F.least(F.col("place"), F.col("n_words") - window))).otherwise(F.array("place"))
    rows = prints.withColumn("first", F.when(F.col("size") == window, first).otherwise(F.col("place"))).withColumn("begin", F.explode(begins))
    words_ = F.slice("about", (F.col("begin") - F.col("first") + 1).cast("int"), F.col("size"))
    return rows.select("doc", "row", "begin", "size", F.array_join(words_, " ").alias("window"))


def covers(hits: DataFrame) -> DataFrame:
    """(doc, row, n_hit, names) of hits (doc, row, begin, size, name): words in any hit, and the distinct names."""
    end = F.col("begin") + F.col("size")
    chunk = F.explode(F.sequence(F.floor(F.col("begin") / CHUNK), F.floor((end - 1) / CHUNK)))
    span = F.struct(F.greatest("begin", F.col("chunk") * CHUNK).alias("lo"), F.least(end, (F.col("chunk") + 1) * CHUNK).alias("hi"))
    by_chunk = hits.withColumn("chunk", chunk).groupBy("doc", "row", "chunk").agg(F.collect_set(span).alias("spans"), F.collect_set("name").alias("names"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["hi"]).alias("end"), (a["n"] + F.greatest(x["hi"] - F.greatest(a["end"], x["lo"]), F.lit(0))).alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    n = F.aggregate(F.array_sort("spans"), zero, step, lambda a: a["n"])
    return by_chunk.withColumn("n", n).groupBy("doc", "row").agg(F.sum("n").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of an item: ``window`` consecutive words of
    it, or all of a shorter item.  Null and empty texts have no words, and items without words no
    windows.  Rows of one item id are one item; a null item id counts as the empty string.  Every
    document row has its result, repeated ones and those with a null id too.  ``items_sha256`` is over
    the sorted, comma-joined ids of the items found, of the empty string if none.  A text's words must
    fit a task's memory, and so must the list of the items that a document holds.
    """
    asked = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(item_text)).alias("words"))
    asked = written(asked.where(F.size("words") > 0), "items")
    short = sorted(r.n for r in asked.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect())
    prints = with_fingerprints(asked, short, window, gram).where("print is not null and (n_words = size or size = " + str(window) + ")")
    prints = written(prints.select("print").distinct(), "item_prints")

    given = docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text).alias("row"), words(F.col(text)).alias("words"))
    found = marked(with_fingerprints(given, short, window, gram), id_map(prints.select(F.col("print").alias("id"))), "print", "met")
    scan = written(found.where("met or print is null").drop("met"), "fingerprints")
    met = scan.where("print is not null").join(prints, "print", "left_semi")
    windows = written(hit_windows(met, window, gram), "windows")

    of_item = item_windows(asked, window).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    of_item = written(of_item.withColumn("name", F.sha2(F.to_json("items").cast("binary"), 256)), "item_windows")
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_ROWS)
    hits = salted_join(windows, of_item.select("window", "name"), "window", F.struct("row", "begin"), id_map(often.select(F.col("window").alias("id"))))
    covered = written(covers(hits).withColumn("list", F.sha2(F.array_join("names", ",").cast("binary"), 256)), "covers")

    lists = covered.groupBy("list").agg(F.count(F.lit(1)).alias("k"), F.min("names").alias("names"))
    lists = written(lists, "lists")
    sets = of_item.groupBy("name").agg(F.min("items").alias("items"))
    held = lists.select("list", F.explode("names").alias("name")).join(sets, "name").select("list", F.explode("items").alias("item"))
    held = held.groupBy("list").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = held.select("list", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    hot = id_map(lists.where(F.col("k") > HOT_ROWS).select(F.col("list").alias("id")))
    result = salted_join(covered.drop("names"), written(held, "item_lists"), "list", F.col("row"), hot).drop("list")

    every = scan.where("print is null").select("doc", "row", "n_words")
    result = result.select(F.col("doc").alias("of"), F.col("row").alias("at"), "n_hit", "n_items", "items_sha256")
    every = every.join(result, F.col("row").eqNullSafe(F.col("at")) & F.col("doc").eqNullSafe(F.col("of")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return every.select(F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
