"""Personal data by candidate spans and boosted trees, in DataFrame functions alone.

Base spans follow fixed rules per kind.  Beyond them, high-recall generators propose spans that may
overlap: addresses written out or without a domain's dot, long digit runs, grouped numbers without
a plus, colon-separated addresses.  Gradient-boosted trees score each candidate by its format and
its context.  They learn from candidates with labels of their own: examples of every generator's
format and its decoys (``pii_examples``), and those candidates of the documents
that a check digit, a valid form or the words before them settle; others have no label and count
neither as a hit nor as a miss.  The threshold of each generator is calibrated on labelled
candidates kept out of the training: it is the least at which the precision is met.

The trees become one SQL expression, evaluated in place, so that the pass over the documents is
narrow: no shuffle, no join, no driver.  The spans of one rule lie in order and apart, so overlaps
are found by binary search and contexts in blocks of the text: a long log full of numbers costs
little more than its length.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .pii_examples import examples

KINDS = ("email", "ip", "card", "phone")

# The base rules.  Each matches as its plain form in the contract does; the guards
# only keep a scan from starting again inside a run that has failed, so scans stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
VALID_IP = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"

# What the generators propose beyond the base.
LOOSE = {
    "email": r"(?:\G|(?<![^\s@,;:<>()\[\]\"'|]))[^\s@,;:<>()\[\]\"'|]++@[^\s@,;:<>()\[\]\"'|]++",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![\x20.-]?[0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])",
}
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+)++"
CONTEXT = {
    "about_phone": r"(?i)tel|phone|call|fax|mobil|\bnum",
    "about_mail": r"(?i)mail|contact|write|address",
    "about_net": r"(?i)\bip\b|host|server|addr|login",
    "about_card": r"(?i)card|visa|credit|payment|account",
    "about_code": r"(?i)token|key|version|order|isbn|sha|hash|license",
    "about_number": r"(?i)invoice|serial|tracking|\bref\b|\bids?\b|\bpages?\b|population|\btotal|\byears?\b",
}
# What proposes candidates, with the kind and the confirming context of each.
GENERATORS = {"email": ("email", "about_mail"), "ip": ("ip", "about_net"), "card": ("card", "about_card"), "phone": ("phone", "about_phone"), "spelled": ("email", "about_mail")}
# What a whole form looks like, by generator; a card's has a check digit besides.
WELL_FORMED = {
    "email": r"^[^@]+@[^@]+\.\p{L}{2,}$",
    "ip": r"^(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)(?!.*::.*::)[0-9A-Fa-f:]+)$",
    "card": r"^[3-6]",
    "phone": r"^(?:\([0-9]{2,4}\) ?[0-9]{3,4}[ -][0-9]{3,4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]{1,3}[ -][0-9]{3,4}[ -][0-9]{3,4})$",
    "spelled": r"(?i)(?:com|org|net|edu|gov|int|info|biz|io|dev|app|de|fr|es|uk|us|ca|au|ch|nl|se|pl|eu|ru|jp|cn|br|mx)$",
}
# Words before " at " that point to a place and are nobody's name.
PLACING = r"(?i)^(?:look|visit|available|hosted|found|find|arrived|shop|posted|read|online|see|us|site|page|noon|home|top|work|school|last|once|night)\x20at\x20"


#: A text is read by place in blocks of this power of two characters.
BLOCK_BITS = 8


def _running(values: Column, both) -> Column:
    """Running results of ``both``, sum or greatest, over an array, each value included, by doubling."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(2)) - F.lit(0.5))).cast("int"))
    return F.aggregate(
        steps,
        values,
        lambda acc, k: F.transform(acc, lambda x, i: both(x, F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))),
    )


def _with_spans(df: DataFrame, name: str, text: Column, pattern: str, hint: Column | None = None) -> DataFrame:
    """Adds the leftmost non-overlapping matches: array of (start, end, s), in code points."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("tessera_m", F.when(hint, found).otherwise(none) if hint is not None else found)
    matches = F.col("tessera_m")
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    sizes = F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.length(m))
    df = df.withColumn("tessera_e", F.when(F.size(matches) > 0, _running(sizes, add)))
    spans = F.zip_with(F.col("tessera_e"), matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("s")))
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")
    return df.withColumn(name, F.when(F.size(matches) > 0, spans).otherwise(empty)).drop("tessera_m", "tessera_e")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn check."""
    d = F.transform(F.filter(F.split(F.reverse(digits(s)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def with_base_spans(df: DataFrame, text: Column) -> DataFrame:
    """Adds base_email, base_ip, base_card and base_phone by the base rules."""
    df = _with_spans(df, "base_email", text, EMAIL, text.contains("@"))
    df = _with_spans(df, "base_ip", text, IP)
    df = df.withColumn("base_ip", F.filter("base_ip", lambda x: x["s"].rlike(VALID_IP)))
    df = _with_spans(df, "base_card", text, CARD)
    df = df.withColumn("base_card", F.filter("base_card", lambda x: luhn(x["s"])))
    df = _with_spans(df, "base_phone", text, PHONE, text.contains("+"))
    return df.withColumn("base_phone", F.filter("base_phone", lambda x: F.length(digits(x["s"])).between(8, 15)))


def _of_kind(kind: str, spans: str, by: str | None = None) -> Column:
    of = [F.lit(by).alias("by")] if by else []
    return F.transform(spans, lambda x: F.struct(*of, F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def _last(spans: Column, holds) -> Column:
    """Index of the last of ``spans`` for which ``holds``, -1 if none; it must hold up to there."""
    steps = F.reverse(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(spans), F.lit(1)))).cast("int")))

    def longer(at: Column, k: Column) -> Column:
        step = at + F.pow(F.lit(2), k).cast("int")
        return F.when((step < F.size(spans)) & F.coalesce(holds(F.get(spans, step)), F.lit(False)), step).otherwise(at)

    return F.aggregate(steps, F.lit(-1), longer)


def _meets(x: Column, spans: Column) -> Column:
    """Whether x overlaps one of ``spans``, which are in order and apart."""
    last = _last(spans, lambda y: y["start"] < x["end"])
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, last)["end"] > x["start"], F.lit(False))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))


def _between(blocks: Column, begin: Column, end: Column) -> Column:
    """The text from ``begin`` to ``end``, in time that does not grow with what lies before."""
    first, last = F.shiftright(begin, BLOCK_BITS), F.shiftright(end, BLOCK_BITS)
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), begin - F.shiftleft(first, BLOCK_BITS) + 1, end - begin)


def with_candidates(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``candidates``: proposed spans (by, kind, start, end, s, before, after) that meet no base span."""
    names = []
    for kind, pattern in LOOSE.items():
        hint = {"email": text.contains("@"), "ip": text.contains(":")}.get(kind)
        df = _with_spans(df, f"loose_{kind}", text, pattern, hint)
        names.append((kind, f"loose_{kind}"))
    spelled = text.contains("(dot)") | text.contains("[dot]") | text.contains(" dot ")
    df = _with_spans(df, "loose_spelled", text, SPELLED, spelled)
    names.append(("spelled", "loose_spelled"))
    proposed = F.concat(*[_of_kind(GENERATORS[by][0], c, by) for by, c in names])
    df = df.withColumn("candidates", F.filter(proposed, lambda x: ~reduce(or_, [_meets(x, F.col(f"base_{k}")) for k in KINDS])))
    df = df.withColumn("tessera_blocks", F.when(F.size("candidates") > 0, _blocks(text)))
    df = df.withColumn("candidates", F.transform("candidates", lambda x: _in_context(x, F.col("tessera_blocks"))))
    return df.drop("tessera_blocks", *[c for _, c in names])


def _in_context(x: Column, blocks: Column) -> Column:
    begin = F.greatest(x["start"] - 32, F.lit(0))
    return F.struct(
        x["by"].alias("by"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
        _between(blocks, begin, x["start"]).alias("before"), _between(blocks, x["end"], x["end"] + 8).alias("after"),
    )


def features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    s = c["s"]
    number = lambda x: x.cast("double")
    count = lambda signs: number(F.length(F.regexp_replace(s, f"[^{signs}]", "")))
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    def chosen(of: dict[str, Column]) -> Column:
        out = F.lit(False)
        for by, x in of.items():
            out = F.when(c["by"] == by, x).otherwise(out)
        return out

    form = {by: s.rlike(p) for by, p in WELL_FORMED.items()}
    form["card"] = form["card"] & F.length(digits(s)).between(13, 19) & luhn(s)
    out = {f"is_{by}": number(c["by"] == by) for by in GENERATORS}
    out |= {
        "well_formed": number(chosen(form)),
        "about_own": number(chosen({by: c["before"].rlike(CONTEXT[about]) for by, (_, about) in GENERATORS.items()})),
        "prefixed": number(c["before"].rlike(r"(?:\+|\b00)[0-9]{1,3}[\x20.-]?$")),
        "placing": number(s.rlike(PLACING)),
        "continued": number(c["before"].rlike(r"[0-9][\x20.-]$") | c["after"].rlike(r"^[\x20.-][0-9]")),
        "length": number(F.length(s)),
        "digits": number(F.length(digits(s))),
        "letters": count("A-Za-z"),
        "blanks": count(r"\x20"),
        "dashes": count("-"),
        "dots": count("."),
        "colons": count(":"),
        "brackets": count("()"),
        "groups": number(F.size(groups)),
        "last_group": number(F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0))),
        "glued_before": number(c["before"].rlike(r"[\p{L}\p{N}_\"]$")),
        "glued_after": number(c["after"].rlike(r"^[\p{L}\p{N}_\"]")),
    }
    return out | {name: number(c["before"].rlike(p)) for name, p in CONTEXT.items()}


@dataclass
class SpanModel:
    """Boosted trees as nested (feature, threshold, left, right) or leaf values, and thresholds."""

    names: list[str] = field(default_factory=list)
    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    least: dict[str, float] = field(default_factory=dict)

    def margin(self, feature: dict[str, Column]) -> Column:
        def node(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            at, threshold, low, high = t
            return F.when(feature[self.names[at]] <= threshold, node(low)).otherwise(node(high))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total = total + node(tree) * weight
        return total

    def score(self, c: Column) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(features(c))))


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def settled(f: dict[str, Column]) -> Column:
    """The label of a candidate of a corpus where its form or the words before it settle one, else null."""
    on = lambda name: f[name] > 0
    glued, coded = on("glued_before") | on("glued_after"), on("about_code") | on("about_number")
    confirmed = on("about_own") | (on("is_phone") & on("prefixed"))
    checked = on("is_card") | on("is_ip")
    return (
        F.when(glued | on("placing"), 0.0)
        .when(checked, F.when(~on("well_formed"), 0.0).when(on("is_ip") | (confirmed & ~coded), 1.0).when(coded, 0.0))
        .when(on("well_formed") & confirmed & ~coded, 1.0)
        .when(~confirmed & coded, 0.0)
    )


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(source, by, fold, label, features): the examples' candidates, and those of ``docs`` that are settled."""

    def exploded(df: DataFrame, *more: Column) -> DataFrame:
        df = with_candidates(with_base_spans(df, F.col("text")), F.col("text"))
        # outer: an inner one is preceded by a filter in which all rules would be worked out again
        return df.select(F.explode_outer("candidates").alias("c"), F.pmod(F.xxhash64("text", F.lit(31)), F.lit(4)).alias("fold"), *more)

    made = docs.sparkSession.createDataFrame(examples(tuple(GENERATORS)), "text string, of string, given double")
    made = exploded(made, F.col("of"), F.col("given")).where(F.col("c.by") == F.col("of"))
    named = features(F.col("c"))
    columns = [c.alias(k) for k, c in named.items()]
    made = made.select(F.lit("example").alias("source"), F.col("c.by").alias("by"), "fold", F.col("given").alias("label"), *columns)
    own = exploded(docs.select(F.col(text).alias("text")))
    own = own.select(F.lit("document").alias("source"), F.col("c.by").alias("by"), "fold", *columns)
    own = own.withColumn("label", settled({k: F.col(k) for k in named})).where("label is not null")
    return made.unionByName(own)


def fit(docs: DataFrame, text: str = "text", precision: float = 0.95, trees: int = 20, depth: int = 3, least_rows: int = 30) -> SpanModel:
    """Trees and thresholds from the examples and all documents.

    Candidates of the same features, label and fold are one row that weighs as many.  A generator
    without enough evidence has no threshold and adds no span.
    """
    if docs.isEmpty():
        return SpanModel()
    given = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    each = labelled(given)
    rows = written(each.groupBy(*each.columns).agg(F.count(F.lit(1)).cast("double").alias("weight")), "spans")
    names = [c for c in rows.columns if c not in ("source", "by", "fold", "label", "weight")]
    grown = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1, featuresCol="x", labelCol="label", weightCol="weight").fit(VectorAssembler(inputCols=names, outputCol="x").transform(rows.where("fold <> 0")))
    model = SpanModel(names, [_tree(t._java_obj.rootNode()) for t in grown.trees], list(grown.treeWeights))
    score = 1 / (1 + F.exp(-2 * model.margin({k: F.col(k) for k in names})))
    tested = rows.where("fold = 0").groupBy("by", F.floor(score * 50).alias("bin")).agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("hits")).collect()
    for by in GENERATORS:
        total = hits = 0
        for r in sorted((r for r in tested if r["by"] == by), key=lambda r: -r["bin"]):
            total, hits = total + r["n"], hits + r["hits"]
            if total >= least_rows and hits >= precision * total:
                model.least[by] = max(0.5, r["bin"] / 50)
    return model


def _beaten(x: Column, others: Column) -> Column:
    """Whether one of ``others``, scored candidates of one generator, overlaps x and is better."""
    first = _last(others, lambda y: y["c"]["end"] <= x["c"]["start"]) + 1
    last = _last(others, lambda y: y["c"]["start"] < x["c"]["end"])
    score = lambda y: F.struct(-y["p"], y["c"]["start"], y["c"]["by"])
    met = F.slice(others, first + 1, F.greatest(last - first + 1, F.lit(0)))
    return (F.size(others) > 0) & F.exists(met, lambda y: score(y) < score(x))


def with_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """Adds base_<kind> and added_<kind>: arrays of (start, end, s), ends exclusive, in code points.

    Base spans follow the base rules; added ones are candidates at or above their generator's threshold
    that overlap neither a base span nor a better added one.  Null and empty texts have none.  Texts
    are searched whole; other columns pass unchanged and repeated rows are rows of their own.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = with_candidates(with_base_spans(docs, whole), whole)
    if model.least:
        least = F.create_map(*[F.lit(x) for kind, t in model.least.items() for x in (kind, t)])
        scored = F.transform("candidates", lambda c: F.struct(c.alias("c"), model.score(c).alias("p")))
        df = df.withColumn("candidates", scored)
        df = df.withColumn("candidates", F.filter("candidates", lambda x: F.coalesce(x["p"] >= F.try_element_at(least, x["c"]["by"]), F.lit(False))))
        for by in GENERATORS:
            df = df.withColumn(f"tessera_{by}", F.filter("candidates", lambda x: x["c"]["by"] == by))
        df = df.withColumn("candidates", F.filter("candidates", lambda x: ~reduce(or_, [_beaten(x, F.col(f"tessera_{by}")) for by in GENERATORS])))
        df = df.withColumn("candidates", F.transform("candidates", lambda x: x["c"])).drop(*[f"tessera_{by}" for by in GENERATORS])
    else:
        df = df.withColumn("candidates", F.filter("candidates", lambda x: F.lit(False)))
    for kind in KINDS:
        own = F.filter("candidates", _is_kind(kind))
        df = df.withColumn(f"added_{kind}", F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"))))
    return df.drop("candidates")


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def redact(spanned: DataFrame, row: str, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with every span, base or added, replaced by its kind in brackets.

    ``row`` is a column of ``spanned`` that holds the document's own columns.  Overlapping spans are replaced together by the kind of the first.  A text without spans stays
    as it is, null included; ``n_chars``, if there, follows the text.
    """
    every = F.concat(*[_of_kind(kind, c) for kind in KINDS for c in (f"base_{kind}", f"added_{kind}")])
    every = F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind")))
    df = spanned.withColumn("tessera_all", F.array_sort(every))
    df = df.withColumn("tessera_reach", F.when(F.size("tessera_all") > 1, _running(F.transform("tessera_all", lambda x: x["end"]), F.greatest)))
    # a span that begins where all before have ended starts a group, which ends where the next one's before had
    before = F.concat(F.array(F.lit(0)), F.coalesce(F.col("tessera_reach"), F.array().cast("array<int>")))
    begun = F.zip_with("tessera_all", F.slice(before, F.lit(1), F.size("tessera_all")), lambda x, b: F.struct(x.alias("x"), b.alias("before")))
    df = df.withColumn("tessera_first", F.filter(begun, lambda g: g["x"]["start"] >= g["before"]))
    end = F.coalesce(F.array_max("tessera_reach"), F.get("tessera_all", F.lit(0))["end"])
    df = df.withColumn("tessera_all", F.transform("tessera_first", lambda g, i: F.struct(
        g["x"]["start"].alias("start"), F.coalesce(F.get("tessera_first", i + 1)["before"], end).alias("end"), g["x"]["kind"].alias("kind")
    )))
    df = df.withColumn("tessera_blocks", F.when(F.size("tessera_all") > 0, _blocks(F.col(text))))
    spans = F.col("tessera_all")
    parts = F.transform(spans, lambda x, i: F.concat(
        _between(F.col("tessera_blocks"), F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), x["start"]),
        F.lit("["), x["kind"], F.lit("]"),
    ))
    # named twice in one projection, the blocks are computed once and not again for every span
    tail = _between(F.col("tessera_blocks"), F.get(spans, F.size(spans) - 1)["end"], F.length(text))
    changed = F.size(spans) > 0
    df = df.select(row, changed.alias("tessera_changed"), F.when(changed, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(row)[text]).alias("tessera_text"))
    out = []
    for field in spanned.schema[row].dataType:
        own = F.col(row)[field.name]
        if field.name == text:
            own = F.col("tessera_text")
        elif field.name == n_chars:
            own = F.when(F.col("tessera_changed"), F.length("tessera_text").cast(field.dataType)).otherwise(own)
        out.append(own.alias(field.name))
    return df.select(*out)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, fit(docs))
    base = F.concat(*[_listed(k, F.col(f"base_{k}")) for k in KINDS])
    every = F.concat(*[_listed(k, F.concat(f"base_{k}", f"added_{k}")) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )
