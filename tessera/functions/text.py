"""Text as ranking sees it: tokens, evidence keywords, actionability, question types, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

#: Unicode word runs; Java's own \w and \b would see other letters.
TOKEN = r"[\p{L}\p{N}_]+"


def doc_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def evidence_level(title: Column, abstract: Column, whole_words: bool = False) -> Column:
    """The first level, strongest first, one of whose keywords occurs; substrings count.

    ``whole_words`` asks for word boundaries instead (not the model's own behaviour).
    """
    text = F.lower(doc_text(title, abstract))
    out = F.lit(params.DEFAULT_LEVEL)
    for level, *_, words in reversed(params.EVIDENCE):
        hit = text.rlike("(?U)\\b(" + "|".join(words) + ")\\b") if whole_words else _any(text, words)
        out = F.when(hit, F.lit(level)).otherwise(out)
    return out.cast("int")


def evidence_weight(level: Column) -> Column:
    out = F.lit(params.DEFAULT_EVIDENCE_WEIGHT)
    for number, _, weight, *_ in params.EVIDENCE:
        out = F.when(level == number, F.lit(weight)).otherwise(out)
    return out


def actionability(title: Column, abstract: Column) -> Column:
    text = F.lower(doc_text(title, abstract))
    hits = sum((F.contains(text, F.lit(s)).cast("int") for s in params.ACTION_SIGNALS), F.lit(0))
    return F.least(hits / F.lit(float(len(params.ACTION_SIGNALS))), F.lit(1.0))


def question_type(text: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(params.QUESTION_RULES):
        out = F.when(F.lower(text).rlike("(?U)" + pattern), F.lit(name)).otherwise(out)
    return out


def publication_level(types: Column) -> Column:
    """Strongest level among the known publication types; null without any."""
    known = F.create_map(*[F.lit(x) for kv in params.PUBLICATION_LEVELS.items() for x in kv])
    levels = F.transform(types, lambda t: F.try_element_at(known, t))
    return F.array_min(F.filter(levels, lambda x: x.isNotNull())).cast("int")


def topic_column(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in params.TOPIC_COLUMNS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(kind)))


def pmc_id(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "^PMC", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parsed_date(year: Column, month: Column, day: Column) -> Column:
    """Y-M-D; a missing or non-numeric month or day is 1, an impossible day 1, an impossible month 1 January."""
    number = lambda x: F.coalesce(F.when(x.rlike(r"^\s*[0-9]+\s*$"), F.trim(x)).cast("int"), F.lit(1))
    y = F.lpad(F.trim(year), 4, "0")
    written = lambda m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when(year.rlike(r"^\s*[0-9]{1,4}\s*$"), F.coalesce(written(number(month), number(day)), written(number(month), F.lit(1)), written(F.lit(1), F.lit(1))))
