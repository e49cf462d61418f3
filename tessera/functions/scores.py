"""Numeric parts of relevance: decay, cosine, applicability, the composite, BM25's terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params
from . import text as T


def decay_rate(domain: Column) -> Column:
    rates = F.create_map(*[F.lit(x) for kv in params.DECAY_RATES.items() for x in kv])
    return F.coalesce(F.try_element_at(rates, F.lower(domain)), F.lit(params.DEFAULT_DECAY))


def temporal_decay(document: Column, asked: Column, domain: Column | None = None, rate: Column | None = None) -> Column:
    """exp(-rate * years), years from whole 24-hour periods, none negative; a given rate wins over the domain's."""
    days = F.floor((F.unix_micros(asked.cast("timestamp")) - F.unix_micros(document.cast("timestamp"))) / F.lit(86_400_000_000))
    own = decay_rate(domain if domain is not None else F.lit("pbm"))
    return F.exp(-(F.coalesce(rate, own) if rate is not None else own) * F.greatest(days, F.lit(0)) / params.YEAR_DAYS)


def half_life(domain: Column) -> Column:
    return F.lit(math.log(2)) / decay_rate(domain)


def years_until(threshold: Column, domain: Column) -> Column:
    """Years until decay reaches the threshold; thresholds that are not positive are refused."""
    bad = F.raise_error(F.lit("the threshold must be positive")).cast("double")
    return F.when(threshold > 0, -F.ln(threshold) / decay_rate(domain)).otherwise(bad)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either has no length; vectors of different sizes are refused."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(same / (na * nb))


def applicability(doc: Column, query: Column) -> Column:
    """Share of the query's age range that the document's covers; 0.5 where either population is null or empty."""
    low = lambda m: F.coalesce(F.try_element_at(m, F.lit("age_min")), F.lit(params.AGE_LOW))
    high = lambda m: F.coalesce(F.try_element_at(m, F.lit("age_max")), F.lit(params.AGE_HIGH))
    begin, end = F.greatest(low(doc), low(query)), F.least(high(doc), high(query))
    span = high(query) - low(query)
    known = (F.coalesce(F.size(doc), F.lit(0)) > 0) & (F.coalesce(F.size(query), F.lit(0)) > 0)
    share = F.when((end <= begin) | (span == 0), F.lit(0.0)).otherwise(F.try_divide(end - begin, span))
    return F.when(known, share).otherwise(F.lit(params.UNKNOWN_APPLICABILITY))


def composite(topic: Column, apply: Column, action: Column, tau: Column, evidence: Column, weights: dict[str, float] | None = None, use_tau: bool = True, use_evidence: bool = True) -> Column:
    """tau * evidence * weighted sum of the components; a factor that is off counts as 1."""
    w = params.COMPONENT_WEIGHTS if weights is None else weights
    inner = F.lit(w["topic"]) * topic + F.lit(w["apply"]) * apply + F.lit(w["action"]) * action
    return (tau if use_tau else F.lit(1.0)) * (evidence if use_evidence else F.lit(1.0)) * inner


def weights_without(component: str) -> dict[str, float]:
    return {k: 0.0 if k == component else v for k, v in params.COMPONENT_WEIGHTS.items()}


def clinical_relevance(doc: dict[str, Column], query: dict[str, Column], as_of: Column, weights: dict[str, float] | None = None, use_tau: bool = True, use_evidence: bool = True) -> Column:
    """The composite of a document and a query, each given as columns by field; ``as_of`` is required."""
    return composite(
        cosine(doc["embedding"], query["embedding"]), applicability(doc["population"], query["population"]), T.actionability(doc["title"], doc["abstract"]),
        temporal_decay(doc["publication_date"], as_of, doc["domain"]), T.evidence_weight(doc["evidence_level"]), weights, use_tau, use_evidence,
    )


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def tf_norm(tf: Column, dl: Column, avgdl: Column, k1: float = params.K1, b: float = params.B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
