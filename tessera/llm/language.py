"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams of its lower-cased letters (n = 1, 2, 3; anything else
counts as a blank), weighted by TF-IDF and scaled to length 1.  Each language has several
centroids, found by spherical k-means among its own texts.  A text gets the language of the
centroid of highest cosine, and is rejected if that cosine is below a share of what the language's
own texts reach.

Document frequencies come from all texts of known language, each language weighing as its sample
does.  Centroids are fitted on about ``per_language`` texts of each language, chosen by a hash;
every text is predicted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, slices, table, text_parts, written
from .hashing import joined
from .transducer import forget

BUCKETS = 4096
SLICE_CHARS = 250_000
SLICE_ROWS = 128

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def profiles(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed n-grams, one row of BUCKETS for each text."""
    data, ends = joined([(t or "").lower() for t in texts])
    data = np.concatenate([_LETTER[data], np.full(2, 32, np.uint8)]).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, np.diff(np.concatenate([[0], ends])))
    a, b, c = data[:-2], data[1:-1], data[2:]
    ends_here = np.zeros(len(a), bool)
    ends_here[ends - 1] = True  # what begins on a text's last byte, a blank, would reach into the next
    one = a != 32
    two = ~((a == 32) & (b == 32)) & ~ends_here
    three = two & ~((b == 32) & (c == 32)) & ~((b == 32) & np.append(ends_here[1:], True))
    keys = [
        row[keep] + ((code[keep] * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(20)).astype(np.int64)
        for keep, code, salt in ((one, a, 0x1000003), (two, a | b << 8 | np.uint32(1 << 30), 0x2000003), (three, a | b << 8 | c << 16, 0))
    ]
    counts = np.bincount(np.concatenate(keys), minlength=len(texts) * BUCKETS)
    return counts.reshape(len(texts), BUCKETS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts.astype(np.float32)) * idf)


@dataclass
class Centroids:
    idf: np.ndarray
    centres: np.ndarray
    language: list[str]
    least: np.ndarray  # a text further from its centre is rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        names: list[str] = []
        scores, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        for part in slices([len(t or "") + SLICE_CHARS // SLICE_ROWS for t in texts], SLICE_CHARS):
            own = texts[part]
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in own], bool)
            if not self.language:
                names += ["und"] * len(own)
                continue
            cosine = vectors(profiles(own), self.idf) @ self.centres.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(len(own)), best].astype(np.float64), 0, 1)
            names += [self.language[k] if ok else "und" for k, ok in zip(best.tolist(), lettered, strict=True)]
            scores[part] = np.where(lettered, top, 0)
            rejected[part] = ~lettered | (top < self.least[best])
        return names, scores, rejected


def _spherical(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Centroids of unit rows; seeded by the rows least like those chosen before."""
    centres = [_unit(x.mean(axis=0, keepdims=True))[0]]
    near = x @ centres[0]
    for _ in range(1, min(k, len(x))):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    own = np.array(centres)
    for _ in range(turns):
        label = (x @ own.T).argmax(axis=1)
        own = _unit(np.array([x[label == j].mean(axis=0) if (label == j).any() else own[j] for j in range(len(own))]))
    return own


def frequencies(texts: DataFrame) -> DataFrame:
    """One row per language of ``texts`` (lang, text): its texts, and in how many each n-gram is, as longs."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for own, part in text_parts(batch, 1, SLICE_CHARS):
                langs = np.array(own.column(0).to_pylist(), object)
                for some in slices([len(t) + SLICE_CHARS // SLICE_ROWS for t in part], SLICE_CHARS):
                    there = profiles(part[some]) > 0
                    for name in set(langs[some]):
                        mine = there[langs[some] == name]
                        counts = held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                        counts[:BUCKETS] += mine.sum(axis=0)
                        counts[BUCKETS] += len(mine)
        for name, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["lang", "counts"])

    def whole(rows: pa.Table) -> pa.Table:
        counts = np.zeros(BUCKETS + 1, np.int64)
        counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
        return pa.table({"lang": rows["lang"].slice(0, 1), "n": pa.array([int(counts[BUCKETS])], pa.int64()), "df": pa.array([counts[:BUCKETS].astype("<i8").tobytes()], pa.binary())})

    counted = texts.mapInArrow(partial, "lang string, counts array<long>").select("lang", F.posexplode("counts").alias("at", "n"))
    return counted.groupBy("lang", "at").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(whole, "lang string, n long, df binary")


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", order: Column | None = None, centroids: int = 4, per_language: int = 600, reject_share: float = 0.5) -> Centroids:
    """Centroids from the rows where ``learn`` holds and text and language are not null.

    Frequencies count all of them; about ``per_language`` texts of each language, chosen by the
    hash of ``order``, are clustered.  With no such row the model knows no language and predicts 'und' for all.
    """
    place = order if order is not None else F.xxhash64(text)
    given = docs.where(learn & F.col(lang).isNotNull())
    rows = {r[0]: r[1] for r in given.groupBy(lang).count().collect()}
    # about per_language texts of each: those whose hash falls in that share of its range
    share = F.create_map(*[F.lit(x) for name, n in rows.items() for x in (name, min(1.0, per_language / n))]) if rows else F.lit(None)
    texts_of = given.where(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    given = given.where(F.pmod(F.xxhash64(place, F.lit(5)), F.lit(1_000_003)) < share[F.col(lang)] * 1_000_003) if rows else given
    sample = written(given.where(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")), "languages")

    total, df = 0.0, np.zeros(BUCKETS)
    for r in frequencies(texts_of).collect():
        weight = min(1.0, per_language / r["n"])
        total, df = total + weight * r["n"], df + weight * np.frombuffer(r["df"], "<i8")
    idf = np.log((1 + total) / (1 + df)).astype(np.float32)
    idf += np.float32(1)

    def clusters(rows: pa.Table) -> pa.Table:
        texts = rows.sort_by("text")["text"].to_pylist()
        x = np.concatenate([vectors(profiles(texts[part]), idf) for part in slices([len(t) + 4000 for t in texts], SLICE_CHARS)])
        own = _spherical(x[np.linalg.norm(x, axis=1) > 0.5], centroids) if (np.linalg.norm(x, axis=1) > 0.5).any() else np.zeros((0, BUCKETS), np.float32)
        near = (x @ own.T).max(axis=1) if len(own) else np.zeros(1)
        least = reject_share * float(np.percentile(near, 2))
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(own), pa.string()), "least": pa.array([least] * len(own), pa.float64()), "centre": pa.array([c.astype("<f4").tobytes() for c in own], pa.binary())})

    found = sorted(sample.groupBy("lang").applyInArrow(clusters, "lang string, least double, centre binary").collect(), key=lambda r: (r["lang"], r["centre"]))
    centres = np.array([np.frombuffer(r["centre"], "<f4") for r in found]) if found else np.zeros((0, BUCKETS), np.float32)
    return Centroids(idf, centres, [r["lang"] for r in found], np.array([r["least"] for r in found]))


def with_language(docs: DataFrame, model: Centroids, text: str = "text", outputs: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds the predicted language, its score (cosine, 0 to 1) and whether the text is rejected.

    Null texts and texts without a letter are 'und' with score 0 and rejected.  Texts of any length
    are read whole.  Columns named as the ``outputs`` are replaced, others pass unchanged; repeated
    rows are predicted each.
    """
    kept = [c for c in docs.columns if c not in outputs]
    given = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    schema = given.select("*", F.lit("").alias(outputs[0]), F.lit(0.0).alias(outputs[1]), F.lit(True).alias(outputs[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for own, texts in text_parts(batch, at, SLICE_CHARS):
                names, scores, rejected = model.predict(texts)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=[*kept, *outputs])

    return given.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 4) == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")), order=F.xxhash64("doc_id"))
    predicted = with_language(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
