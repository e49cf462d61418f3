"""Quality scores from random-indexing word vectors and a small calibrated network.

Tokens are runs of letters, digits or other signs, hashed to ``BUCKETS`` rows.  Every row has a
sparse random index vector; the vector of a token is the sum of the index vectors of its
neighbours within two places, over all texts, damped and scaled.  A document is the mean and the
spread of its tokens' vectors, with its length and how often tokens repeat.  A network of two
layers, written in numpy, is trained on these: five times, each time without a fifth of the rows,
whose loss says when to stop; side by side the five are one network of two layers.  Its outputs are
divided by a temperature fitted on what each row got from the network that had not seen it, so
that they are probabilities.

Vectors are sums of whole numbers over all documents, in any order.  The network is trained on
about ``fit_rows`` labelled rows, chosen by a hash; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, slices, table, text_parts, written
from .hashing import tokens

BUCKETS = 1 << 14
DIMENSIONS = 64
NONZERO = 8
SLICE_CHARS = 250_000
FEATURES = 2 * DIMENSIONS + 3
#: Rows in which the context sums travel.
PARTS = 64
#: Standardised features beyond this many deviations count as this many.
MOST = 6.0


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors: NONZERO entries of +1 or -1 in each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS), np.int8)
    place = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], place] = rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO))
    return out


def _buckets(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16)


def contexts(texts: list[str | None], index: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Adds the index vectors of each bucket's neighbours within two places, inside each text, to ``out``."""
    out = np.zeros((BUCKETS, DIMENSIONS), np.int64) if out is None else out
    for part in slices([len(t or "") + 1 for t in texts], SLICE_CHARS):
        hashed, ends = tokens(texts[part])
        if not len(hashed):
            continue
        bucket = _buckets(hashed)
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at = np.arange(len(bucket)) + 2 * text  # two blank places between texts
        wide = np.zeros((len(bucket) + 2 * len(ends) + 4, DIMENSIONS), np.int8)
        wide[at + 2] = index[bucket]
        near = wide[:-4] + wide[1:-3]
        near += wide[3:-1]
        near += wide[4:]
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[begin]] += np.add.reduceat(near[at[order]], begin, axis=0, dtype=np.int32)
    return out


def corpus_contexts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The context sums of all texts: each task adds up its own, Spark's shuffle brings equal parts together.

    A task holds one array of BUCKETS x DIMENSIONS, then one part of it; the driver gets the total.
    """
    index = index_vectors()
    rows = BUCKETS // PARTS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, texts in text_parts(batch, 0, SLICE_CHARS):
                total = contexts(texts, index, total)
        if total is not None:
            parts = [(k, total[k * rows : (k + 1) * rows]) for k in range(PARTS)]
            yield _parts([(k, x) for k, x in parts if x.any()])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), "<i8").reshape(rows, DIMENSIONS)
                if k != part:
                    if part is not None:
                        yield _parts([(part, total)])
                    part, total = k, np.zeros((rows, DIMENSIONS), np.int64)
                total += own
        if part is not None:
            yield _parts([(part, total)])

    own = docs.select(text).mapInArrow(sums, "part int, sums binary")
    own = own.repartition("part").sortWithinPartitions("part").mapInArrow(added, "part int, sums binary")
    out = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for r in own.collect():  # PARTS rows
        out[r["part"] * rows : (r["part"] + 1) * rows] = np.frombuffer(r["sums"], "<i8").reshape(rows, DIMENSIONS)
    return out


def _parts(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x.astype("<i8").tobytes() for _, x in parts], pa.binary())], names=["part", "sums"])


def word_vectors(context: np.ndarray) -> np.ndarray:
    context = context.astype(np.float64)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.maximum(size, 1e-9) * np.minimum(1, np.log1p(size) / 5)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Features of each text; an empty one has zeros."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for part in slices([len(t or "") + 1 for t in texts], SLICE_CHARS):
        hashed, ends = tokens(texts[part])
        sizes = np.diff(np.concatenate([[0], ends]))
        full = np.flatnonzero(sizes)
        if not full.size:
            continue
        begin = (ends - sizes)[full]
        n = sizes[full][:, None].astype(np.float32)
        own = vectors[_buckets(hashed)]
        mean = np.add.reduceat(own, begin, axis=0) / n
        own *= own
        spread = np.sqrt(np.maximum(np.add.reduceat(own, begin, axis=0) / n - mean * mean, 0))
        again = np.zeros(len(hashed) + 1, np.int64)
        np.cumsum(hashed[1:] == hashed[:-1], out=again[2:])
        near = np.zeros(len(hashed) + 1, np.int64)
        np.cumsum(hashed[2:] == hashed[:-2], out=near[3:])
        stop = begin + sizes[full]
        repeats = [(c[stop] - c[np.minimum(begin + k, stop)])[:, None] / n for c, k in ((again, 1), (near, 2))]
        out[part][full] = np.hstack([mean, spread, np.log1p(n) / 8, *repeats])
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(np.clip((x - self.centre) * self.scale, -MOST, MOST) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)
        return 1 / (1 + np.exp(-z))


def _logits(p: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(x @ p[0] + p[1], 0) @ p[2] + p[3][0]


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean())


def _descend(x, y, test_x, test_y, hidden: int, epochs: int, batch: int, decay: float, rng) -> list[np.ndarray]:
    """Adam with decaying weights on the cross entropy; the weights of the epoch that does best on the test rows."""
    d = x.shape[1]
    p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best, least = p, np.inf
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            a, target = x[rows], y[rows]
            pre = a @ p[0] + p[1]
            h = np.maximum(pre, 0)
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - target) / len(rows)
            back = np.outer(error, p[2]) * (pre > 0)
            grads = [a.T @ back, back.sum(axis=0), h.T @ error, np.array([error.sum()], np.float32)]
            t += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * ((m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + (decay * p[k] if k in (0, 2) else 0))
        loss = _loss(_logits(p, test_x), test_y)
        if loss < least:
            best, least = [a.copy() for a in p], loss
    return best


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 64, decay: float = 0.1, folds: int = 5, seed: int = 11) -> Network:
    """``folds`` networks, each stopped by the fold it has not seen, as one; then the temperature that fits best there.

    Without rows the network gives 0.5 for every text; with one class only, nearly that class.  Fewer
    than 50 rows make one network that is stopped by its own rows.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(np.zeros(d, np.float32), np.ones(d, np.float32), np.zeros((d, hidden), np.float32), np.zeros(hidden, np.float32), np.zeros(hidden, np.float32), 0.0)
    if not len(x):
        return net
    net.centre, net.scale = x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 1e-3)
    own, target = np.clip((x - net.centre) * net.scale, -MOST, MOST).astype(np.float32), y.astype(np.float32)
    fold = rng.permutation(len(x)) % folds if len(x) >= 50 else np.zeros(len(x), int)
    grown, unseen = [], np.zeros(len(x))
    for k in range(int(fold.max()) + 1):
        out = fold == k
        seen = ~out if len(x) >= 50 else out
        grown.append(_descend(own[seen], target[seen], own[out], y[out], hidden, epochs, batch, decay, rng))
        unseen[out] = _logits(grown[-1], own[out])
    net.w1, net.b1 = (np.concatenate([p[i] for p in grown], axis=-1) for i in (0, 1))
    net.w2, net.b2 = np.concatenate([p[2] for p in grown]) / len(grown), float(np.mean([p[3][0] for p in grown]))
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    net.temperature = float(grid[int(np.argmin([_loss(unseen / g, y) for g in grid]))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.network.score(pooled(texts, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", label: str = "quality", fit_rows: int = 12_000, id_col: str = "doc_id") -> QualityModel:
    """The model: word vectors from all texts, the network from labelled rows whose id passes ``learn``.

    Rows with a null label or id do not count.  About ``fit_rows`` labels are used, chosen by a hash of the id; of several labels of an id the
    largest holds.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learn)
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1_000_003)) < share * 1_000_003)
    chosen = chosen.groupBy(id_col).agg(F.max(label).alias("label"))
    sample = written(docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(chosen), id_col).select("text", "label"), "quality")

    vectors = word_vectors(corpus_contexts(docs, text))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in text_parts(batch, 0, SLICE_CHARS):
                x = pooled(texts, vectors)
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], names=["label", "x"])

    rows = sample.mapInArrow(features, f"label {sample.schema['label'].dataType.simpleString()}, x binary").toArrow().combine_chunks()
    order = sorted(range(rows.num_rows), key=lambda i: (rows["x"][i].as_py(), rows["label"][i].as_py()))
    x = np.array([np.frombuffer(rows["x"][i].as_py(), "<f4") for i in order], np.float32).reshape(-1, FEATURES)
    y = np.array([rows["label"][i].as_py() for i in order])
    return QualityModel(vectors, train(x, y))


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", output: str = "score") -> DataFrame:
    """Adds the probability of label 1 for each whole text (empty and null texts are scored alike)."""
    kept = [c for c in docs.columns if c != output]
    given = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in text_parts(batch, at, SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(model.score(texts), pa.float64())], names=[*kept, output])

    return given.mapInArrow(run, given.select("*", F.lit(0.0).alias(output)).schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 5) == 0, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    scored = with_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
