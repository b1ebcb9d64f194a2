"""Quality classifier: random-indexing word vectors and a two-layer network.

1. Every word form falls into one of ``BUCKETS`` buckets by its hash, and every
   bucket has a fixed sparse random index vector.  A word's vector is the sum
   of the index vectors found around it, over all documents; a Spark
   aggregation sums the parts, whose size does not depend on the corpus.
   The outer form of a word (capitals, signs, digits, same as the word before)
   is a second kind of token with vectors of its own.
2. A document is the mean of the vectors of its words and of its forms.
3. A network with one hidden layer is fitted in numpy to at most
   ``SAMPLE`` labelled documents, the bound of the only sample here, and its
   probabilities are calibrated by one temperature on documents kept aside.

Only the text is an input of a score.  Labels are learnt from rows whose
``crc32(doc_id as text) mod 3`` is not 1.  A null text counts as empty; an empty
text has a zero vector and is scored like any other.  A null ``doc_id`` is
scored and never learnt from.  Several labels of one document count by their
mean.  Repeated rows are scored alike, further columns are kept by
``score_documents`` and an empty table gives an empty one.  With no labels, or
labels of one kind only, every score is the share of good labels (0.5 if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.llm.common import byte_blocks, ids_and_texts, word_hashes

BUCKETS = 1 << 13
FORMS = 256
DIM = 48
NONZERO = 4
WINDOW = 2
SAMPLE = 20_000
HIDDEN = 32
SEED = 7

_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_SIGN = np.ones(256, dtype=np.int32)
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = 0
_SIGN[128:] = 0
_SIGN[[0x20, *range(0x09, 0x0E)]] = 0
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[48:58] = 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of every token's index vector."""
    draw = np.random.default_rng(SEED)
    n = BUCKETS + FORMS
    return draw.integers(0, DIM, (n, NONZERO)), draw.choice([-1.0, 1.0], (n, NONZERO))


def tokens(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word bucket, form, document`` of every word of a block of texts."""
    start, end, _ = word_hashes(data)
    _, _, hashed = word_hashes(data.lower())
    raw = np.frombuffer(data, dtype=np.uint8)

    def within(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[raw])))
        return sums[end] - sums[start]

    doc = np.searchsorted(bounds, start, side="right") - 1
    length = end - start
    signs = within(_SIGN)
    capitals = np.minimum(within(_UPPER), 2) * ((length - signs > 1) | (signs > 0))
    again = np.zeros(len(start), dtype=np.int64)
    again[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    alone = signs == length
    form = np.minimum(signs, 3) + 4 * capitals + 12 * (within(_DIGIT) > 0) + 24 * again + 48 * alone
    form = form + 96 * (length > 15)
    return (hashed % np.uint64(BUCKETS)).astype(np.int64), form.astype(np.int64), doc


def _context_sums(texts: Iterator) -> np.ndarray:
    """The sum of the index vectors around every token."""
    places, signs = _index_vectors()
    total = np.zeros((BUCKETS + FORMS) * DIM)
    for _, data, bounds in byte_blocks(texts):
        word, form, doc = tokens(data, bounds)
        form = form + BUCKETS
        # a form stands beside its word, and words beside their neighbours
        pairs = [(word, word), (word, form), (form, form)]
        for k in range(1, WINDOW + 1):
            near = doc[k:] == doc[:-k]
            a, b = word[:-k][near], word[k:][near]
            pairs += [(a, b), (b, a)]
        for target, seen in pairs:
            for j in range(NONZERO):
                total += np.bincount(
                    target * DIM + places[seen, j], weights=signs[seen, j], minlength=len(total)
                )
    return total.reshape(-1, DIM)


def _vector_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = _context_sums(text for part in batches for text in part["text"])
    used = np.flatnonzero(np.abs(sums).sum(axis=1))
    out = pd.DataFrame(sums[used], columns=[f"v{j}" for j in range(DIM)])
    out.insert(0, "token", used)
    yield out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One unit vector per bucket and form, from all documents."""
    schema = "token long, " + ", ".join(f"v{j} double" for j in range(DIM))
    parts = ids_and_texts(docs).select("text").mapInPandas(_vector_parts, schema)
    sums = parts.groupBy("token").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(DIM)])
    table = np.zeros((BUCKETS + FORMS, DIM))
    for row in sums.toLocalIterator():  # BUCKETS + FORMS rows at most
        table[row[0]] = row[1:]
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(texts, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean form vector of each text, and its log length."""
    out = np.zeros((len(texts), 2 * DIM + 1))
    for which, data, bounds in byte_blocks(texts):
        word, form, doc = tokens(data, bounds)
        n = np.bincount(doc, minlength=len(which)).astype(float)
        first = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        for at in np.flatnonzero(n > 0).tolist():
            w, f = word[first[at] : first[at + 1]], form[first[at] : first[at + 1]]
            row = out[which[at]]
            for lo in range(0, len(w), 1 << 15):
                row[:DIM] += vectors[w[lo : lo + (1 << 15)]].sum(axis=0)
            row[DIM : 2 * DIM] = np.bincount(f, minlength=FORMS) @ vectors[BUCKETS:]
        pool = np.maximum(n, 1)[:, None]
        out[which, : 2 * DIM] /= pool
        out[which, 2 * DIM] = np.log1p(n)
    return out


@dataclass(frozen=True)
class Network:
    """Standardised inputs, one hidden layer, one output, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


def _constant(width: int, share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    zero = np.zeros((width, 1))
    bias = float(np.log(share / (1 - share)))
    return Network(np.zeros(width), np.ones(width), zero, np.zeros(1), np.zeros(1), bias, 1.0)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60) -> Network:
    """Adam on the logistic loss; a fifth of the rows sets the temperature."""
    if len(y) < 10 or y.min() == y.max():
        return _constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
    draw = np.random.default_rng(SEED)
    order = draw.permutation(len(y))
    aside, learn = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
    z = (x - mean) / scale
    width = x.shape[1]
    p = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    batch = 128
    for _ in range(epochs):
        draw.shuffle(learn)
        for at in range(0, len(learn), batch):
            rows = learn[at : at + batch]
            h = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    raw = net.raw(x[aside])
    ladder = np.exp(np.linspace(-1.5, 2.5, 161))
    loss = [np.mean(np.logaddexp(0, np.where(y[aside] > 0.5, -raw, raw) / t)) for t in ladder]
    return Network(mean, scale, p[0], p[1], p[2], net.b2, float(ladder[int(np.argmin(loss))]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network

    def scorer(self, spark):
        """A column function; the vectors go out once per executor (2 MB)."""
        shared, network = spark.sparkContext.broadcast(self.vectors), self.network

        @F.pandas_udf(T.DoubleType())
        def score(text: pd.Series) -> pd.Series:
            return pd.Series(network.score(pooled(text.tolist(), shared.value)))

        return score


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all of ``docs``, a network from ``sample`` labels at most."""
    vectors = word_vectors(docs)
    marks = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double"))
        .filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # one text of each id, whichever rows come first: ``sample`` rows at most
    rows = ids_and_texts(docs).join(F.broadcast(marks), "doc_id").groupBy("doc_id", "y").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = pooled(part["text"].tolist(), shared.value).astype(np.float32)
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": list(x)})

    found = rows.mapInPandas(features, "doc_id long, y double, x array<float>").toPandas()
    if not len(found):
        return QualityModel(vectors, _constant(2 * DIM + 1, 0.5))
    found = found.sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=np.float64)
    return QualityModel(vectors, fit(x, (found["y"].to_numpy() > 0.5).astype(float)))


def score_documents(docs: DataFrame, model: QualityModel, column: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for better text."""
    return docs.withColumn(column, model.scorer(docs.sparkSession)(F.col("text").cast("string")))


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score_documents(ids_and_texts(docs), model, "score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
