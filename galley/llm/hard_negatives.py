"""Hard-negative mining: for an anchor and one of its nearest rows of the same
label, the nearest rows of other labels that score a little less.

Every component x becomes floor(``scale`` * x); a score is the inner product of
two such vectors.  Higher scores come first, ties by the smaller ``vec_id``.

Both searches are threshold joins of a block of anchors with all rows:

* The anchors of a block (``BLOCK`` at most, so their size is bounded) are an
  inverted index over bands of dimensions, in the order of their energy.  With a
  threshold t of an anchor and the largest norm M of the rows at hand, the last
  bands whose suffix norm times M stays below t are left out of the index.
* Partial scores are accumulated band by band.  An anchor leaves as soon as no
  row's partial score and the remaining norms of both reach t; pairs that could
  are finished with the dimensions that were left out.
* Thresholds start high and are lowered until every window of an anchor is full
  or its lower end is reached.  A full window keeps the threshold at its last
  row, so later rows of the task are mostly pruned.

A task reads its rows once per block, a part at a time, and hands on at most
``k`` rows per window; a rank filter takes the first ``k`` of all tasks.  The
first join fills the windows of the positives, the second one those of the
negatives, whose ends are the positive scores.  No row is shuffled, and equal
vectors of equal label in a part are scored once: only their ``k + 1`` smallest
ids can matter.

Rows that go wrong: a null ``vec_id``, label or vector, or any null or
non-finite component, takes no part.  Rows equal in id, label and vector count
once.  Rows of one id with different vectors are rows of their own; none is
"other" to an anchor of that id.  Vectors of different lengths have no score.
Scores are exact below 2**53 in size and as doubles beyond.  An anchor without
positives or without negatives in its windows gives no rows; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.common import numbered
from galley.operators.report import first_rows
from galley.plans.joins import durable

SCALE = 256
BLOCK = 4096
ROWS_AT_ONCE = 2048
ANCHORS_AT_ONCE = 1024
BAND = 8
LOWER_BY = 0.8
FOUND = "anchor long, window int, score double, vec_id long"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding array<double>`` of the rows that take part."""
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")
    ).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    )


@dataclass
class Rows:
    """Rows of one length; ``vectors`` are whole numbers held as doubles."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def by_length(batch: pa.RecordBatch, scale: int) -> Iterator[Rows]:
    lists = batch.column("embedding")
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    for d in np.unique(sizes):
        which = np.flatnonzero(sizes == d)
        values = flat[starts[which][:, None] + np.arange(d)]
        yield Rows(ids[which], labels[which], np.floor(scale * values))


def _first_of_equals(rows: Rows, k: int) -> Rows:
    """The ``k`` smallest ids of every (label, vector)."""
    key = np.ascontiguousarray(np.column_stack([rows.labels.astype(float), rows.vectors]))
    _, same = np.unique(key.view(np.dtype((np.void, key.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((rows.ids, same))
    s, i = same[order], rows.ids[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    order, s = order[fresh], s[fresh]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    keep = order[place < k]
    return Rows(rows.ids[keep], rows.labels[keep], rows.vectors[keep])


class Index:
    """Anchors as an inverted index over bands of dimensions."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.argsort(-(vectors**2).sum(axis=0), kind="stable")
        self.q = vectors[:, self.order]
        d = vectors.shape[1]
        self.edges = [*range(0, d, BAND), d]
        self.rest = self._rest(self.q)

    def _rest(self, x: np.ndarray) -> np.ndarray:
        """Norms of the dimensions from each band on."""
        tail = np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1]
        tail = np.concatenate((tail, np.zeros((len(x), 1))), axis=1)
        return np.sqrt(tail[:, self.edges]) * (1 + 1e-9)

    def at_least(self, which: np.ndarray, t: np.ndarray, x: np.ndarray):
        """``anchor, row, score`` of all pairs of the anchors ``which`` with a score
        of ``t`` (one per anchor) or more; ``anchor`` counts within ``which``."""
        q, rest, x = self.q[which], self.rest[which], x[:, self.order]
        x_rest = self._rest(x)
        # bands that a threshold covers are left out of the index
        covered = rest * x_rest[:, 0].max(initial=0.0) < t[:, None]
        indexed = np.where(covered.any(axis=1), covered.argmax(axis=1), len(self.edges) - 1)
        total = np.zeros((len(q), len(x)))
        alive = np.arange(len(q))[~covered[:, 0]]
        for b, (lo, hi) in enumerate(zip(self.edges[:-1], self.edges[1:])):
            posting = alive[indexed[alive] > b]
            if not len(posting):
                break
            total[posting] += q[posting, lo:hi] @ x[:, lo:hi].T
            if b % 2:  # prune by the remaining norms
                best = (total[posting] + rest[posting, b + 1, None] * x_rest[None, :, b + 1]).max(axis=1)
                alive = np.setdiff1d(alive, posting[best < t[posting]], assume_unique=True)
        found = []
        for stop in np.unique(indexed[alive]):
            part = alive[indexed[alive] == stop]
            could = total[part] + rest[part, stop, None] * x_rest[None, :, stop] >= t[part, None]
            i, j = np.nonzero(could)
            i, lo = part[i], self.edges[stop]
            score = total[i, j]
            for at in range(0, len(i), 1 << 16):  # the dimensions left out
                some = slice(at, at + (1 << 16))
                score[some] += (q[i[some], lo:] * x[j[some], lo:]).sum(axis=1)
            good = score >= t[i]
            found.append((i[good], j[good], score[good]))
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none, none.astype(float)
        return tuple(np.concatenate(c) for c in zip(*found))


class Windows:
    """The first ``k`` rows of every window of every anchor.

    A window is ``low <= score <= high``; rows of the anchor's own label fill it
    if ``same``, of other labels if not.
    """

    def __init__(self, anchors: Rows, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.anchors, self.low, self.high, self.k, self.same = anchors, low, high, k, same
        n, w = low.shape
        self.score = np.full((n, w, k), -np.inf)
        self.ids = np.full((n, w, k), np.iinfo(np.int64).max)
        self.index = Index(anchors.vectors)
        self.norm = self.index.rest[:, 0]
        self.open = np.flatnonzero((low <= high).any(axis=1))

    def add(self, rows: Rows) -> None:
        rows = _first_of_equals(rows, self.k + 1)
        longest = np.sqrt((rows.vectors**2).sum(axis=1)).max(initial=0.0)
        for at in range(0, len(self.open), ANCHORS_AT_ONCE):
            part = self.open[at : at + ANCHORS_AT_ONCE]
            before = self.score[part].copy(), self.ids[part].copy()
            # no score is beyond this, and a window ends no lower than its last row
            t = np.minimum(self.norm[part] * longest, self.high[part].max(axis=1)) * (1 + 1e-9)
            todo = np.ones(len(part), dtype=bool)
            while todo.any():
                end = self._ends(part)
                t = np.where(t > 0, np.maximum(np.maximum(t * LOWER_BY, 0.0), end), end)
                t = np.where(t < 1, end, t)
                some = np.flatnonzero(todo)
                which = part[some]
                self.score[which], self.ids[which] = before[0][some], before[1][some]
                self._join(which, t[some], rows)
                todo[some] = t[some] > self._ends(which)

    def _ends(self, which: np.ndarray) -> np.ndarray:
        """What a row must score to enter any window of an anchor."""
        last = np.maximum(self.score[which][:, :, -1], self.low[which])
        last = np.where(self.low[which] <= self.high[which], last, np.inf)
        return np.maximum(last.min(axis=1), -1e300)

    def _join(self, which: np.ndarray, t: np.ndarray, rows: Rows) -> None:
        i, j, score = self.index.at_least(which, t, rows.vectors)
        a = which[i]
        fits = (rows.labels[j] == self.anchors.labels[a]) == self.same
        fits &= rows.ids[j] != self.anchors.ids[a]
        a, j, score = a[fits], j[fits], score[fits]
        for w in range(self.low.shape[1]):
            inside = (score >= self.low[a, w]) & (score <= self.high[a, w])
            if inside.any():
                self._keep(w, a[inside], score[inside], rows.ids[j[inside]])

    def _keep(self, w: int, a: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(a)
        a = np.concatenate((a, np.repeat(touched, self.k)))
        score = np.concatenate((score, self.score[touched, w].ravel()))
        ids = np.concatenate((ids, self.ids[touched, w].ravel()))
        order = np.lexsort((ids, -score, a))
        a, score, ids = a[order], score[order], ids[order]
        fresh = np.ones(len(a), dtype=bool)  # equal rows count once
        fresh[1:] = (a[1:] != a[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        a, score, ids = a[fresh], score[fresh], ids[fresh]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        first = place < self.k
        self.score[touched, w], self.ids[touched, w] = -np.inf, np.iinfo(np.int64).max
        self.score[a[first], w, place[first]] = score[first]
        self.ids[a[first], w, place[first]] = ids[first]

    def found(self, numbers: np.ndarray) -> pa.RecordBatch:
        i, w, p = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(numbers[i], pa.int64()),
                pa.array(w.astype(np.int32)),
                pa.array(self.score[i, w, p]),
                pa.array(self.ids[i, w, p], pa.int64()),
            ],
            names=["anchor", "window", "score", "vec_id"],
        )


def _fill(rows: DataFrame, block: pd.DataFrame, k: int, same: bool, scale: int) -> DataFrame:
    """``anchor, window, score, vec_id``: the first rows of every window of a block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # BLOCK anchors at most

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        windows = {}
        for d, part in anchors.groupby(anchors["embedding"].map(len)):
            own = Rows(
                part["vec_id"].to_numpy(),
                part["label"].to_numpy(),
                np.floor(scale * np.array(part["embedding"].tolist(), dtype=float).reshape(len(part), d)),
            )
            low, high = (np.array(part[c].tolist(), dtype=float) for c in ("low", "high"))
            windows[d] = Windows(own, low, high, k, same), part["anchor"].to_numpy()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for some in by_length(batch.slice(at, ROWS_AT_ONCE), scale):
                    if some.vectors.shape[1] in windows:
                        windows[some.vectors.shape[1]][0].add(some)
        for filled, numbers in windows.values():
            yield filled.found(numbers)

    found = rows.mapInArrow(task, FOUND).distinct()
    order = [F.col("score").desc(), F.col("vec_id")]
    first = durable(first_rows(found, ["anchor", "window"], order, k))
    shared.destroy()
    return first


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 5,
    least: int = 80,
    most: int = 100,
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``least`` and ``most`` are hundredths of the positive score between which a
    negative scores, ends included.
    """
    rows = usable(vectors)
    anchors = numbered(durable(rows.filter(is_anchor).distinct()), "anchor")
    n = anchors.count()
    parts = []
    for at in range(0, n, block):
        some = anchors.filter(F.col("anchor").between(at, at + block - 1)).toPandas()
        none = [[-np.inf]] * len(some), [[np.inf]] * len(some)
        positives = _fill(rows, some.assign(low=none[0], high=none[1]), n_positives, True, scale)
        ranked = positives.groupBy("anchor").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("p")
        )
        scores = {r["anchor"]: [-x["s"] for x in r["p"]] for r in ranked.collect()}  # a block's own
        high = [(scores.get(a, []) + [-np.inf] * n_positives)[:n_positives] for a in some["anchor"]]
        # an exact lower end: a whole number of hundredths, rounded up
        low = [[np.inf if s == -np.inf else -(-least * s // 100) for s in row] for row in high]
        top = [[-np.inf if s == -np.inf else most * s // 100 for s in row] for row in high]
        negatives = _fill(rows, some.assign(low=low, high=top), n_negatives, False, scale)
        listed = ranked.select("anchor", F.posexplode("p").alias("window", "p"))
        parts.append((listed, negatives))
    if not parts:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], schema)
    listed, negatives = parts[0]
    for more in parts[1:]:
        listed, negatives = listed.unionByName(more[0]), negatives.unionByName(more[1])
    by_window = negatives.groupBy("anchor", "window").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("n")
    )
    found = listed.join(by_window, ["anchor", "window"]).select(
        "anchor", "p", F.posexplode("n").alias("place", "n")
    )
    return found.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id",
        F.col("p.vec_id").alias("positive_id"),
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("n.vec_id").alias("negative_id"),
        (-F.col("p.s")).cast("long").alias("positive_score"),
        (-F.col("n.s")).cast("long").alias("negative_score"),
    )
