"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled document of quality 1 that isn't toxic is preferred over every labelled
document of quality 0 or that is toxic.  With P(a beats b) = 1 / (1 + exp(s(b) - s(a)))
and s(x) = w . phi(x), the weights w minimise the logistic loss on the feature
differences phi(a) - phi(b) of all such pairs, plus an L2 term.  Features are shares of
character classes, shape figures, repetition figures and the weight of marker words:
words, and word beginnings of LEAD bytes, whose document counts differ between the preferred
documents and either the toxic or the other ones by a log-likelihood ratio of at least MIN_G2.  All documents are scored; those under a quantile of the
preferred labelled documents' scores are rejected.  Of the levels in LEVELS the one
that best separates the labelled sides is taken (the lowest on a tie).

Nothing is sampled: counts, moments, pairs and threshold cover every labelled document, and
scoring every document, with its whole text.  Their features stay in a table, and each step of Newton's
method is a pass over it.  A pass needn't visit pairs: loss, gradient and Hessian depend on a pair
through s(a) - s(b) only, by functions without a pole nearer than pi to the real line, so within
a cell of CELL in s a polynomial through NODES Chebyshev points gives them to some 1e-13.  A task therefore
adds up, per side and cell, each point's share of 1, phi and phi phi' of its rows, and the driver sums over
pairs of points.  Their number depends on the range of the scores, not on the rows.  The quantiles are
ranks, found exactly by counting below ever closer edges.

Defined cases.  A null text scores like an empty one.  Rows that share a labelled id but not a text are
labelled documents of their own; a repeated row counts once in the fit.  Rows without an id are scored
and kept or rejected like others.  Labels without an id or with a null quality are
ignored unless toxic; a null toxic counts as 0; a document with several labels is
preferred only if all say so.  Labels of unknown documents are ignored.  If the labels
leave one side empty, every score is 0 and every document is kept.  A score equal to
the threshold is kept, so equal documents are treated alike.  Repeated rows are each kept or
rejected.  An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm._text import arrow_batches, buffers, chunks, hash_words, map_rows
from quarrystone.session import discard, materialize

MIN_G2 = 30.0
LEAD = 6
L2 = 1e-3
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.005)
#: Width of a cell of scores, and points in each.
CELL, NODES = 2.0, 16
#: Pairs of points looked at together.
BLOCK_PAIRS = 1 << 20
#: Tasks of a pass over the features at most, as each sends its sums to the driver.
TASKS = 64
#: Parts into which a pass cuts the range where a rank lies.
EDGES = 1 << 13

_AT = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_TO_NODES = (chebvander(_AT, NODES - 1) * np.r_[1.0, np.full(NODES - 1, 2.0)]).T / NODES

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = _CLASS[9] = 3
_CLASS[[10, 13]] = 4
for _k, _s in ((5, "|"), (6, "!?"), (7, ".,;:'\"()-"), (8, "%#*&$@^~_=+<>{}[]\\/`")):
    _CLASS[[ord(c) for c in _s]] = _k
_CLASS[128:] = 9
FEATURES = ("upper", "digit", "space", "newline", "bar", "mark", "stop", "symbol", "wide", "log_words", "distinct", "repeat", "word_length", "line_words", "markers", "marker_share")


@dataclass(frozen=True)
class Model:
    """A fitted ranking: standardised weights, marker words (sorted hashes) and the threshold."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    markers: np.ndarray
    marker_weight: np.ndarray
    level: float
    threshold: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.round(((features - self.mean) / self.scale) @ self.weights, 9)


def features(texts: pa.Array, markers: np.ndarray, marker_weight: np.ndarray) -> np.ndarray:
    """The feature matrix of some texts, one row each."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in chunks(texts):
        for c in range(a, b, 4096):
            d = min(b, c + 4096)
            out[c:d] = _features(texts.slice(c, d - c), markers, marker_weight)
    return out


def _features(texts: pa.Array, markers: np.ndarray, marker_weight: np.ndarray) -> np.ndarray:
    raw, off = buffers(texts)
    n, size = len(texts), np.diff(off)
    doc = np.repeat(np.arange(n), size)
    classes = np.bincount(doc * 10 + _CLASS[raw], minlength=10 * n).reshape(n, 10)
    words = hash_words(texts)
    count = np.diff(words.off)
    of = np.repeat(np.arange(n), count)
    again = np.zeros(n)
    if len(words.h) > 1:
        same = (words.h[1:] == words.h[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n)
    key = np.unique((of.astype(np.uint64) << np.uint64(52)) | (words.h >> np.uint64(12)))
    distinct = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=n)
    length = np.bincount(of, words.ends - words.starts, minlength=n)
    hits, weight = np.zeros(n), np.zeros(n)
    for h in (words.h, hash_words(texts, LEAD).h) if len(markers) else ():
        at = np.minimum(np.searchsorted(markers, h), len(markers) - 1)
        hit = markers[at] == h
        hits += np.bincount(of[hit], minlength=n)
        weight += np.bincount(of[hit], marker_weight[at[hit]], minlength=n)
    some, wordy = np.maximum(size, 1), np.maximum(count, 1)
    share = np.sqrt(classes[:, 1:] / some[:, None])
    rest = np.stack((np.log1p(count), distinct / wordy, np.sqrt(again / wordy), length / wordy, np.log1p(count / (classes[:, 4] + 1)), np.log1p(weight), np.sqrt(hits / wordy)), axis=1)
    return np.hstack((share, rest))


def labelled_side(labels: DataFrame, id_col: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(id, bad): one row for every document that a label puts on a side: 0 preferred, 1 of low quality, 2 toxic."""
    bad = F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 0)
    return labels.select(F.col(id_col).alias("__id"), bad.alias("__bad")).where("__id is not null and __bad is not null").groupBy("__id").agg(F.max("__bad").alias("__bad"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: in how many texts of each side every word occurs."""
    for x in batches:
        bad = x.column(1).to_numpy().astype(np.int64)
        seen, sides = [], []
        for a, b in chunks(x.column(2)):
            part = x.column(2).slice(a, b - a)
            words, leads = hash_words(part), hash_words(part, LEAD)
            for k in range(b - a):
                own = slice(words.off[k], words.off[k + 1])
                u = np.unique(np.concatenate((words.h[own], leads.h[own])))
                u = u[u != 0]
                seen.append(u)
                sides.append(np.full(len(u), bad[a + k]))
        if seen:
            h, back = np.unique(np.concatenate(seen), return_inverse=True)
            side = np.concatenate(sides)
            n = [pa.array(np.bincount(back[side == k], minlength=len(h)).astype(np.int64)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *n], names=["h", "n0", "n1", "n2"])


def _markers(sample: DataFrame, sides: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    counts = sample.mapInArrow(_word_counts, "h long, n0 long, n1 long, n2 long").groupBy("h").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(3)))
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    good, n_good = F.col("n0"), sides[0]
    contrasts = []
    for k in (1, 2):
        if not (n := sides.get(k, 0)):
            continue
        bad = F.col(f"n{k}")
        p = (bad + good) / F.lit(float(n + n_good))
        g2 = 2 * (term(bad, p * n) + term(good, p * n_good))
        odds = F.log(((bad + 0.5) / (n + 1)) / ((good + 0.5) / (n_good + 1)))
        contrasts.append(F.when(odds > 0, F.struct(g2.alias("g2"), odds.alias("w"))))
    best = F.array_max(F.array(*contrasts))
    top = counts.select("h", best.alias("x")).select("h", "x.*").where(F.col("g2") >= MIN_G2).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["w"] for r in top])[order]


def _summed(table: DataFrame, of: Callable[[np.ndarray, np.ndarray], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """``of`` the sides and features of every batch, merged within each task and then here; the table has a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in batches:
            if x.num_rows:
                found = of(x.column(0).to_numpy(zero_copy_only=False), x.column(1).flatten().to_numpy().reshape(x.num_rows, -1))
                total = found if total is None else merge(total, found)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["total"])

    return reduce(merge, (pickle.loads(r["total"]) for r in table.mapInArrow(run, "total binary").collect()))


def _spread(_: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of squared deviations."""
    return len(x), x.mean(0), ((x - x.mean(0)) ** 2).sum(0)


def _merge_spread(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap**2 * (a[0] * b[0] / n)


def _moments(z: np.ndarray) -> np.ndarray:
    """1, the features and the upper half of their products, one row each."""
    left, right = np.triu_indices(z.shape[1])
    return np.hstack((np.ones((len(z), 1)), z, z[:, left] * z[:, right]))


def _cells(bad: np.ndarray, z: np.ndarray, w: np.ndarray) -> dict[tuple[bool, int], np.ndarray]:
    """By side and cell of scores: the moments of its rows, shared out among the cell's points."""
    s = z @ w
    cell = np.floor(s / CELL).astype(np.int64)
    share = chebvander(2 * (s / CELL - cell) - 1, NODES - 1) @ _TO_NODES
    moments = _moments(z)
    keys, which = np.unique(np.stack((bad.astype(np.int64), cell), 1), axis=0, return_inverse=True)
    which = which.ravel()
    return {(bool(b), int(c)): share[rows].T @ moments[rows] for k, (b, c) in enumerate(keys) for rows in (np.flatnonzero(which == k),)}


def _merge_cells(a: dict, b: dict) -> dict:
    for key, block in b.items():
        a[key] = a[key] + block if key in a else block
    return a


def _points(cells: dict[tuple[bool, int], np.ndarray], bad: bool) -> tuple[np.ndarray, np.ndarray]:
    """A side's points and their moments."""
    own = sorted(c for b, c in cells if b == bad)
    return np.concatenate([(c + (_AT + 1) / 2) * CELL for c in own]), np.concatenate([cells[bad, c] for c in own])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn the ranking from all labelled documents."""
    spark = docs.sparkSession
    arrow_batches(spark)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    labelled, labelled_path = materialize(slim.join(labelled_side(labels), "__id").select("__id", "__bad", "__text").distinct(), "labelled")
    sides = {r["__bad"]: r["n"] for r in labelled.groupBy("__bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    k = len(FEATURES)
    if len(sides) < 2 or 0 not in sides:
        discard(spark, labelled_path)
        return Model(np.zeros(k), np.zeros(k), np.ones(k), np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0)
    markers, weight = _markers(labelled, sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            f = features(x.column(1), markers, weight)
            yield pa.RecordBatch.from_arrays([pa.array(x.column(0).to_numpy() > 0), pa.array(list(f), pa.list_(pa.float64()))], names=["bad", "f"])

    table, path = materialize(labelled.select("__bad", "__text").mapInArrow(run, "bad boolean, f array<double>"), "features")
    discard(spark, labelled_path)
    table = table.coalesce(TASKS)
    n, mean, square = _summed(table, _spread, _merge_spread)
    scale = np.sqrt(square / n)
    scale[scale < 1e-9] = 1.0

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cells = _summed(table, lambda bad, x: _cells(bad, (x - mean) / scale, w), _merge_cells)
        return _pair_sums(_points(cells, False), _points(cells, True), w, L2)

    weights = _newton(sums, k)
    model = Model(weights, mean, scale, markers, weight, 0.0, 0.0)
    level, threshold = choose_threshold(lambda edges: _summed(table, lambda bad, x: _below(bad, model.score(x), edges), np.add), sides[0], n - sides[0])
    discard(spark, path)
    return Model(weights, mean, scale, markers, weight, level, threshold)


def _pair_sums(preferred: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], w: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian at ``w``, averaged over all pairs; a side is its points' scores and moments."""
    (left, a), (right, b) = preferred, other
    k = len(w)
    loss, grad, cross, half = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(k * (k + 1) // 2)
    step = max(1, BLOCK_PAIRS // len(right))
    for at in range(0, len(left), step):
        x = a[at : at + step]
        gap = left[at : at + step, None] - right
        e = np.exp(-np.abs(gap))
        loss += float(x[:, 0] @ (np.log1p(e) - np.minimum(gap, 0)) @ b[:, 0])
        p, q = np.where(gap > 0, e, 1.0) / (1 + e), e / (1 + e) ** 2
        grad += (x[:, 0] @ p) @ b[:, 1 : k + 1] - (p @ b[:, 0]) @ x[:, 1 : k + 1]
        half += (x[:, 0] @ q) @ b[:, k + 1 :] + (q @ b[:, 0]) @ x[:, k + 1 :]
        cross += x[:, 1 : k + 1].T @ (q @ b[:, 1 : k + 1])
    hess = np.zeros((k, k))
    hess[np.triu_indices(k)] = half
    hess = hess + np.triu(hess, 1).T - cross - cross.T
    n = a[:, 0].sum() * b[:, 0].sum()
    return loss / n + l2 / 2 * (w @ w), grad / n + l2 * w, hess / n + l2 * np.eye(k)


def _newton(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """The least loss of ``k`` weights, by Newton's method with shorter steps where needed."""
    w = np.zeros(k)
    loss, grad, hess = sums(w)
    for _ in range(50):
        step, size = np.linalg.solve(hess, grad), 1.0
        while True:
            found = sums(w - size * step)
            if found[0] <= loss + 1e-9 or size < 1e-6:
                break
            size /= 2
        w, (loss, grad, hess) = w - size * step, found
        if np.abs(size * step).max() < 1e-5:
            break
    return w


def fit_pairs(preferred: np.ndarray, other: np.ndarray, l2: float = L2) -> np.ndarray:
    """The weights for all pairs of rows held here, each row a point of its own."""
    a, b = _moments(preferred), _moments(other)
    return _newton(lambda w: _pair_sums((preferred @ w, a), (other @ w, b), w, l2), preferred.shape[1])


def _below(bad: np.ndarray, scores: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many preferred and other scores, in units of 1e-9, are below each edge."""
    at = np.searchsorted(edges, np.rint(scores * 1e9).astype(np.int64), side="right")
    return np.stack([np.cumsum(np.bincount(at[bad == k], minlength=len(edges) + 1))[:-1] for k in (False, True)])


def choose_threshold(below: Callable[[np.ndarray], np.ndarray], good: int, bad: int) -> tuple[float, float]:
    """The level in LEVELS, and the preferred side's score there, with the best kept-minus-passed share.

    ``below`` counts the ``good`` preferred and ``bad`` other scores under each of some edges, as ``_below`` does.
    """
    ranks = [int(np.floor(q * (good - 1))) for q in LEVELS]
    low, high = [-(1 << 62)] * len(ranks), [1 << 62] * len(ranks)
    while True:
        edges = np.unique([lo + (hi - lo) * j // EDGES for lo, hi in set(zip(low, high)) for j in range(EDGES + 1)])
        counts = below(edges)
        at = [int(np.searchsorted(counts[0], r, side="right")) - 1 for r in ranks]
        low, high = [int(edges[k]) for k in at], [int(edges[k + 1]) for k in at]
        if all(hi - lo == 1 for lo, hi in zip(low, high)):
            break
    gain = [int(counts[1][k]) * good - int(counts[0][k]) * bad for k in at]
    best = max(range(len(LEVELS)), key=lambda j: (gain[j], -LEVELS[j]))
    return LEVELS[best], low[best] / 1e9


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, kept) of every row."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s = model.score(features(x.column(1), model.markers, model.marker_weight))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(s), pa.array(s >= model.threshold)], names=[id_col, "score", "kept"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s = model.score(features(x.column(at), model.markers, model.marker_weight))
            yield x.filter(pa.array(s >= model.threshold))

    return map_rows(docs, run)
