"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features are of itself and of the lines beside it; the
field adds weights for how labels follow each other. Forward-backward gives each line's marginal
probability of being good, and a document's quality is the mean of these, weighed by line length. A
logistic curve, fitted on the labelled documents, makes the score.

Labels are of documents, so the lines' labels are latent: all lines of a good document are good; those
of a bad one start as bad and are then labelled by the field itself, with at least the worst line bad.

Cases: null and empty texts have no line and score 0.0 as bad documents. Lines are split at ``\\n``;
lines of white space only have no weight. Texts of any length are read whole. Equal texts have equal
scores. Without labelled documents of both classes every text with a word scores 1. A column of the
name ``out`` is replaced; other columns stay as they are.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import sample, sigmoid_fit
from ._shared import small_batches
from ._words import code_points, is_space, span_hashes, spans

_SIZE = 0x3100
_CLASS = np.full(_SIZE + 1, 1, np.uint8)
for _i in range(_SIZE):
    _c = unicodedata.category(chr(_i))
    _CLASS[_i] = 2 if _c == "Lu" else 1 if _c[0] in "LM" else 3 if _c[0] == "N" else 0 if _c[0] in "ZC" else 4 if chr(_i) in ".,;:?'\"()-" else 5
_LETTER, _UPPER, _DIGIT, _STOP, _SIGN = 1, 2, 3, 4, 5

#: Own features of a line; the first N_BESIDE of them are also taken of the lines before and after.
N_BESIDE, N_OWN = 7, 17
N_FEATURES = 1 + N_OWN + 2 * N_BESIDE + 3
#: Chains longer than this are fitted in pieces; scoring reads them whole.
FIT_CHAIN = 256


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of the lines; the weight of a line is its count of characters that are no space."""
    if not text:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0)
    points = code_points(text)
    at = np.r_[0, np.flatnonzero(points == 10) + 1]
    n = len(at)
    kind = _CLASS[np.minimum(points, _SIZE)]
    filled = ~is_space(points)

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask)]
        return np.diff(sums[np.r_[at, len(points)]])

    size = per_line(filled)
    some = np.maximum(size, 1)
    starts, ends = spans(filled)
    words = span_hashes(points, starts, ends)
    line = np.searchsorted(at, starts, "right") - 1
    n_words = np.bincount(line, minlength=n)
    some_words = np.maximum(n_words, 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((words, line))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=n)
    length = ends - starts
    last_kind = kind[ends - 1] if len(ends) else kind[:0]
    before_last = np.where(length > 1, kind[np.maximum(ends - 2, 0)], 0) if len(ends) else kind[:0]
    share = lambda mask: np.bincount(line[mask], minlength=n) / some_words
    upper_words = np.diff(np.r_[0, np.cumsum(kind == _LETTER)][np.r_[starts, len(points)]])[: len(starts)] == 0 if len(starts) else again
    long_words = length > 1
    own = np.c_[
        per_line(kind == _UPPER) / some,
        per_line(kind == _SIGN) / some,
        np.bincount(line[again], minlength=n) / some_words,
        1 - distinct / some_words,
        share((last_kind == _SIGN) & (before_last == _SIGN)),
        share(~long_words & (last_kind == _SIGN)),
        share(upper_words & long_words),
        per_line(kind == _DIGIT) / some,
        per_line(kind == _STOP) / some,
        per_line(points > 0x24F) / some,
        np.log1p(size) / 5,
        np.log1p(n_words) / 5,
        np.minimum(size / some_words / 10, 100),
        np.minimum(1 - distinct / some_words, 1) * (n_words >= 8),
        n_words == 0,
        (n_words > 0) & (n_words <= 3),
        share(last_kind == _STOP),
    ].astype(np.float32)
    none = np.zeros((1, N_BESIDE), np.float32)
    beside = own[:, :N_BESIDE]
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, line, words)
    _, inverse, times = np.unique(sums, return_inverse=True, return_counts=True)
    repeated = (times[inverse] > 1) & (n_words > 0)
    same = np.r_[False, (sums[1:] == sums[:-1]) & (n_words[1:] > 0)]
    edge = np.zeros(n)
    edge[0] = edge[-1] = 1
    x = np.c_[np.ones(n), own, np.r_[none, beside[:-1]], np.r_[beside[1:], none], repeated, same, edge]
    return x.astype(np.float32), size.astype(float)


def forward_backward(unary: np.ndarray, pair: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains as rows (padded): (marginals of bad, expected transitions, log of the norm).

    unary: score of bad over good at each place; pair: 2x2 scores; ends: lengths of the chains.
    """
    n, t = unary.shape
    alpha = np.zeros((t, n, 2))
    alpha[0, :, 1] = unary[:, 0]
    for k in range(1, t):
        step = np.logaddexp(alpha[k - 1][:, :1] + pair[0], alpha[k - 1][:, 1:] + pair[1])
        step[:, 1] += unary[:, k]
        alpha[k] = np.where((k < ends)[:, None], step, alpha[k - 1])
    beta = np.zeros((t, n, 2))
    for k in range(t - 2, -1, -1):
        ahead = beta[k + 1].copy()
        ahead[:, 1] += unary[:, k + 1]
        step = np.logaddexp(pair[:, 0][None] + ahead[:, :1], pair[:, 1][None] + ahead[:, 1:])
        beta[k] = np.where((k + 1 < ends)[:, None], step, 0)
    norm = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    marginal = np.exp(np.clip(alpha[:, :, 1] + beta[:, :, 1] - norm, -700, 0)).T
    moves = np.zeros((2, 2))
    for k in range(1, t):
        on = k < ends
        if on.any():
            ahead = beta[k][on].copy()
            ahead[:, 1] += unary[on, k]
            moves += np.exp(np.clip(alpha[k - 1][on][:, :, None] + pair[None] + ahead[:, None, :] - norm[on][:, None, None], -700, 0)).sum(0)
    return marginal, moves, norm


def marginals(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Marginals of bad of one chain, in time in proportion to its length."""
    t = len(unary)
    if t == 1:
        return 1 / (1 + np.exp(-np.clip(unary, -50, 50)))
    # With two labels, each direction is a running log-odds message.
    from math import exp, log

    a, b = np.exp(pair[0]), np.exp(pair[1])
    (gg, gb), (bg, bb) = (float(a[0]), float(a[1])), (float(b[0]), float(b[1]))
    u = np.clip(unary, -50, 50).tolist()
    left, right, o = [0.0] * t, [0.0] * t, u[0]
    left[0] = o
    for k in range(1, t):
        e = exp(o)
        o = log((gb + e * bb) / (gg + e * bg)) + u[k]
        o = 50.0 if o > 50 else -50.0 if o < -50 else o
        left[k] = o
    m = 0.0
    for k in range(t - 2, -1, -1):
        e = exp(min(50.0, max(-50.0, m + u[k + 1])))
        m = log((bg + e * bb) / (gg + e * gb))
        right[k] = m
    z = np.clip(np.array(left) + np.array(right), -50, 50)
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float]

    def quality(self, text: str | None) -> tuple[float, int, int]:
        """(length-weighted mean marginal of good, lines, bad lines)."""
        x, size = line_features(text)
        if not size.sum():
            return 0.0, len(size), len(size)
        bad = marginals((x * self.scale) @ self.weights, self.pair)
        return float(1 - (bad * size).sum() / size.sum()), len(size), int((bad >= 0.5).sum())

    def score(self, quality: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * _logit(quality) + b, -30, 30)))


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _train(chains, labels, each, start, rounds: int, ridge: float):
    """Adam on the conditional log-likelihood of padded chains, each weighed; labels are of bad."""
    ends = np.array([len(c) for c in chains])
    t, width = ends.max(), chains[0].shape[1]
    order = np.argsort(-ends, kind="stable")
    theta = start.copy()
    # Chains of like length share a block, so that short ones aren't padded to the longest.
    blocks = []
    for lo in range(0, len(order), 512):
        rows = order[lo : lo + 512]
        t = ends[rows].max()
        x = np.zeros((len(rows), t, width), np.float32)
        y = np.zeros((len(rows), t))
        for i, r in enumerate(rows):
            x[i, : ends[r]], y[i, : ends[r]] = chains[r], labels[r]
        inside = np.arange(t)[None] < ends[rows][:, None]
        y01 = y.astype(int)
        moves = np.zeros((2, 2))
        pairs_in = inside[:, 1:]
        np.add.at(moves, (y01[:, :-1][pairs_in], y01[:, 1:][pairs_in]), 1)
        blocks.append((x, y, inside, ends[rows], moves, each[rows]))
    total = sum(b[3].sum() for b in blocks)
    m = v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = -ridge * theta
        for x, y, inside, e, moves, w in blocks:
            marginal, expected, _ = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), e)
            grad[:-4] += np.einsum("ntk,nt->k", x, np.where(inside, y - marginal, 0) * w[:, None]) / total
            grad[-4:] += ((moves - expected) / total).ravel()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def fit_lines(lines, labels: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> Model | None:
    """lines: (features, weights) of each document; labels: 1 good, 0 bad."""
    full = [i for i, (x, size) in enumerate(lines) if size.sum()]
    lines, labels = [lines[i] for i in full], labels[full]
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    scale = 1 / (np.concatenate([x for x, _ in lines]).std(0) + 0.05)
    scale[0] = 1
    pieces = [(i, k) for i, (x, _) in enumerate(lines) for k in range(0, len(x), FIT_CHAIN)]
    chains = [lines[i][0][k : k + FIT_CHAIN] * scale.astype(np.float32) for i, k in pieces]
    latent = [np.full(len(x), 1.0 - labels[i]) for i, (x, _) in enumerate(lines)]
    each = np.array([1.0 for i, _ in pieces])
    theta = np.zeros(chains[0].shape[1] + 4)
    for turn in range(3):
        theta = _train(chains, [latent[i][k : k + FIT_CHAIN] for i, k in pieces], each, theta, rounds if not turn else rounds // 2, ridge)
        for i, (x, size) in enumerate(lines):
            if labels[i] == 0:
                bad = marginals((x * scale) @ theta[:-4], theta[-4:].reshape(2, 2))
                latent[i] = (bad >= 0.5).astype(float)
                latent[i][np.argmax(bad * (size > 0))] = 1
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), scale, (1.0, 0.0))
    q = np.array([1 - (marginals((x * scale) @ model.weights, model.pair) * s).sum() / s.sum() for x, s in lines])
    (a,), b = sigmoid_fit(_logit(q)[:, None], labels.astype(float))
    model.curve = (float(max(a, 0.0)), b)
    return model


def fit(docs: DataFrame, labels: DataFrame, k: int = 3, left_out: int = 1, per_class: int = 1500) -> Model | None:
    """Learn from at most about per_class labelled documents of each class, outside the fold left out.

    Line features are taken on the executors; they are all that comes to the driver.
    """
    small_batches(docs.sparkSession)
    drawn = sample(docs, labels, "quality", per_class, k, left_out)

    @F.pandas_udf(T.StructType([T.StructField("x", T.BinaryType()), T.StructField("size", T.BinaryType())]))
    def featured(texts: pd.Series) -> pd.DataFrame:
        found = [line_features(t) for t in texts]
        return pd.DataFrame({"x": [x.tobytes() for x, _ in found], "size": [s.astype(np.float32).tobytes() for _, s in found]})

    rows = drawn.select("doc_id", "label", featured("text").alias("f")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["f"]["x"]))
    lines = [(np.frombuffer(r["f"]["x"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["f"]["size"], np.float32).astype(float)) for r in rows]
    return fit_lines(lines, np.array([int(r["label"]) for r in rows])) if rows else None


def scorer(model: Model | None):
    """A column function: text to struct(score, quality, lines, bad_lines)."""

    @F.pandas_udf("score double, quality double, lines int, bad_lines int")
    def scored(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            some = texts.fillna("").str.strip() != ""
            return pd.DataFrame({"score": some.astype(float), "quality": some.astype(float), "lines": 0, "bad_lines": 0})
        found = pd.DataFrame([model.quality(t) for t in texts], columns=["quality", "lines", "bad_lines"])
        found["score"] = np.where(found["lines"] > found["bad_lines"] * (found["quality"] == 0), model.score(found["quality"].to_numpy()), 0.0)
        return found[["score", "quality", "lines", "bad_lines"]]

    return scored


def score_documents(docs: DataFrame, model: Model | None, text: Column | None = None, out: str = "quality") -> DataFrame:
    """docs with a struct column ``out``."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, scorer(model)(F.col("text") if text is None else text))
