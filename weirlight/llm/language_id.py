"""Language identification by error-correcting output codes.

Each language has a codeword. One binary classifier for each bit, over hashed character n-grams of the
letters of the whole text, predicts the bits. Decoding is loss-weighted: each codeword's loss is the sum over bits of
the squared hinge loss of the bit's prediction, weighed by how often that bit was right for that
language in cross-validation; the codeword of least loss is the language. The score is its share of
exp(-loss) over all codewords, and a text is ambiguous where the runner-up is too near.

Codewords are all ways to halve the languages while these are at most ``MAX_BITS``, else columns drawn
from a fixed generator that keeps the least distance between codewords largest.

Letters are the code points of Unicode's categories L; marks (M) beside them belong to their words.

Cases: null texts and texts without a letter are ``und`` with score 0. Texts of any length count whole.
Equal texts have equal results. With one language known, it is the prediction for every text with a
letter; with none, ``und``. Rows of null lang or null id are not learned from. A column of the name ``out`` is
replaced; other columns stay as they are.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import sample
from ._shared import small_batches
from ._words import code_points, mix

DIM, MAX_BITS, UNDETERMINED = 4096, 31, "und"
_U = np.uint64
_STEP = 1 << 20


_kinds: list[np.ndarray] = []


def letter_runs(text: str | None) -> np.ndarray | None:
    """The code points of a text's words in lower case, with a space before, between and after; None if no letter."""
    if not text:
        return None
    if not _kinds:
        _kinds.append(np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8))
    points = code_points(f" {text.lower()} ")
    kind = _kinds[0][points]
    if not (kind == 1).any():
        return None
    inside = kind > 0
    # Of what is between words, the first place is kept as the space.
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    runs = np.where(inside, points, 32)[kept]
    return np.r_[32, runs].astype(_U)


def ngram_rates(text: str | None) -> np.ndarray | None:
    """Square roots of the rates of hashed runs of 1, 2 and 3 letters (words have a space around them); None if no letter."""
    points = letter_runs(text)
    if points is None:
        return None
    counts = np.zeros(DIM)
    for at in range(0, len(points), _STEP):
        run = points[max(0, at - 2) : at + _STEP]
        first = min(at, 2)
        for n in (1, 2, 3):
            if len(run) < n:
                continue
            code = run[n - 1 :].copy()
            for k in range(1, n):
                code += run[n - 1 - k : len(run) - k] << _U(21 * k)
            code = code[max(0, first - n + 1) :]
            counts += np.bincount((mix(code + _U(n)) >> _U(52)).astype(np.int64), minlength=DIM)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: one codeword per language."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        columns = range(1, 2 ** (n - 1))
        return np.array([[1 if (c >> i) & 1 else -1 for c in columns] for i in range(n)], dtype=float)
    rng, bits, best, reach = np.random.default_rng(seed), max(MAX_BITS, int(10 * np.log2(n))), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits))
        m[0, np.abs(m.sum(0)) == n] *= -1
        least = (bits - (m @ m.T) + 2 * bits * np.eye(n)).min() / 2
        if least > reach:
            best, reach = m, least
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharpness: float = 12.0

    def losses(self, rates: np.ndarray) -> np.ndarray:
        margins = rates @ self.weights + self.bias
        loss = np.maximum(0, 1 - margins[:, None, :] * self.codes[None]) ** 2
        return (loss * self.trust[None]).sum(-1)

    def predict(self, texts) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": UNDETERMINED, "score": 0.0, "runner_up": None, "ambiguous": False}, index=range(len(texts)))
        rates = [ngram_rates(t) for t in texts]
        full = [i for i, r in enumerate(rates) if r is not None]
        if not full or not self.languages:
            return out
        loss = self.losses(np.stack([rates[i] for i in full]))
        chance = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        order = np.argsort(loss, 1, kind="stable")
        names, at = np.array(self.languages, dtype=object), np.arange(len(full))
        out.loc[full, "lang_pred"] = names[order[:, 0]]
        out.loc[full, "score"] = chance[at, order[:, 0]]
        if len(names) > 1:
            out.loc[full, "runner_up"] = names[order[:, 1]]
            out.loc[full, "ambiguous"] = chance[at, order[:, 1]] > 0.25
        return out


def _ridge(x: np.ndarray, y: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares classifiers of the columns of y, by the smaller of the two normal systems."""
    mean = x.mean(0)
    z, shift = (x - mean).astype(np.float64), y.mean(0)
    if len(z) <= z.shape[1]:
        w = z.T @ np.linalg.solve(z @ z.T + strength * np.eye(len(z)), y - shift)
    else:
        w = np.linalg.solve(z.T @ z + strength * np.eye(z.shape[1]), z.T @ (y - shift))
    return w, shift - mean @ w


def fit_rates(rates: np.ndarray, langs: list[str], strength: float = 0.5, folds: int = 3) -> Model:
    names = sorted(set(langs))
    at = np.array([names.index(x) for x in langs], dtype=int)
    codes = codewords(len(names))
    trust = np.full(codes.shape, 1 / max(1, codes.shape[1]))
    if len(names) < 2:
        return Model(names, codes, np.zeros((DIM, codes.shape[1])), np.ones(codes.shape[1]), trust)
    y = codes[at]
    right = np.zeros(y.shape)
    part = np.arange(len(y)) % folds
    for k in range(folds):
        if (part == k).any() and (part != k).any():
            w, b = _ridge(rates[part != k], y[part != k], strength)
            right[part == k] = np.sign(rates[part == k] @ w + b) == y[part == k]
    for i in range(len(names)):
        if (at == i).any():
            trust[i] = right[at == i].mean(0) + 0.01
    trust /= trust.sum(1, keepdims=True)
    w, b = _ridge(rates, y, strength)
    return Model(names, codes, w.astype(np.float32), b, trust)


def fit(docs: DataFrame, k: int = 3, left_out: int = 1, per_language: int = 400) -> Model:
    """Learn from at most about per_language documents of each lang, outside the fold left out.

    The n-gram rates are counted on the executors; one row of DIM numbers for each drawn document
    comes to the driver.
    """
    small_batches(docs.sparkSession)
    drawn = sample(docs, docs.select("doc_id", "lang"), "lang", per_language, k, left_out)

    @F.pandas_udf(T.BinaryType())
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (r := ngram_rates(t)) is None else r.astype(np.float16).tobytes())

    rows = drawn.select("doc_id", "label", packed("text").alias("rates")).where("rates is not null").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["rates"]))
    if not rows:
        return Model([], codewords(0), np.zeros((DIM, 1)), np.zeros(1), np.zeros((0, 1)))
    return fit_rates(np.stack([np.frombuffer(r["rates"], np.float16).astype(np.float32) for r in rows]), [r["label"] for r in rows])


def identifier(model: Model):
    """A column function: text to struct(lang_pred, score, runner_up, ambiguous)."""

    @F.pandas_udf("lang_pred string, score double, runner_up string, ambiguous boolean")
    def identified(texts: pd.Series) -> pd.DataFrame:
        return model.predict(texts.tolist())

    return identified


def identify(docs: DataFrame, model: Model, text: Column | None = None, out: str = "language") -> DataFrame:
    """docs with a struct column ``out``."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, identifier(model)(F.col("text") if text is None else text))
