"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids have fold -1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(k)), F.lit(-1)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | dict[int, int], k: int, left_out: int, id_col: str = "doc_id") -> DataFrame:
    """About per_class rows (one bound, or one for each class) of each class of documents whose fold isn't the one left out.

    (id_col, text, label): a row is drawn if its id's hash is under the class's share of the bound,
    so the sample is the same on every run. Rows of null labels or ids are none. ``labels`` may repeat
    ids; the largest label counts.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id_col), k) != left_out))
    one = usable.groupBy(id_col).agg(F.max(label).alias("label"))
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), id_col), 11).cast("double") / F.lit(float(2**53))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, (per_class.get(value, 0) if isinstance(per_class, dict) else per_class) / n))).otherwise(share)
    chosen = one.where(draw < share)
    return docs.select(id_col, "text").join(F.broadcast(chosen), id_col)


def sigmoid_fit(x, y, rounds: int = 400):
    """Weights and bias of a logistic regression of y on the columns of x, both classes weighing the same."""
    import numpy as np

    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    each = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-3] * (len(w) - 1) + [1e-6])
    for _ in range(min(rounds, 60)):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (each * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)
