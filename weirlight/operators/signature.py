"""Truncated path signatures of intervals, with a base point at the origin.

The path of an interval starts at 0, goes to its first point and then along its points; time is the first
channel. Terms are in levels, each level row-major, without the constant term. Levels 1 and 2 have a
closed form in sums over steps and stay in Spark's own expressions; deeper ones are products of
truncated tensors in NumPy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import finite
from .streams import along
from .windows import grid, lengths

#: Signatures of more terms are refused.
MOST_TERMS = 100_000


def n_terms(width: int, depth: int) -> int:
    return sum(width**k for k in range(1, depth + 1))


def truncation_of(width: int, terms: int) -> int:
    """The depth at which a path of ``width`` channels has so many terms."""
    depth = 1
    while n_terms(width, depth) < terms:
        depth += 1
    if n_terms(width, depth) != terms:
        raise ValueError(f"no depth has {terms} terms for {width} channels")
    return depth


def term_levels(width: int, depth: int) -> list[int]:
    return [k for k in range(1, depth + 1) for _ in range(width**k)]


def usable_time(streams: DataFrame) -> DataFrame:
    """streams with t evenly from 0 to 1 where a stream's own time is not finite throughout."""
    w = Window.partitionBy("stream")
    even = F.coalesce(F.try_divide(F.col("pos").cast("double"), (F.count("*").over(w) - 1).cast("double")), F.lit(0.0))
    return streams.withColumn("t", F.when(F.bool_and(finite(F.col("t"))).over(w), F.col("t")).otherwise(even))


def _area(a: str, b: str, w) -> Column:
    return 0.5 * (F.lag(a).over(w) + F.col(a)) * (F.col(b) - F.lag(b).over(w))


def signatures(streams: DataFrame, channels: Sequence[str], intervals: DataFrame, depth: int = 2) -> DataFrame:
    """intervals (stream, lo, hi, ...) with ``sig``, of depth 1 or 2, each summed over its own points."""
    path = ["t", *channels]
    d = len(path)
    w = along()
    rows = streams.select("stream", "pos", F.array(*path).alias("x"), *([F.array(*[_area(a, b, w) for a in path for b in path]).alias("area")] if depth == 2 else []))
    keys = intervals.columns
    inside = (F.col("__stream") == intervals["stream"]) & F.col("pos").between(F.col("lo"), F.col("hi"))
    joined = intervals.join(rows.withColumnRenamed("stream", "__stream"), inside)
    last = F.max_by("x", "pos").alias("__hi")
    if depth == 1:
        return joined.groupBy(*keys).agg(last).select(*keys, F.col("__hi").alias("sig"))
    sums = [F.sum(F.when(F.col("pos") > F.col("lo"), F.get("area", F.lit(k))).otherwise(0.0)).alias(f"__{k}") for k in range(d * d)]
    grouped = joined.groupBy(*keys).agg(last, F.min_by("x", "pos").alias("__lo"), *sums)
    second = [F.col(f"__{i * d + j}") + 0.5 * F.get("__lo", F.lit(i)) * F.get("__lo", F.lit(j)) for i in range(d) for j in range(d)]
    return grouped.select(*keys, F.concat("__hi", F.array(*second)).alias("sig"))


def prefix_signatures(streams: DataFrame, channels: Sequence[str], intervals: DataFrame) -> DataFrame:
    """The same at depth 2 by differences of running sums: two points of the stream for each interval.

    Equal to ``signatures`` but for rounding, which grows with the stream; meant for short windows.
    """
    path = ["t", *channels]
    d = len(path)
    w = along()
    area = F.array(*[F.coalesce(_area(a, b, w), F.lit(0.0)) for a in path for b in path])
    steps = streams.select("stream", "pos", F.array(*path).alias("x"), area.alias("area"))
    running = F.array(*[F.sum(F.get("area", F.lit(k))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in range(d * d)])
    points = steps.select("stream", "pos", "x", running.alias("run"))
    nested = points.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "run"))).alias("p"))
    at = lambda c: F.get("p", c)
    ends = intervals.join(nested, "stream").withColumn("__a", at(F.col("lo"))).withColumn("__b", at(F.col("hi"))).drop("p")
    second = [0.5 * F.get("__a.x", F.lit(i)) * F.get("__a.x", F.lit(j)) + F.get("__b.run", F.lit(i * d + j)) - F.get("__a.run", F.lit(i * d + j)) for i in range(d) for j in range(d)]
    return ends.withColumn("sig", F.concat("__b.x", F.array(*second))).drop("__a", "__b")


def _step(state: list[np.ndarray], v: np.ndarray, depth: int) -> list[np.ndarray]:
    """Chen's product with the exponential of v, by levels; batches of paths at a time."""
    power, factor = [], v
    for k in range(1, depth + 1):
        power.append(factor)
        factor = (factor[:, :, None] * v[:, None, :] / (k + 1)).reshape(len(v), -1)
    out = []
    for k in range(depth):
        level = power[k] + state[k]
        for i in range(k):
            level = level + (state[i][:, :, None] * power[k - 1 - i][:, None, :]).reshape(len(v), -1)
        out.append(level)
    return out


def sign(paths: np.ndarray, depth: int) -> np.ndarray:
    """Base-pointed signatures of paths of equal length: (n, points, width) to (n, terms)."""
    paths = np.asarray(paths, float)
    n, _, d = paths.shape
    if n_terms(d, depth) > MOST_TERMS:
        raise ValueError(f"{n_terms(d, depth)} terms are more than {MOST_TERMS}")
    steps = np.diff(np.concatenate([np.zeros((n, 1, d)), paths], 1), axis=1)
    state = [np.zeros((n, d**k)) for k in range(1, depth + 1)]
    for k in range(steps.shape[1]):
        state = _step(state, steps[:, k], depth)
    return np.concatenate(state, 1)


def combine(a: np.ndarray, b: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Chen's identity: the signature of one path followed by another, from their signatures."""
    cuts = np.cumsum([width**k for k in range(1, depth + 1)])[:-1]
    left, right = np.split(a, cuts, -1), np.split(b, cuts, -1)
    out = []
    for k in range(depth):
        level = left[k] + right[k]
        for i in range(k):
            level = level + (left[i][..., :, None] * right[k - 1 - i][..., None, :]).reshape(*level.shape)
        out.append(level)
    return np.concatenate(out, -1)


def add_base_point(sig: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """The base-pointed signature from one that starts at the path's first point."""
    return combine(sign(np.asarray(first, float)[None, None], depth)[0], sig, len(first), depth)


class Signer:
    """Signatures of any interval of one path: halves are signed once and combined; exact signs each directly."""

    def __init__(self, path: np.ndarray, depth: int, exact: bool = True):
        self.path, self.depth, self.exact = np.asarray(path, float), depth, exact
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def _between(self, lo: int, hi: int) -> np.ndarray:
        """Signature of the steps from lo to hi, without the base point."""
        if (lo, hi) not in self.kept:
            if hi - lo == 1:
                found = sign((self.path[hi] - self.path[lo])[None, None], self.depth)[0]
            else:
                mid = (lo + hi) // 2
                found = combine(self._between(lo, mid), self._between(mid, hi), self.path.shape[1], self.depth)
            self.kept[lo, hi] = found
        return self.kept[lo, hi]

    def __call__(self, lo: int, hi: int) -> np.ndarray:
        if self.exact:
            return sign(self.path[None, lo : hi + 1], self.depth)[0]
        first = self.path[lo]
        return sign(first[None, None], self.depth)[0] if hi == lo else add_base_point(self._between(lo, hi), first, self.depth)


def deep_signatures(streams: DataFrame, channels: Sequence[str], intervals: DataFrame, depth: int) -> DataFrame:
    """intervals with ``sig`` of any depth, one stream at a time in NumPy, intervals of equal length together."""
    path = ["t", *channels]
    if n_terms(len(path), depth) > MOST_TERMS:
        raise ValueError(f"{n_terms(len(path), depth)} terms are more than {MOST_TERMS}")
    kind = dict(streams.dtypes)["stream"]
    more = [c for c in intervals.columns if c != "stream"]
    schema = ", ".join([f"stream {kind}", *[f"`{c}` {dict(intervals.dtypes)[c]}" for c in more], "sig array<double>"])

    def kernel(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        x = points.sort_values("pos")[path].to_numpy(float)
        out = []
        for width, part in asked.groupby(asked["hi"] - asked["lo"]):
            found = sign(np.stack([x[lo : lo + width + 1] for lo in part["lo"]]), depth)
            out.append(part.assign(sig=list(found)))
        return pd.concat(out)[["stream", *more, "sig"]] if out else asked.assign(sig=[])[["stream", *more, "sig"]]

    return streams.select("stream", "pos", *path).groupBy("stream").cogroup(intervals.groupBy("stream")).applyInPandas(kernel, schema)


def of_intervals(streams: DataFrame, channels: Sequence[str], intervals: DataFrame, depth: int, short: bool = False) -> DataFrame:
    """intervals with ``sig`` by the form that suits the depth; streams that are short, as windows are, by running sums."""
    if depth > 2:
        return deep_signatures(streams, channels, intervals, depth)
    return prefix_signatures(streams, channels, intervals) if short and depth == 2 else signatures(streams, channels, intervals, depth)


def corpus(streams: DataFrame, channels: Sequence[str], granularity: int = 3, depth: int = 2, fast: bool = False) -> DataFrame:
    """(stream, depth, lo, hi, n_cells, sig) of every grid interval of every stream that is long enough."""
    ready = usable_time(streams)
    intervals = grid(lengths(ready), granularity)
    return of_intervals(ready, channels, intervals, depth, fast)


def terms(sigs: DataFrame) -> DataFrame:
    """One row per term: the row's columns without sig, ``term`` and ``value``."""
    own = [c for c in sigs.columns if c != "sig"]
    return sigs.select(*own, F.posexplode("sig").alias("term", "value"))
