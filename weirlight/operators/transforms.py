"""Maps along a stream that depend on the order of its points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .streams import along


def lagged(streams: DataFrame, channels: Sequence[str], lag: int, method: str = "delay") -> DataFrame:
    """Lagged streams by either method; lag 0 changes nothing."""
    if lag < 0:
        raise ValueError("lag is negative")
    if lag == 0:
        return streams
    if method == "delay":
        return delay(streams, channels, lag)
    if method == "lead_lag":
        if lag != 1:
            raise ValueError("lead_lag is defined for a lag of 1")
        return lead_lag(streams, channels)
    raise ValueError(f"no lag method {method!r}")


def delay(streams: DataFrame, channels: Sequence[str], lag: int) -> DataFrame:
    """Each channel once more, as it was ``lag`` points before; the first points have the first value."""
    w = along()
    return streams.select("*", *[F.coalesce(F.lag(c, lag).over(w), F.first(c).over(w)).alias(f"{c}_lag{lag}") for c in channels])


def lead_lag(streams: DataFrame, channels: Sequence[str]) -> DataFrame:
    """2n - 1 points of an n-point stream: at j the lead is point ceil(j / 2) and the lag point floor(j / 2); time is the lead's."""
    w = along()
    before = streams.select("*", *[F.lag(c).over(w).alias(f"__{c}") for c in channels])
    even = F.struct(F.lit(0).alias("back"), *[F.col(c).alias(f"{c}_lag") for c in channels])
    odd = F.struct(F.lit(1).alias("back"), *[F.col(f"__{c}").alias(f"{c}_lag") for c in channels])
    steps = before.withColumn("__s", F.explode(F.when(F.col("pos") == 0, F.array(even)).otherwise(F.array(odd, even))))
    return steps.select("stream", (2 * F.col("pos") - F.col("__s.back")).cast("int").alias("pos"), "t", *channels, *[F.col(f"__s.{c}_lag") for c in channels])


def collapse_lead_lag(flags: DataFrame, flag: str = "flag") -> DataFrame:
    """Flags of the points before lead_lag: a point is flagged if either of its two steps is."""
    return flags.groupBy("stream", F.ceil(F.col("pos") / 2).cast("int").alias("pos")).agg(F.bool_or(flag).alias(flag))


def context(streams: DataFrame, channels: Sequence[str], m: int) -> DataFrame:
    """Delay embedding: the channels at each point and at the m - 1 before it, padded by the first value."""
    w = along()
    back = [F.coalesce(F.lag(c, k).over(w), F.first(c).over(w)).alias(f"{c}_{k}") for k in range(m) for c in channels]
    return streams.select("stream", "pos", "t", *back)


def fit_rows(streams: DataFrame, channels: Sequence[str], m: int, stride: int) -> DataFrame:
    """Every stride-th context row."""
    return context(streams, channels, m).where(F.col("pos") % stride == 0)


def rolling_zscore(streams: DataFrame, channels: Sequence[str], width: int) -> DataFrame:
    """The largest absolute z-score over channels against the trailing ``width`` points; null until there are so many, or without spread."""
    w = along().rowsBetween(1 - width, 0)
    z = [F.abs(F.try_divide(F.col(c) - F.avg(c).over(w), F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)))) for c in channels]
    largest = F.greatest(*z) if len(z) > 1 else z[0]
    return streams.select("stream", "pos", F.when(F.count("*").over(w) == width, largest).alias("zscore"))


def smoothness(streams: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Per stream: the mean length of its steps over the length of its vector of deviations."""
    w = along()
    step = sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in channels), F.lit(0.0))
    rows = streams.select("stream", *channels, F.sqrt(step).alias("step"))
    spread = F.sqrt(sum((F.var_pop(c) for c in channels), F.lit(0.0)))
    return rows.groupBy("stream").agg(F.try_divide(F.avg("step"), F.nullif(spread, F.lit(0.0))).alias("smoothness"))


def _profile(x: np.ndarray, m: int) -> np.ndarray:
    """Distance of each z-normalised run of m values to its nearest other run, by one running sum for each diagonal."""
    n = len(x) - m + 1
    if n < 2:
        return np.full(max(n, 0), np.nan)
    sums, squares = np.cumsum(np.r_[0, x]), np.cumsum(np.r_[0, x * x])
    mean = (sums[m:] - sums[:-m]) / m
    std = np.sqrt(np.maximum((squares[m:] - squares[:-m]) / m - mean**2, 0))
    nearest, apart = np.full(n, np.inf), -(-m // 4)
    flat = std < 1e-12
    for k in range(apart + 1, n):
        products = np.cumsum(np.r_[0, x[: len(x) - k] * x[k:]])
        both = products[m:] - products[:-m]
        a, b = slice(0, n - k), slice(k, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (both / m - mean[a] * mean[b]) / (std[a] * std[b])
        r = np.where(flat[a] & flat[b], 1.0, np.where(flat[a] | flat[b], 0.5, r))
        d = np.sqrt(np.maximum(2 * m * (1 - r), 0))
        nearest[a] = np.minimum(nearest[a], d)
        nearest[b] = np.minimum(nearest[b], d)
    return nearest


def matrix_profile(streams: DataFrame, channels: Sequence[str], m: int) -> DataFrame:
    """(stream, pos, profile): the largest profile over channels, at each run's last point; null where there is none."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        found = np.stack([_profile(pdf[c].to_numpy(float), m) for c in channels]).max(0)
        out = np.full(len(pdf), np.nan)
        out[len(pdf) - len(found) :] = np.where(np.isfinite(found), found, np.nan)
        return pd.DataFrame({"stream": pdf["stream"], "pos": pdf["pos"], "profile": out})

    kind = streams.schema["stream"].dataType.simpleString()
    out = streams.select("stream", "pos", *channels).groupBy("stream").applyInPandas(kernel, f"stream {kind}, pos int, profile double")
    return out.withColumn("profile", F.when(~F.isnan("profile"), F.col("profile")))


def matrix_profile_joined(streams: DataFrame, channel: str, m: int) -> DataFrame:
    """The same for one channel as a join of runs with runs, for short streams."""
    w = along().rowsBetween(1 - m, 0)
    runs = streams.select("stream", "pos", F.collect_list(channel).over(w).alias("run")).where(F.size("run") == m)
    runs = runs.withColumn("mean", F.aggregate("run", F.lit(0.0), lambda a, x: a + x) / m)
    spread = F.sqrt(F.aggregate("run", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / m)
    runs = runs.withColumn("std", spread)
    a, b = runs.alias("a"), runs.alias("b")
    pairs = a.join(b, (F.col("a.stream") == F.col("b.stream")) & (F.abs(F.col("a.pos") - F.col("b.pos")) > -(-m // 4)))
    both = F.aggregate(F.zip_with("a.run", "b.run", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r = (both / m - F.col("a.mean") * F.col("b.mean")) / (F.col("a.std") * F.col("b.std"))
    distance = F.sqrt(F.greatest(2 * m * (1 - r), F.lit(0.0)))
    return pairs.groupBy(F.col("a.stream").alias("stream"), F.col("a.pos").alias("pos")).agg(F.min(distance).alias("profile"))


