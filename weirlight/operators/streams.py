"""Canonical streams: building, naming, screening, selecting and cutting them.

A stream set is a long DataFrame: ``stream``, ``pos`` (0, 1, ...), ``t`` (seconds) and one double column
for each channel. A nested set has one row per stream, with arrays ``Time`` and ``Points`` (a name that differs from ``stream`` by more than case, as Spark needs).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import finite

#: Names that are taken for the time column, in order of preference (fixed values).
TIME_NAMES = ("time", "timestamp", "datetime", "date", "t")
NESTED = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("Time", T.ArrayType(T.DoubleType())),
        T.StructField("Points", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)


def along(by: str = "stream") -> Window:
    """The window of a stream in order of position."""
    return Window.partitionBy(by).orderBy("pos")


def time_column(columns: Sequence[str], named: str | None = None) -> str | None:
    """The named column, or the first that is called like a time."""
    if named is not None:
        if named not in columns:
            raise ValueError(f"no column {named!r} among {list(columns)}")
        return named
    lowered = {c.lower(): c for c in reversed(columns)}
    return next((lowered[n] for n in TIME_NAMES if n in lowered), None)


def elapsed(column: str, kind: str, order: Window) -> Column:
    """Seconds: numbers stay as they are; timestamps count from the stream's first one; none gives positions."""
    if kind.startswith("timestamp") or kind in ("date", "string"):
        at = F.col(column).cast("timestamp_ntz")
        first = F.first(at).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.timestamp_diff("MICROSECOND", first, at) / F.lit(1e6)
    return F.col(column).cast("double")


def canonicalise(df: DataFrame, stream: str | Column, order: Sequence[str], channels: dict[str, Column | str], time: str | None = None) -> DataFrame:
    """Long streams of df: positions in ``order``, time from the column ``time`` or else the position."""
    named = df.withColumn("__stream", F.col(stream) if isinstance(stream, str) else stream)
    w = Window.partitionBy("__stream").orderBy(*order)
    pos = F.row_number().over(w) - 1
    t = pos.cast("double") if time is None else elapsed(time, dict(df.dtypes)[time], w)
    values = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in channels.items()]
    return named.select(F.col("__stream").alias("stream"), pos.cast("int").alias("pos"), t.alias("t"), *values)


def nest(streams: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per stream, as NESTED."""
    point = F.struct("pos", "t", F.array(*channels).alias("x"))
    rows = streams.groupBy("stream").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return rows.select(F.col("stream").cast("string").alias("stream"), F.col("p.t").alias("Time"), F.col("p.x").alias("Points"))


def unnest(nested: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Long streams of a nested set; every point must have as many values as there are channels."""
    rows = nested.select("stream", "Time", F.posexplode("Points").alias("pos", "x"))
    good = F.assert_true(F.size("x") == len(channels), F.lit("a point has another number of channels"))
    values = [F.get("x", F.lit(i)).alias(c) for i, c in enumerate(channels)]
    return rows.where(good.isNull()).select("stream", "pos", F.get("Time", "pos").alias("t"), *values)


def summarise(streams: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Per stream: length, channels, first and last time, whether all is finite."""
    whole = F.lit(True)
    for c in ("t", *channels):
        whole = whole & finite(F.col(c))
    return streams.groupBy("stream").agg(
        F.count("*").alias("length"),
        F.lit(len(channels)).cast("long").alias("channels"),
        F.min_by("t", "pos").alias("t_start"),
        F.max_by("t", "pos").alias("t_end"),
        F.bool_and(whole).alias("finite"),
    )


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def _endless(c: str) -> Column:
    return F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False))


def nonfinite(channels: Sequence[str]) -> Column:
    """Whether a row has a missing or infinite value."""
    bad = F.lit(False)
    for c in channels:
        bad = bad | _missing(c) | _endless(c)
    return bad


def nonfinite_report(streams: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row for each stream with a missing or infinite value: how many, in how many rows, where first, which channels."""
    rows = streams.withColumn("bad", nonfinite(channels))
    counts = [sum((f(c).cast("int") for c in channels), F.lit(0)) for f in (_missing, _endless)]
    hit = F.array_compact(F.array(*[F.when(F.bool_or(_missing(c) | _endless(c)), F.lit(c)) for c in channels]))
    found = rows.groupBy("stream").agg(
        F.sum(counts[0]).alias("n_nan"),
        F.sum(counts[1]).alias("n_inf"),
        F.sum(F.col("bad").cast("int")).alias("rows"),
        F.min(F.when(F.col("bad"), F.col("pos"))).alias("first_row"),
        F.array_join(hit, ",").alias("columns"),
    )
    reason = F.when(F.col("n_inf") == 0, "nan").when(F.col("n_nan") == 0, "inf").otherwise("nan,inf")
    return found.where("rows > 0").withColumn("reason", reason)


def screen(streams: DataFrame, channels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(streams that are finite throughout, the report on the others): a stream goes or stays whole."""
    # Over the streams themselves: a join with the report would read them, and deal them out, once more.
    some = F.max(nonfinite(channels)).over(Window.partitionBy("stream"))
    clean = streams.withColumn("__bad", some).where(~F.col("__bad") | F.col("stream").isNull()).drop("__bad")
    return clean, nonfinite_report(streams, channels)


def cut_in_time(streams: DataFrame, fraction: float) -> DataFrame:
    """Each stream in two, named ``_a`` and ``_b``, after the rounded (half to even) fraction of its points; both have one at least."""
    n = F.count("*").over(Window.partitionBy("stream"))
    cut = F.least(n - 1, F.greatest(F.lit(1), F.rint(F.lit(fraction) * n)))
    early = F.col("pos") < F.col("__cut")
    return (
        streams.withColumn("__cut", cut.cast("int"))
        .withColumn("stream", F.concat(F.col("stream").cast("string"), F.when(early, "_a").otherwise("_b")))
        .withColumn("pos", F.when(early, F.col("pos")).otherwise(F.col("pos") - F.col("__cut")))
        .drop("__cut")
    )


def source_of(name: Column) -> Column:
    """The name without a trailing ``_<digits>``; a name that would be empty stays."""
    head = F.regexp_replace(name, r"_[0-9]+$", "")
    return F.when(head == "", name).otherwise(head)


def side_of(name: Column) -> Column:
    """corpus for names whose second part is 0, else test."""
    return F.when(F.try_element_at(F.split(name, "_"), F.lit(2)) == "0", "corpus").otherwise("test")


def restrict(streams: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Some channels only; time and bookkeeping stay."""
    absent = [c for c in channels if c not in streams.columns]
    if absent:
        raise ValueError(f"no columns {absent}")
    return streams.select("stream", "pos", "t", *channels)


def channel_spread(streams: DataFrame, channels: Sequence[str], target: str | None = None) -> DataFrame:
    """(channel, std, corr): population deviation of each channel, and its correlation with a target column."""
    stats = []
    for c in channels:
        stats += [F.stddev_pop(c).alias(f"s_{c}"), (F.corr(c, target) if target else F.lit(None).cast("double")).alias(f"r_{c}")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"s_{c}").alias("std"), F.col(f"r_{c}").alias("corr")) for c in channels]))
    return streams.agg(*stats).select(rows.alias("r")).select("r.*")


def top_channels(streams: DataFrame, channels: Sequence[str], n: int, target: str | None = None) -> DataFrame:
    """The n channels that move most (population deviation), or that go most with a target; ties by name."""
    spread = channel_spread(streams, channels, target)
    by = F.col("std") if target is None else F.abs("corr")
    return spread.orderBy(by.desc_nulls_last(), "channel").limit(n)


def name_columns(df: DataFrame, time: str | int | None = None) -> tuple[DataFrame, str | None]:
    """(df, name of its time column): columns that are called by number become Time and Variable_1, ...

    ``time`` is a name where columns have names, else a position, which may count from the end.
    """
    if not all(re.fullmatch(r"-?\d+", c) for c in df.columns):
        return df, time_column(df.columns, None if time is None else str(time))
    at = None
    if time is not None:
        if not re.fullmatch(r"-?\d+", str(time)):
            raise ValueError(f"the columns have no names, so {time!r} is none of them: give a position")
        at = int(time)
        if not -len(df.columns) <= at < len(df.columns):
            raise ValueError(f"position {at} is outside {len(df.columns)} columns")
        at %= len(df.columns)
    others = iter(range(1, len(df.columns) + 1))
    return df.toDF(*["Time" if i == at else f"Variable_{next(others)}" for i in range(len(df.columns))]), None if at is None else "Time"


def remaining_life(streams: DataFrame, horizon: int, final: DataFrame | None = None) -> DataFrame:
    """rul (points to the stream's end, plus ``final.rul`` of streams that were cut short), degraded and healthy."""
    rul = F.max("pos").over(Window.partitionBy("stream")) - F.col("pos")
    if final is not None:
        streams = streams.join(final.select("stream", F.col("rul").alias("__final")), "stream", "left")
        rul = rul + F.coalesce("__final", F.lit(0))
    out = streams.withColumn("rul", rul)
    return out.withColumn("degraded", F.col("rul") <= horizon).withColumn("healthy", F.col("rul") > 2 * horizon).drop("__final")


def strided(streams: DataFrame, stride: int, channels: Sequence[str]) -> DataFrame:
    """Every stride-th point, with 0 for nulls."""
    return streams.where(F.col("pos") % stride == 0).fillna(0.0, list(channels))


def divide(streams: DataFrame, test: DataFrame | None, fraction: float) -> tuple[DataFrame, DataFrame]:
    """(corpus, test): the given ones, or the earlier and later parts of each stream."""
    if test is not None:
        return streams, test
    both = cut_in_time(streams, fraction)
    return both.where(F.col("stream").endswith("_a")), both.where(F.col("stream").endswith("_b"))
