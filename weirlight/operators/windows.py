"""Windows by position that share their boundary points, grids, and the algebra of inclusive intervals.

Intervals are rows (stream, lo, hi) of positions, both ends included; neighbours share a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check_size(size: int) -> int | None:
    """None for -1 (no windows); else a power of two, 2 at least."""
    if size == -1:
        return None
    if size < 2 or size & (size - 1):
        raise ValueError(f"a window's size is -1 or a power of two from 2 on, not {size}")
    return size


def lengths(streams: DataFrame) -> DataFrame:
    return streams.groupBy("stream").agg(F.count("*").cast("int").alias("n"))


def bounds(lengths: DataFrame, size: int) -> DataFrame:
    """(stream, window, lo, hi): windows of ``size`` steps, numbered from 1; the last may be short; one point has none."""
    starts = F.explode(F.sequence(F.lit(0), F.col("n") - 2, F.lit(size)))
    rows = lengths.where("n >= 2").select("stream", "n", starts.alias("lo"))
    return rows.select("stream", (F.col("lo") / size + 1).cast("int").alias("window"), "lo", F.least(F.col("lo") + size, F.col("n") - 1).alias("hi"))


def cut_windows(streams: DataFrame, size: int, min_points: int = 2) -> DataFrame:
    """Each window as a stream ``<source>_<window>`` from position 0, with source, window and offset.

    A boundary point is in two windows; that is arithmetic on the position, without a join. Windows
    of fewer than min_points are left out.
    """
    n = F.count("*").over(Window.partitionBy("stream"))
    rows = streams.withColumn("__n", n.cast("int")).where("__n >= 2")
    k = F.floor(F.col("pos") / size).cast("int")
    # A point at a boundary closes the window before; it opens the next one only if another point follows.
    opens = F.when(F.col("pos") < F.col("__n") - 1, F.array(k)).otherwise(F.array().cast("array<int>"))
    closes = F.when((F.col("pos") % size == 0) & (F.col("pos") > 0), F.array(k - 1)).when(F.col("pos") == F.col("__n") - 1, F.array(k)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__w", F.explode(F.concat(closes, opens)))
    points = F.least(F.lit(size), F.col("__n") - 1 - F.col("__w") * size) + 1
    named = F.concat_ws("_", F.col("stream").cast("string"), F.col("__w") + 1)
    own = [c for c in streams.columns if c not in ("stream", "pos")]
    return rows.where(points >= min_points).select(
        named.alias("stream"), (F.col("pos") - F.col("__w") * size).cast("int").alias("pos"), *own, F.col("stream").alias("source"), (F.col("__w") + 1).alias("window"), (F.col("__w") * size).alias("offset")
    )


def is_windowed(streams: DataFrame) -> bool:
    return {"source", "window", "offset"} <= set(streams.columns)


def merge(intervals: DataFrame, by: str = "stream") -> DataFrame:
    """The union of inclusive intervals: those that overlap or abut become one."""
    w = Window.partitionBy(by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", (reach.isNull() | (F.col("lo") > reach + 1)).cast("int"))
    marked = marked.withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(by, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__run")


def reassemble(flags: DataFrame, flag: str = "flag") -> DataFrame:
    """(stream, pos, flag) of the sources: each window but the first gives up its first point, which is its neighbour's last."""
    kept = flags.where((F.col("window") == 1) | (F.col("pos") > 0))
    return kept.select(F.col("source").alias("stream"), (F.col("offset") + F.col("pos")).cast("int").alias("pos"), flag)


def reassembled_counts(flags: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """(stream, n, n_anomalous_intervals, n_anomalous_points, anomalous_fraction[, max_score]) of sources.

    flags: the points of sources, as reassemble gives them; scored: (source, max_score) of windows.
    """
    runs = segments(flags).groupBy("stream").agg(F.count("*").alias("n_anomalous_intervals"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_anomalous_points"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = flags.groupBy("stream").agg(F.count("*").alias("n")).join(runs, "stream", "left")
    out = out.select("stream", "n", zero("n_anomalous_intervals"), zero("n_anomalous_points"), (zero("n_anomalous_points") / F.col("n")).alias("anomalous_fraction"))
    if scored is None:
        return out
    return out.join(scored.groupBy(F.col("source").alias("stream")).agg(F.max("max_score").alias("max_score")), "stream", "left")


def grid_edges(n: Column, granularity: int) -> Column:
    """Positions of the 2**granularity + 1 edges of a grid over n points, rounded half to even."""
    cells = 2**granularity
    return F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda i: F.rint(i * (n - 1) / cells).cast("int"))


def grid(lengths: DataFrame, granularity: int) -> DataFrame:
    """(stream, depth, lo, hi, n_cells) for all pairs of edges of each stream that is long enough."""
    cells = 2**granularity
    rows = lengths.where(F.col("n") >= cells + 1).select("stream", grid_edges(F.col("n"), granularity).alias("e"))
    rows = rows.select("stream", "e", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("i"))
    rows = rows.select("stream", "e", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(cells))).alias("j"))
    run = F.col("j") - F.col("i")
    return rows.select("stream", F.rint(granularity - F.log2(run)).cast("int").alias("depth"), F.get("e", "i").alias("lo"), F.get("e", "j").alias("hi"), run.alias("n_cells"))


def depth_of(width: Column, depths: list[int]) -> Column:
    """The depth of the list that is nearest to -log2 of a relative width, the smaller of two."""
    sought = -F.log2(F.greatest(F.least(width, F.lit(1.0)), F.lit(1e-12)))
    return F.array_min(F.transform(F.lit(sorted(depths)), lambda d: F.struct(F.abs(d - sought).alias("gap"), d.alias("depth"))))["depth"]


def scale_depth(width: Column, span: Column) -> Column:
    return F.rint(-F.log2(width / span)).cast("int")


def rasterise(points: DataFrame, intervals: DataFrame, flag: str = "flag") -> DataFrame:
    """points with a boolean: in one of the stream's intervals or not.

    The intervals are merged and become their positions, so this is an equi-join, and none that
    multiplies points.
    """
    inside = merge(intervals).select("stream", F.explode(F.sequence("lo", "hi")).alias("pos"), F.lit(True).alias("__in"))
    return points.join(inside, ["stream", "pos"], "left").withColumn(flag, F.coalesce("__in", F.lit(False))).drop("__in")


def segments(flags: DataFrame, flag: str = "flag", by: str = "stream") -> DataFrame:
    """(stream, lo, hi): runs of flagged points, both ends included."""
    w = Window.partitionBy(by).orderBy("pos")
    on = flags.where(F.col(flag)).withColumn("__run", F.col("pos") - F.row_number().over(w))
    return on.groupBy(by, "__run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).drop("__run")


def complement(clean: DataFrame, lengths: DataFrame) -> DataFrame:
    """(stream, lo, hi): what clean blocks leave of each stream, sharing end points with them."""
    ends = lengths.select("stream", (F.col("n") - 1).alias("lo"), (F.col("n") - 1).alias("hi"), F.lit(1).alias("last"))
    rows = clean.select("stream", "lo", "hi", F.lit(0).alias("last")).unionByName(ends)
    w = Window.partitionBy("stream").orderBy("last", "lo", "hi")
    before = F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__b", before).where(F.col("lo") > F.col("__b")).select("stream", F.col("__b").alias("lo"), F.col("lo").alias("hi"))


def locate(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(span columns, lo, hi): positions of the first point from t_from on and of the last up to t_to; null if there is none."""
    at = points.select(F.col("stream").alias("__stream"), F.col("pos").alias("__pos"), F.col("t").alias("__t"))
    inside = (F.col("stream") == F.col("__stream")) & F.col("__t").between(F.col("t_from"), F.col("t_to"))
    return spans.join(at, inside, "left").groupBy(*spans.columns).agg(F.min("__pos").alias("lo"), F.max("__pos").alias("hi"))


def window_ends(lengths: DataFrame, width: int, stride: int) -> DataFrame:
    """(stream, end): the last points of sliding windows, from ``width`` on; the last point where a stream is too short."""
    last = F.col("n") - 1
    ends = F.when(last >= width, F.sequence(F.lit(width), F.greatest(last, F.lit(width)), F.lit(stride))).otherwise(F.array(last))
    return lengths.where("n >= 1").select("stream", F.explode(ends).alias("end"))


def spread_to_points(points: DataFrame, windows: DataFrame, score: str = "score") -> DataFrame:
    """points with the score of the first window that ends at or after each, or else of the last window.

    A forward as-of join without a join: windows are put among the points, and the next one is read.
    """
    rows = points.select("stream", "pos", F.lit(1).alias("__point"), F.lit(None).cast("double").alias(score)).unionByName(
        windows.select("stream", F.col("end").alias("pos"), F.lit(0).alias("__point"), F.col(score).cast("double").alias(score))
    )
    ahead = Window.partitionBy("stream").orderBy("pos", F.col("__point").desc()).rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy("stream").orderBy("pos", "__point").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nearest = F.coalesce(F.first(score, ignorenulls=True).over(ahead), F.last(score, ignorenulls=True).over(behind))
    return rows.withColumn("__s", nearest).where("__point = 1").select("stream", "pos", F.col("__s").alias(score))


def sliding(lengths: DataFrame, width: int, stride: int) -> DataFrame:
    """(stream, lo, hi): windows of ``width`` points at every stride that fit whole."""
    rows = lengths.where(F.col("n") >= width).select("stream", F.explode(F.sequence(F.lit(0), F.col("n") - width, F.lit(stride))).alias("lo"))
    return rows.select("stream", "lo", (F.col("lo") + width - 1).alias("hi"))


def jittered(lengths: DataFrame, width: int, count: int, seed: int) -> DataFrame:
    """(stream, draw, lo, hi): ``count`` windows of ``width`` points at hash-random starts in each stream that is long enough."""
    rows = lengths.where(F.col("n") >= width).select("stream", "n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    # 32 bits of a digest, which any engine can draw again.
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("stream").cast("string"), "draw", F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    lo = F.pmod(bits, F.col("n") - width + 1).cast("int")
    return rows.select("stream", "draw", lo.alias("lo")).withColumn("hi", F.col("lo") + width - 1)


def window_labels(points: DataFrame, windows: DataFrame, label: str = "label", share: float = 2 / 3) -> DataFrame:
    """windows with a boolean: at least the share of its points is labelled."""
    each = windows.withColumn("pos", F.explode(F.sequence("lo", "hi"))).join(points.select("stream", "pos", label), ["stream", "pos"])
    return each.groupBy(*windows.columns).agg((F.avg(F.col(label).cast("double")) >= share).alias("label"))


def paint(points: DataFrame, windows: DataFrame, score: str = "score") -> DataFrame:
    """points with the largest score of the windows over each, and whether there is one."""
    over = windows.select("stream", score, F.explode(F.sequence("lo", "hi")).alias("pos")).groupBy("stream", "pos").agg(F.max(score).alias(score))
    return points.select("stream", "pos").join(over, ["stream", "pos"], "left").withColumn("covered", F.col(score).isNotNull())
