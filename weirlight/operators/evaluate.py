"""Point-wise, range-based and ranking metrics, cuts and summaries.

Points are rows (stream, pos, label, flag [, score]); undefined ratios are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import safe_ratio
from .windows import rasterise, segments


def labels_to_failure(points: DataFrame, horizon: int) -> DataFrame:
    """points with label: one of the last horizon + 1 of its stream."""
    return points.withColumn("label", F.count("*").over(Window.partitionBy("stream")) - 1 - F.col("pos") <= horizon)


def truth(points: DataFrame, given: DataFrame) -> DataFrame:
    """(stream, pos, label) of points by labels (stream, pos, label), or else by intervals (stream, lo, hi)."""
    if "label" in given.columns:
        return points.select("stream", "pos").join(given.select("stream", "pos", F.col("label").cast("boolean").alias("label")), ["stream", "pos"], "left").withColumn("label", F.coalesce("label", F.lit(False)))
    return rasterise(points.select("stream", "pos"), given, "label")


def missing_truth(points: DataFrame, given: DataFrame) -> DataFrame:
    """Streams without truth: there should be none."""
    return points.select("stream").distinct().join(given.select("stream").distinct(), "stream", "left_anti")


def _counts(label: str, flag: str) -> list[Column]:
    y, p = F.col(label).cast("boolean"), F.col(flag).cast("boolean")
    one = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    return [one(y & p, "tp"), one(~y & p, "fp"), one(y & ~p, "fn"), one(~y & ~p, "tn")]


def _scored(counts: DataFrame) -> DataFrame:
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def prf(points: DataFrame, label: str = "label", flag: str = "flag", by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1, of all or for each group."""
    return _scored(points.groupBy(*by).agg(*_counts(label, flag)) if by else points.agg(*_counts(label, flag)))


def rates(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """prf with tpr and fpr."""
    return prf(points, by=by).withColumn("tpr", F.col("recall")).withColumn("fpr", safe_ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def flag_all(points: DataFrame) -> DataFrame:
    return prf(points.withColumn("flag", F.lit(True)))


def point_adjust(points: DataFrame) -> DataFrame:
    """points with ``adjusted``: a hit in a run of labelled points counts for the whole run.

    Runs are of the streams one after the other, so those that touch where one stream ends and the
    next begins are one run. Runs within a stream come from the stream alone; what joins them across
    streams is decided on one row per stream.
    """
    w = Window.partitionBy("stream").orderBy("pos")
    y = F.col("label").cast("boolean")
    rows = points.withColumn("__gap", F.sum(F.when(y, 0).otherwise(1)).over(w))
    runs = rows.where(y).groupBy("stream", "__gap").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.bool_or("flag").alias("hit"))
    edges = points.groupBy("stream").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    across = Window.orderBy("stream", "lo")
    runs = runs.join(edges, "stream")
    starts = runs.select("stream", "__gap", "lo", "hit", (F.col("lo") == F.col("first")).alias("opens"), (F.col("hi") == F.col("last")).alias("closes"))
    # Only runs at an edge of their stream can be joined to another stream's.
    edge = starts.where("opens or closes")
    order = edges.select("stream").withColumn("at", F.row_number().over(Window.orderBy("stream")))
    edge = edge.join(order, "stream")
    same = F.lag("closes").over(across) & F.col("opens") & (F.lag("at").over(across) == F.col("at") - 1)
    edge = edge.withColumn("group", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(across))
    joined = edge.withColumn("any", F.bool_or("hit").over(Window.partitionBy("group"))).select("stream", "__gap", "any")
    hits = starts.join(joined, ["stream", "__gap"], "left").select("stream", "__gap", F.coalesce("any", "hit").alias("__any"))
    return rows.join(hits, ["stream", "__gap"], "left").withColumn("adjusted", F.when(y, F.col("__any")).otherwise(F.col("flag"))).drop("__gap", "__any")


def range_metrics(points: DataFrame) -> DataFrame:
    """(level, recall, precision) for AD1 to AD4, averaged over ranges of truth and of prediction.

    Recall of a range: 1 if it is hit (AD1); the share of it that is found (AD2); that times 1 less the
    share that passes before the first find (AD3); that if just one predicted range meets it, else 0
    (AD4). Precision of a predicted range: the share of it that is true; for AD4, if it meets just one
    true range, else 0.
    """
    real, said = segments(points, "label"), segments(points, "flag")

    def overlaps(of: DataFrame, other: DataFrame) -> DataFrame:
        o = other.select(F.col("stream").alias("s"), F.col("lo").alias("a"), F.col("hi").alias("b"))
        meets = (F.col("stream") == F.col("s")) & (F.col("a") <= F.col("hi")) & (F.col("lo") <= F.col("b"))
        size = F.greatest(F.least("hi", "b") - F.greatest("lo", "a") + 1, F.lit(0))
        n = F.col("hi") - F.col("lo") + 1
        grouped = of.join(o, meets, "left").groupBy("stream", "lo", "hi").agg(F.count("a").alias("meets"), F.coalesce(F.sum(size), F.lit(0)).alias("inside"), F.min(F.greatest("a", "lo")).alias("first"))
        return grouped.withColumn("share", F.col("inside") / n).withColumn("late", F.coalesce((F.col("first") - F.col("lo")) / n, F.lit(1.0)))

    r, p = overlaps(real, said), overlaps(said, real)
    timely = F.col("share") * (1 - F.col("late"))
    recall = r.agg(
        *[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"r{k}") for k, x in enumerate((F.when(F.col("meets") > 0, 1.0).otherwise(0.0), F.col("share"), timely, F.when(F.col("meets") == 1, timely).otherwise(0.0)), 1)]
    )
    precision = p.agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("p1"), F.coalesce(F.avg(F.when(F.col("meets") == 1, F.col("share")).otherwise(0.0)), F.lit(0.0)).alias("p4"))
    rows = F.array(*[F.struct(F.lit(f"AD{k}").alias("level"), F.col(f"r{k}").alias("recall"), F.col("p4" if k == 4 else "p1").alias("precision")) for k in (1, 2, 3, 4)])
    return recall.crossJoin(F.broadcast(precision)).select(F.explode(rows).alias("m")).select("m.*")


def finite_scores(points: DataFrame, score: str = "score") -> DataFrame:
    """points with NaN scores as 0 and infinite ones as the largest finite one."""
    x = F.col(score)
    largest = points.agg(F.coalesce(F.max(F.when(~F.isnan(x) & (x != float("inf")), x)), F.lit(0.0)).alias("__m"))
    out = points.crossJoin(F.broadcast(largest))
    return out.withColumn(score, F.when(F.isnan(x) | x.isNull(), 0.0).when(x == float("inf"), F.col("__m")).otherwise(x)).drop("__m")


def curve(points: DataFrame, score: str = "score") -> DataFrame:
    """One row per distinct score, highest first: score, tp, fp, positives, negatives.

    The points are counted by score before anything is put in order. The running sums go by ranges of
    scores, each with the sum of the ranges above it, so no task holds all scores.
    """
    y = F.col("label").cast("boolean")
    by_score = points.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(y, 1).otherwise(0)).cast("long").alias("p"), F.sum(F.when(y, 0).otherwise(1)).cast("long").alias("n"))
    cuts = [v for v in dict.fromkeys((by_score.agg(F.percentile_approx("score", [i / 64 for i in range(1, 64)]).alias("c")).first()["c"]) or [])]
    part = F.size(F.filter(F.lit(cuts), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    parted = by_score.withColumn("part", part)
    totals = parted.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("nn").over(above), F.lit(0)).alias("n0"), F.sum("pp").over(all_rows).alias("positives"), F.sum("nn").over(all_rows).alias("negatives"))
    w = Window.partitionBy("part").orderBy(F.col("score").desc())
    joined = parted.join(F.broadcast(totals), "part")
    return joined.select("score", "p", "n", (F.col("p0") + F.sum("p").over(w)).alias("tp"), (F.col("n0") + F.sum("n").over(w)).alias("fp"), "positives", "negatives")


def ranking(points: DataFrame, score: str = "score") -> DataFrame:
    """roc_auc, average_precision and its lift over the share of positives; no row if there is one class only. Ties count half."""
    c = curve(finite_scores(points, score), score)
    area = F.col("n") * ((F.col("tp") - F.col("p")) + F.col("p") / 2)
    steps = F.col("p") / F.col("positives") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    agg = c.agg(F.sum(area).alias("a"), F.max("positives").alias("P"), F.max("negatives").alias("N"), F.sum(F.when(F.col("positives") > 0, steps)).alias("average_precision"))
    agg = agg.where("P > 0 and N > 0").withColumn("roc_auc", F.col("a") / (F.col("P") * F.col("N")))
    return agg.select("roc_auc", "average_precision", (F.col("average_precision") / (F.col("P") / (F.col("P") + F.col("N")))).alias("lift"))


def trapezoid(operating: DataFrame) -> DataFrame:
    """Area under the distinct (fpr, tpr) with the corners (0, 0) and (1, 1)."""
    spark = operating.sparkSession
    corners = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    rows = operating.select("fpr", "tpr").unionByName(corners).distinct()
    w = Window.orderBy("fpr", "tpr")
    part = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return rows.select(part.alias("a")).agg(F.sum("a").alias("area"))


def youden_cut(points: DataFrame, score: str = "score") -> DataFrame:
    """(cut, tpr, fpr): the score at which tpr - fpr is largest; the highest of equal ones."""
    c = curve(points, score).withColumn("tpr", safe_ratio(F.col("tp"), F.col("positives"))).withColumn("fpr", safe_ratio(F.col("fp"), F.col("negatives")))
    best = F.max_by(F.struct("score", "tpr", "fpr"), F.struct((F.col("tpr") - F.col("fpr")).alias("j"), "score"))
    return c.agg(best.alias("b")).select(F.col("b.score").alias("cut"), "b.tpr", "b.fpr")


def f1_cut(points: DataFrame, score: str = "score") -> DataFrame:
    """(cut, precision, recall, f1) at the score of the best f1; the highest of equal ones."""
    c = curve(points, score).withColumn("fn", F.col("positives") - F.col("tp"))
    c = _scored(c)
    best = F.max_by(F.struct("score", "precision", "recall", "f1"), F.struct("f1", "score"))
    return c.agg(best.alias("b")).select(F.col("b.score").alias("cut"), "b.precision", "b.recall", "b.f1")


def percentile_sweep(points: DataFrame, percentiles: Sequence[float], score: str = "score") -> DataFrame:
    """prf with points over each percentile of the scores flagged."""
    cuts = points.agg(*[F.percentile(score, F.lit(p / 100)).alias(f"c{i}") for i, p in enumerate(percentiles)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.col(f"c{i}").alias("cut")) for i, p in enumerate(percentiles)]))
    few = cuts.select(rows.alias("r")).select("r.*")
    return prf(points.crossJoin(F.broadcast(few)).withColumn("flag", F.col(score) > F.col("cut")), by=["percentile", "cut"])


def vote_curve(votes: DataFrame, draws: int) -> DataFrame:
    """prf of points with at least v votes, for v = 1 ... draws. The points are counted by votes first."""
    y = F.col("label").cast("boolean")
    by_votes = votes.groupBy("votes").agg(F.sum(F.when(y, 1).otherwise(0)).alias("p"), F.sum(F.when(y, 0).otherwise(1)).alias("n"))
    steps = votes.sparkSession.range(1, draws + 1).select(F.col("id").cast("int").alias("v"))
    up = F.col("votes") >= F.col("v")
    count = lambda c, on, name: F.sum(F.when(on, F.col(c)).otherwise(0)).cast("long").alias(name)
    grouped = by_votes.crossJoin(F.broadcast(steps)).groupBy("v").agg(count("p", up, "tp"), count("n", up, "fp"), count("p", ~up, "fn"))
    return _scored(grouped)


def health_curve(points: DataFrame, score: str = "score", by: str = "rul") -> DataFrame:
    """Per remaining life: mean, median and quartiles of the scores, and the number of streams."""
    q = lambda p: F.percentile(score, F.lit(p))
    return points.groupBy(by).agg(F.avg(score).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.countDistinct("stream").alias("streams"))


def separation(points: DataFrame, score: str = "score") -> DataFrame:
    """Median score of labelled points over that of the others."""
    mid = lambda on: F.percentile(F.when(on, F.col(score)), F.lit(0.5))
    y = F.col("label").cast("boolean")
    return points.agg((mid(y) / F.greatest(mid(~y), F.lit(1e-9))).alias("separation"))


def classify(intervals: DataFrame) -> DataFrame:
    """intervals with a verdict and a rank by ratio; equal ratios share the least rank.

    The distinct ratios are ranked; there are far fewer of them than of intervals where many are equal.
    """
    counts = intervals.groupBy("ratio").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("ratio").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("ratio", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("long").alias("rank"))
    return intervals.join(ranks, "ratio").withColumn("verdict", F.when(F.col("ratio") > 1, "anomalous").otherwise("inconclusive"))


def summarise(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per stream: intervals of each verdict, their points, the share of the stream and the largest ratio."""
    bad = F.col("verdict") == "anomalous"
    agg = intervals.groupBy("stream").agg(
        F.count("*").alias("n_intervals"), F.count_if(bad).alias("n_anomalous"), F.count_if(~bad).alias("n_inconclusive"), F.sum(F.when(bad, F.col("hi") - F.col("lo") + 1).otherwise(0)).alias("n_points"), F.max("ratio").alias("max_ratio")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return lengths.join(agg, "stream", "left").select("stream", *[zero(c) for c in ("n_intervals", "n_anomalous", "n_inconclusive", "n_points")], (zero("n_points") / F.col("n")).alias("fraction"), "max_ratio")


def evaluate(points: DataFrame, score: str | None = None) -> dict[str, float]:
    """All metrics of points as one flat dictionary: a few rows come to the driver."""
    out = {k: v for k, v in prf(points).first().asDict().items()}
    adjusted = prf(point_adjust(points).withColumn("flag", F.col("adjusted"))).first()
    out |= {f"adjusted_{k}": adjusted[k] for k in ("precision", "recall", "f1")}
    out["flag_all_f1"] = flag_all(points).first()["f1"]
    for r in range_metrics(points).collect():
        out |= {f"{r['level'].lower()}_recall": r["recall"], f"{r['level'].lower()}_precision": r["precision"]}
    if score and (rank := ranking(points, score).first()):
        out |= rank.asDict()
    return out


def point_level(points: DataFrame) -> DataFrame:
    """One row: prf over the covered points, plain (point_) and adjusted (adj_), and the share of points that is covered.

    points: stream, pos, flag, label, covered. Points are adjusted over whole runs, covered or not.
    """
    adjusted = point_adjust(points).where("covered").select("label", "flag", "adjusted")
    names = ("tp", "fp", "fn", "tn", "precision", "recall", "f1")
    plain = prf(adjusted).select(*[F.col(c).alias(f"point_{c}") for c in names])
    joined = prf(adjusted, flag="adjusted").select(*[F.col(c).alias(f"adj_{c}") for c in names])
    share = points.agg(F.avg(F.col("covered").cast("double")).alias("covered_fraction"))
    # One row each.
    return plain.crossJoin(joined).crossJoin(share)


def window_report(windows: DataFrame, score: str | None = None) -> DataFrame:
    """One row of windows (flag, label[, score]): prf, rates, and of finite scores the median and the 5th and 95th percentile; with ranking."""
    counts = prf(windows).crossJoin(
        windows.agg(F.count("*").alias("n_windows"), F.avg(F.col("label").cast("double")).alias("positive_rate"), F.avg(F.col("flag").cast("double")).alias("flagged_rate"))
    )
    if score is None:
        return counts
    finite = windows.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    q = lambda p: F.percentile(score, F.lit(p))
    spread = finite.agg(q(0.5).alias("score_median"), q(0.05).alias("score_p05"), q(0.95).alias("score_p95"))
    return counts.crossJoin(spread).join(ranking(windows, score), how="left", on=F.lit(True))


def detector_report(points: DataFrame, score: str | None = None) -> DataFrame:
    """One row of a detector's points (stream, pos, flag, label[, score]): prf, adjusted prf, share flagged, anomaly rate, ranking."""
    adjusted = point_adjust(points)
    plain = prf(points).select("precision", "recall", "f1")
    joined = prf(adjusted, flag="adjusted").select(*[F.col(c).alias(f"adj_{c}") for c in ("precision", "recall", "f1")])
    shares = points.agg(F.avg(F.col("flag").cast("double")).alias("flagged"), F.avg(F.col("label").cast("double")).alias("anomaly_rate"))
    out = plain.crossJoin(joined).crossJoin(shares)
    return out if score is None else out.join(ranking(points, score), how="left", on=F.lit(True))
