"""Thresholds: per depth, a statistic of distances of corpus intervals to the corpus of other folds."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import copies, knn
from .copies import kept
from .streams import source_of


def statistic(name: str, column: str = "distance") -> Column:
    """max, median, or pNN (a percentile, interpolated linearly)."""
    if name == "max":
        return F.max(column)
    return F.percentile(column, F.lit(quantile(name)))


def quantile(name: str) -> float:
    if name == "max":
        return 1.0
    if name == "median":
        return 0.5
    m = re.fullmatch(r"p(\d+(?:\.\d+)?)", name)
    if not m or not 0 <= float(m[1]) <= 100:
        raise ValueError(f"no statistic {name!r}: max, median or pNN")
    return float(m[1]) / 100


def statistic_of(name: str, values: np.ndarray) -> float:
    return float(np.quantile(values, quantile(name)))


def folds(streams: DataFrame, k: int, windowed: bool = False, seed: int = 0) -> DataFrame:
    """(stream, fold): streams, or the sources of windows, in the order of a seeded hash, dealt in turn to k folds.

    Folds' sizes differ by one at most. Names are ranked within 4,096 parts of the hashes' range, and
    after the parts before theirs.
    """
    name = source_of(F.col("stream").cast("string")) if windowed else F.col("stream").cast("string")
    names = streams.select("stream", name.alias("__name")).distinct()
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "__name"))
    drawn = names.select("__name").distinct().withColumn("__draw", draw).withColumn("__bucket", F.conv(F.substring("__draw", 1, 3), 16, 10).cast("int"))
    sizes = drawn.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = sizes.select("__bucket", (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__draw", "__name")) - 1
    order = drawn.join(before, "__bucket").select("__name", F.pmod(F.col("__before") + place, F.lit(k)).cast("int").alias("fold"))
    return names.join(order, "__name").select("stream", "fold")


def shuffled_folds(names: list[str], k: int, seed: int) -> dict[str, int]:
    """Folds by a seeded shuffle of the sorted names; sizes differ by one at most."""
    unique = sorted(set(names))
    if not 2 <= k <= len(unique):
        raise ValueError(f"{k} folds of {len(unique)} streams")
    order = np.random.default_rng(seed).permutation(len(unique))
    return {unique[i]: f for f, part in enumerate(np.array_split(order, k)) for i in part}


def fold_distances(corpus: DataFrame, k: int = 3, band: int = 1, refs: DataFrame | None = None) -> DataFrame:
    """(query, depth, distance): of each corpus row, the squared distance to its k-th neighbour in other folds within the band.

    corpus: query, depth, fold, z, read several times: persist it. A row with fewer than k such neighbours is an error.
    refs: ref, depth, fold, z, if they are not the corpus.
    """
    corpus = corpus.select("query", "depth", "fold", "z")
    refs = corpus.withColumnRenamed("query", "ref") if refs is None else refs
    found = knn.nearest_blocked(corpus, refs, k, group="depth", fold="fold", band=band)
    ranked = corpus.select("query", "depth").join(found.where(F.col("rank") == k).select("query", "distance"), "query", "left")
    few = F.raise_error(F.concat(F.lit(f"fewer than {k} neighbours in other folds: "), F.col("query").cast("string")))
    return ranked.select("query", F.when(F.col("distance").isNull(), few.cast("double")).otherwise(F.col("distance")).alias("distance"), "depth")


def kind_distances(rows: DataFrame, k: int = 3, band: int = 1) -> DataFrame:
    """(kind, lo, hi, depth, fold, n, distance): fold_distances of intervals of kinds, one row for the n copies in a fold.

    rows: kind, lo, hi, depth, z and the columns of copies.dealt, kept with copies.numbered. A query with k copies in other folds has them at distance 0.
    """
    if "id" not in rows.columns:
        rows = kept(copies.numbered(rows))
    asked = copies.by_fold(rows, "id", "kind", "lo", "hi", "depth", "z")
    alone = F.col("copies") - F.col("n") < k
    sure = asked.where(~alone).select("kind", "lo", "hi", "depth", "fold", "n", F.lit(0.0).alias("distance"))
    open_ = asked.where(alone).withColumn("query", copies.number_of("id", "place"))
    if open_.isEmpty():
        return sure
    found = knn.kth_distances(open_.select("query", "z", "depth", "fold"), copies.references(rows, "depth", "z"), k, group="depth", fold="fold", band=band)
    few = F.raise_error(F.concat(F.lit(f"fewer than {k} neighbours in other folds: "), copies.name_of("kind"), F.lit(":"), F.col("fold").cast("string")))
    ranked = open_.select("query", "kind", "lo", "hi", "depth", "fold", "n").join(found, "query", "left").drop("query")
    return sure.unionByName(ranked.withColumn("distance", F.when(F.col("distance").isNull(), few.cast("double")).otherwise(F.col("distance"))))


def thresholds(distances: DataFrame, name: str = "p95", copies: str | None = None) -> DataFrame:
    """One row per depth, in the layout of the threshold table. The distances are made once and kept for the second pass.

    ``copies``, if given, is the column that says for how many rows each stands.
    """
    distances = kept(distances.select("depth", "distance", (F.col(copies) if copies else F.lit(1)).cast("long").alias("n")))
    q = lambda p: F.percentile("distance", F.lit(p), F.col("n")) if copies else F.percentile("distance", F.lit(p))
    cut = F.max("distance") if name == "max" else q(quantile(name))
    stats = distances.groupBy("depth").agg(
        F.sum("n").alias("n_calibration"), cut.alias("threshold"), q(0.5).alias("median_distance"), q(0.9).alias("p90_distance"), q(0.99).alias("p99_distance"), F.max("distance").alias("max_distance")
    )
    # How many are above is a second pass over the distances, with the few thresholds beside them.
    above = distances.join(F.broadcast(stats.select("depth", "threshold")), "depth").groupBy("depth").agg(F.sum(F.when(F.col("distance") > F.col("threshold"), F.col("n")).otherwise(0)).alias("n_above_threshold"))
    return stats.join(above, "depth").withColumn("relative_width", F.pow(F.lit(2.0), -F.col("depth"))).select(
        "depth", "relative_width", "n_calibration", "threshold", "median_distance", "p90_distance", "p99_distance", "max_distance", "n_above_threshold"
    )


def holdout_thresholds(corpus: DataFrame, share: float, name: str, k: int = 1, band: int = 1) -> DataFrame:
    """Thresholds from the distances of a hash-drawn share of the corpus to all of it but itself."""
    held = knn.stratified(corpus, "query", share)
    refs = knn.banded(corpus.select(F.col("query").alias("ref"), "depth", "z"), band).drop("depth").withColumnRenamed("probe", "depth")
    found = knn.nearest_blocked(held, refs, k, group="depth", skip_self=True)
    return thresholds(found.where(F.col("rank") == k).join(corpus.select("query", "depth"), "query"), name)


def threshold_map(thresholds: float | Mapping[int, float] | DataFrame) -> dict[int, float]:
    """By depth; one number stands for all depths under 0."""
    if isinstance(thresholds, int | float):
        return {0: float(thresholds)}
    if isinstance(thresholds, Mapping):
        return {int(k): float(v) for k, v in thresholds.items()}
    column = next((c for c in ("threshold", "value", "p99", "score") if c in thresholds.columns), None)
    if column is None or "depth" not in thresholds.columns:
        raise ValueError("a threshold table has depth, and threshold, value, p99 or score")
    return {int(r["depth"]): float(r[column]) for r in thresholds.select("depth", column).orderBy("depth").collect()}


def threshold_at(table: Mapping[int, float], depth: float) -> float:
    """The threshold of the nearest depth, the first of two."""
    return table[min(table, key=lambda d: abs(d - depth))]
