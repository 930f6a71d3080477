"""Normalisers of signature terms: a centre and a scale for each, as one row of arrays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import affine
from .signature import term_levels, terms, truncation_of

METHODS = ("zscore", "scale", "maxabs", "factorial")


def fit(sigs: DataFrame, method: str, width: int | None = None, copies: str | None = None) -> DataFrame:
    """(method, centre, scale). factorial multiplies level d by d! and needs the width of the path, not the data.

    Deviations are of the population; a term without spread keeps its scale. ``copies`` is the column
    that says for how many rows each stands.
    """
    spark = sigs.sparkSession
    if method not in METHODS:
        raise ValueError(f"no normaliser {method!r}: {METHODS}")
    if method == "factorial":
        if width is None:
            raise ValueError("factorial needs the width of the path")
        first = sigs.select(F.size("sig").alias("n")).first()
        levels = term_levels(width, truncation_of(width, first["n"])) if first else []
        return spark.createDataFrame([(method, [0.0] * len(levels), [1 / math.factorial(k) for k in levels])], "method string, centre array<double>, scale array<double>")
    one = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    zero = F.lit(0.0)
    mean, spread, rows = F.avg("value"), F.stddev_pop("value"), terms(sigs.select("sig", *([F.col(copies).alias("__n")] if copies else [])))
    if copies:
        means = rows.groupBy("term").agg((F.sum(F.col("value") * F.col("__n")) / F.sum("__n")).alias("__mean"))
        rows = rows.join(F.broadcast(means), "term")
        gap = F.col("value") - F.col("__mean")
        mean, spread = F.first("__mean"), F.sqrt(F.sum(gap * gap * F.col("__n")) / F.sum("__n"))
    centre, scale = {"zscore": (mean, one(spread)), "scale": (zero, one(spread)), "maxabs": (zero, one(F.max(F.abs("value"))))}[method]
    by_term = rows.groupBy("term").agg(centre.alias("c"), scale.alias("s"))
    ordered = by_term.agg(F.array_sort(F.collect_list(F.struct("term", "c", "s"))).alias("p"))
    return ordered.select(F.lit(method).alias("method"), F.col("p.c").alias("centre"), F.col("p.s").alias("scale"))


def apply(sigs: DataFrame, normaliser: DataFrame) -> DataFrame:
    """sigs with normalised terms; the normaliser is one row of two arrays, so it is broadcast."""
    row = F.broadcast(normaliser.select(F.col("centre").alias("__c"), F.col("scale").alias("__s")))
    return sigs.crossJoin(row).withColumn("sig", affine(F.col("sig"), F.col("__c"), F.col("__s"))).drop("__c", "__s")


def invert(sigs: DataFrame, normaliser: DataFrame) -> DataFrame:
    row = F.broadcast(normaliser.select(F.col("centre").alias("__c"), F.col("scale").alias("__s")))
    scaled = F.zip_with("sig", "__s", lambda v, s: v * s)
    return sigs.crossJoin(row).withColumn("sig", F.zip_with(scaled, "__c", lambda v, c: v + c)).drop("__c", "__s")
