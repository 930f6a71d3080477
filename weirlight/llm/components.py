"""Connected components of links held as a table, by alternating stars.

Each round, every node first hands its larger neighbours to its smallest one (large star), then its
smaller neighbours (small star). The links end as stars around each component's least node. A round
is a few joins on the node, the links of each dealt to ``SALTS`` tasks; the links are written to
the shared folder after each, so that lineage stays short and nothing of them comes to the driver.

Cases: null ends and links of a node to itself are left out; repeated links count once; an empty table
has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise


#: Tasks that the links of one node are dealt to.
SALTS = 8


def _to_least(links: DataFrame, node: str, other: str, least: DataFrame) -> DataFrame:
    """links with the column m of their node in least (node, m); a node's links are dealt to SALTS tasks."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
    return salted.join(copies, [node, "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _to_least(both.where("v > u"), "u", "v", least).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = _to_least(links, "a", "b", least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(mixed)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of a link; a component is named by its least node. Links to itself are none."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    stars = materialise(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct(), "links")
    before = _digest(stars)
    while before[0]:
        old, stars = stars, materialise(_small_star(_large_star(stars)), "stars")
        discard(stars.sparkSession, old)
        now = _digest(stars)
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
