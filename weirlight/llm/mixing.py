"""Mixing sources to target weights.

Sources in code-point order, null last, get the weights in turn. Their targets share ``share`` of all
sizes by weight, none above ``cap`` times its source's size; what a full source cannot take goes to
the others by weight. Each document gets a hash-random key. Within its source, the documents are
range-sorted by key: the keys are uniform, so buckets are equal parts of the key range, as many as the
source's rows need, and a hot source is spread over many tasks. Prefix sums of the buckets' totals
give each bucket its offset, and a running sum within the bucket each document's. A source's target
is then so many whole epochs of it, and in the last epoch the documents whose running sum is within
the rest; the document at the cut is taken in part, so the taken words meet the target exactly.

Cases: null and empty texts have size 0 and take nothing. Null doc_ids have a key of their own, in which
they are in the order of size; they are dealt by size and a hash of the text. Rows that repeat are documents of their own; which of two equal rows comes first has no effect. Sources of
size 0 have target 0. An empty table gives no rows. Only the named columns are read. Targets are made
from one row of numbers for each source, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialise

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(no_source, src, n, source_size, target): one row per source.

    A source is full if the level at which all sources up to it (by cap over weight) are full and the
    others stand at the same share of their weights is enough for it. The rest stand at the level
    that spends what the full ones leave: that of the first of them, the highest, as the levels after it
    count ones as full that are not.
    """
    by_source = sizes.groupBy("no_source", "src").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy("no_source", "src")) - 1, F.lit(len(weights)))
    weighed = by_source.withColumn("weight", F.element_at(F.lit(list(weights)), (turn + 1).cast("int")).cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "no_source", "src")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("full_before")) / F.col("weight_from")
    return (
        weighed.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(before) * F.lit(int(cap)), F.lit(0)).cast("double"))
        .withColumn("weight_from", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("limit", (F.col("source_size") * F.lit(int(cap))).cast("double"))
        .withColumn("is_full", F.col("limit") <= level * F.col("weight"))
        .withColumn("rest_level", F.max(F.when(~F.col("is_full"), level)).over(everything))
        .withColumn("target", F.when(F.col("is_full"), F.col("limit")).otherwise(F.col("rest_level") * F.col("weight")))
        .select("no_source", "src", "n", "source_size", "target")
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    cap: int = 2,
    rows_per_bucket: int = 1_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row of docs, and the columns to keep as the struct ``kept``.
 The sizes are counted once and kept as a table in
    the shared folder, of which the sums and the sort read three times.
    """
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(source_col, F.lit("")).alias("src"),
        text_size(F.col(text_col)).alias("size"),
        key.alias("key"),
        F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text_col), F.lit(8))).otherwise(F.lit(0)).alias("salt"),
        *([F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []),
    )
    sized = materialise(sized, "mix-sizes")
    targets = materialise(source_targets(sized, weights, share, cap), "mix-targets")

    # Keys are uniform: the first 32 bits times the number of buckets is an even deal.
    share_of_range = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    # About as many buckets as rows in each, so neither the sort nor the sums over buckets grow large.
    bucket = F.floor(share_of_range * F.ceil(F.col("n") / F.greatest(F.lit(float(rows_per_bucket)), F.sqrt("n")))).cast("long")
    source = ["no_source", "src"]
    # Null ids share one key; rows equal in key, id and size are in any order.
    place = ["bucket", "part", "salt"]
    dealt = sized.join(targets, source).withColumn("bucket", bucket).withColumn("part", F.when(F.col("id").isNull(), F.col("size")).otherwise(F.lit(0)))
    totals = dealt.groupBy(*source, *place).agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy(*source).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*source, *place, F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*source, *place).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    return (
        dealt.join(offsets, [*source, *place])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("before"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("left", "size")))
        .select(
            F.col("id").alias(id_col),
            F.when(~F.col("no_source"), F.col("src")).alias(source_col),
            "size",
            "source_size",
            "target",
            F.col("taken").cast("long").alias("taken"),
            *(["kept"] if keep else []),
        )
    )


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
by_source AS (
  SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY no_source, src) - 1) % 3] AS DOUBLE) AS weight FROM by_source),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total,
         CAST(coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS DOUBLE) AS full_before,
         sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM weighed WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / weight, no_source, src)),
levels AS (
  SELECT *, (total - full_before) / weight_from AS level, CAST(source_size * 2 AS DOUBLE) AS max_target FROM filled),
targets AS (
  SELECT no_source, src, source_size,
         CASE WHEN max_target <= level * weight THEN max_target
              ELSE max(CASE WHEN NOT max_target <= level * weight THEN level END) OVER () * weight END AS target
  FROM levels),
summed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.no_source, s.src ORDER BY s.key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t USING (no_source, src))
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(floor(target) - epochs * source_size - before, size)) AS BIGINT) AS taken
FROM summed
"""
