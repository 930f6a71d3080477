"""Shared-folder tables and distributed ordering helpers of the text operators."""

from __future__ import annotations

import math
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own_dir: str | None = None

#: Code points that separate words everywhere in this package: space and U+0009 to U+000D.
WORD_SPACE = "\t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or an own one where that is unset and one machine does all."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = f"file://{tempfile.mkdtemp(prefix='weirlight-')}"
    return _own_dir


_scopes = threading.local()


@contextmanager
def working_tables():
    """A list that gets the paths of the tables that materialise writes within, in this thread."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append(mine := [])
    try:
        yield mine
    finally:
        stack.pop()
        if stack:
            stack[-1].extend(mine)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weirlight/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for mine in _scopes.__dict__.get("stack", [])[-1:]:
        mine.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.weirlight_path = path
    return table


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete materialised tables that nothing reads any more; other tables are left alone."""
    ours = f"{shared_dir(spark)}/weirlight/"
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "weirlight_path", None)
        if path and path.startswith(ours):
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower Spark's rows per Arrow batch, so that long texts do not pile up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give a Python worker's freed memory back to the machine, where its libraries can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once (a lambda variable stands for it)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array: maximal runs without space and U+0009 to U+000D; null gives none."""
    flat = F.translate(F.coalesce(text, F.lit("")), WORD_SPACE, " " * len(WORD_SPACE))
    return F.array_remove(F.split(flat, " "), "")


def _rank(sorted_values: list[int], value: Column, strict: bool) -> Column:
    """How many of the sorted values are below value (strict) or at most value, in two short scans."""
    n = len(sorted_values)
    if not n:
        return F.lit(0)
    step = max(1, math.isqrt(n))
    below = (lambda x: x < value) if strict else (lambda x: x <= value)
    array = lambda xs: F.lit(xs)
    heads, whole = array(sorted_values[::step]), array(sorted_values)
    head = F.size(F.filter(heads, below))
    fine = F.size(F.filter(F.slice(whole, (head - 1) * step + 1, F.lit(step)), below))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * step + fine)


#: Buckets at most, of rows with a key and again of rows without one.
MOST_BUCKETS = 40_000


def range_buckets(df: DataFrame, key: str, tie: Column, rows_per_bucket: int = 4_000) -> tuple[Column, int]:
    """(a bucket number that rises with (key, tie), how many buckets there are); null keys come first, below 0.

    Bounds are percentiles of the long column ``key`` (one row of at most MOST_BUCKETS numbers comes to
    the driver). A key that repeats over several bounds, and null keys, are divided by their tie, a
    64-bit hash. Only rows equal in key and tie, which are in no order, always share a bucket.
    """
    sizes = df.agg(F.count("*").alias("n"), F.count(key).alias("with_key")).first()
    parts = max(1, min(MOST_BUCKETS, math.ceil(sizes["with_key"] / rows_per_bucket)))
    nulls = min(MOST_BUCKETS, math.ceil((sizes["n"] - sizes["with_key"]) / rows_per_bucket))
    cuts: list[int] = []
    if parts > 1:
        probs = [i / parts for i in range(1, parts)]
        row = df.agg(F.percentile_approx(key, probs, max(10_000, 4 * parts)).alias("p")).first()
        cuts = sorted(int(x) for x in (row["p"] or []))
    share = (F.shiftrightunsigned(tie, 11).cast("double")) / F.lit(float(2**53))
    low = _rank(cuts, F.col(key), True)
    high = _rank(cuts, F.col(key), False) if len(set(cuts)) < len(cuts) else low
    # The tie is signed, so its order as a number is that of its unsigned value with the top bit turned.
    turned = F.when(share >= 0.5, share - 0.5).otherwise(share + 0.5)
    split = low + F.floor(turned * (high - low)).cast("int") if high is not low else low
    return F.when(F.col(key).isNull(), F.floor(turned * nulls).cast("int") - nulls).otherwise(split), parts + nulls


def with_next(df: DataFrame, key: str, tie: str, columns: list[str], rows_per_bucket: int = 4_000) -> DataFrame:
    """Add ``next_<column>``: the values of the row that follows in descending (key, tie), in a ring.

    Rows are dealt to range buckets and sorted there. The first row of each bucket is copied into
    the bucket before it, so no bucket needs another. Only the buckets' first keys, at most 40,000
    rows of numbers, come to the driver.
    """
    spark = df.sparkSession
    dealt = df.withColumn("__bucket", range_buckets(df, key, F.col(tie), rows_per_bucket)[0])
    firsts = dealt.groupBy("__bucket").agg(F.max(F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))).alias("h")).collect()
    firsts.sort(key=lambda r: -r["__bucket"])
    # The row after the end of bucket i is the first of bucket i + 1; after the last bucket, of the first.
    ghosts = [(r["__bucket"], r["h"]["k"], r["h"]["t"], firsts[i - 1]["__bucket"]) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(ghosts, "__bucket int, __k long, __t long, __to int")
    at = (dealt["__bucket"] == heads["__bucket"]) & dealt[key].eqNullSafe(heads["__k"]) & dealt[tie].eqNullSafe(heads["__t"])
    placed = dealt.join(F.broadcast(heads), at, "left").drop(heads["__bucket"]).drop("__k", "__t")
    here = F.struct(F.col("__bucket").alias("at"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("__to").alias("at"), F.lit(True).alias("ghost"))
    placed = placed.withColumn("__place", F.explode(F.when(F.col("__to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    placed = placed.withColumn("__at", F.col("__place.at")).withColumn("__ghost", F.col("__place.ghost"))
    w = Window.partitionBy("__at").orderBy(F.col("__ghost"), F.col(key).desc_nulls_last(), F.col(tie).desc())
    for c in columns:
        placed = placed.withColumn(f"next_{c}", F.lead(c).over(w))
    return placed.where(~F.col("__ghost")).drop("__bucket", "__to", "__place", "__at", "__ghost")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
