"""Streams of equal points, such as windows of copied tables, are one kind: signed and compared once, counted as many.

Nothing is left out: each stream is a member of its kind, statistics count a kind's copies, a
neighbour search has as many of them, by name, as a query can have among its nearest, and results
are given to all members.
"""

from __future__ import annotations

import gc
from collections.abc import Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns that say where a window comes from.
PLACE = ("source", "window", "offset")
#: Kinds whose names are sent to all tasks; more are joined by a shuffle.
SENT = 200_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """df made once, without what it was made of; a second copy of each block outlives an executor. What the driver planned it with goes."""
    out = df.localCheckpoint(storageLevel=StorageLevel.MEMORY_AND_DISK_2)
    released(df.sparkSession)
    return out


def released(spark: SparkSession) -> None:
    """Give the driver's freed memory back to the machine.

    A search plans dozens of jobs, each with new plans and compiled code. What is left of them would stay
    until the heap is at its limit, and what the compilers freed would stay in the C library.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        # By reflection, as the bean's own class is closed to callers.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:  # a Java machine, or a C library, without it
        pass


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, each action's shuffle files go when it ends, rather than when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def kinds(streams: DataFrame, channels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(streams of different points, members): members (stream, kind, and a window's place); the kind is its first stream.

    Points are compared by two 64-bit hashes of all positions, times and values, from different seeds.
    """
    columns = ["t", *channels]
    by = ["stream", *[c for c in PLACE if c in streams.columns]]
    # A hash passes over nulls, so it gets where they are.
    point = F.struct("pos", *[x for c in columns for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    nested = streams.groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("p"))
    hashed = kept(nested.select(*by, *[F.xxhash64(F.lit(seed), "p").alias(f"__h{seed}") for seed in (0, 1)]))
    firsts = hashed.groupBy("__h0", "__h1").agg(F.min("stream").alias("kind"))
    members = kept(hashed.join(firsts, ["__h0", "__h1"]).select(*by, "kind"))
    names = members.where("stream = kind").select("stream")
    names = F.broadcast(names) if names.count() <= SENT else names
    # By number, as little is left where there are many copies, and one task would get all of it.
    width = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return streams.select("stream", "pos", *columns).join(names, "stream", "left_semi").repartition(width, "stream"), members


def apart(streams: DataFrame, channels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The same with each stream as a kind of its own, for what asks streams by name."""
    by = ["stream", *[c for c in PLACE if c in streams.columns]]
    return streams.select("stream", "pos", "t", *channels), streams.select(*by).distinct().withColumn("kind", F.col("stream"))


def name_of(stream: Column | str, lo: Column | str = "lo", hi: Column | str = "hi") -> Column:
    """The name of an interval."""
    return F.concat_ws(":", (F.col(stream) if isinstance(stream, str) else stream).cast("string"), lo, hi)


def dealt(members: DataFrame, k: int) -> DataFrame:
    """Of each kind: copies, folds and counts (how many of its copies are in which fold), names and name_folds.

    members: stream, kind, fold. Names are, in the order of their intervals' names, those that a query
    of some fold, or of none, can have among the k first of other folds.
    """
    at = F.concat(F.col("stream").cast("string"), F.lit(":"))
    few = members.withColumn("__at", at).withColumn("__r", F.row_number().over(Window.partitionBy("kind", "fold").orderBy("__at"))).where(F.col("__r") <= k)
    few = few.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("stream").cast("string").alias("name"), "fold"))).alias("few"))
    counts = members.groupBy("kind", "fold").agg(F.count("*").cast("int").alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("fold", "n"))).alias("own"))
    before = lambda i, f: F.size(F.filter(F.slice("few", 1, i), lambda y: y["fold"] != f))
    # A query of no fold of the kind's sees all before it.
    wanted = F.filter("few", lambda x, i: (i < k) | F.exists("own.fold", lambda f: (f != x["fold"]) & (before(i, f) < k)))
    out = few.join(counts, "kind").withColumn("few", wanted)
    return out.select("kind", F.aggregate("own.n", F.lit(0), lambda a, n: a + n).alias("copies"), F.col("own.fold").alias("folds"), F.col("own.n").alias("counts"), F.col("few.name").alias("names"), F.col("few.fold").alias("name_folds"))


def references(rows: DataFrame, *columns: str, k: int | None = None) -> DataFrame:
    """(ref, fold, columns): a row for each name of a kind's interval, or for its first k; rows: lo, hi, names, name_folds."""
    named = F.arrays_zip("names", "name_folds")
    each = rows.select("lo", "hi", *columns, F.explode(named if k is None else F.slice(named, 1, k)).alias("__x"))
    return each.select(name_of(F.col("__x.names")).alias("ref"), F.col("__x.name_folds").alias("fold"), *columns)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with an id, which is the same again only once they are kept."""
    return rows.withColumn("id", F.monotonically_increasing_id())


def number_of(row: str, place: str) -> Column:
    """A number for a place, under 8,192, of the row with that id, which takes 33 bits in each partition."""
    return F.shiftleft(row, 13) + F.col(place)


def by_fold(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, copies, fold, n, place): a row for each fold of a kind's interval, its place in folds, with the n of its copies that are there."""
    each = rows.select(*columns, "copies", F.posexplode(F.arrays_zip("folds", "counts")).alias("place", "__x"))
    return each.select(*columns, "copies", F.col("__x.folds").alias("fold"), F.col("__x.counts").alias("n"), "place")
