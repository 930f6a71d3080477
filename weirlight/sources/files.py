"""Reading streams from files by suffix, and writing them."""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.streams import NESTED

DELIMITERS = (",", "\t", r"\s+")
TEXT = (".csv", ".tsv", ".txt", ".dat")


def suffix_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def looks_numeric(fields: list[str]) -> bool:
    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    return bool(fields) and all(number(f) for f in fields)


def sniff(line: str) -> tuple[str, bool]:
    """(delimiter, header): the delimiter that cuts the first line into most fields; a header is a line that isn't all numbers."""
    best = max(DELIMITERS, key=lambda d: len(re.split(d, line.strip())))
    return best, not looks_numeric([f.strip() for f in re.split(best, line.strip()) if f.strip()])


def read_text(spark: SparkSession, path: str | list[str], stem: str | None = None) -> DataFrame:
    """Delimited text; columns without a header are named 0, 1, ...; columns without any value are dropped.

    Several files are of one form, that of the first; ``stem`` names a column for each row's file name without suffix.
    """
    named = lambda df: df if stem is None else df.select("*", stem_column().alias(stem))
    paths = [path] if isinstance(path, str) else path
    first = spark.read.text(paths[0]).where(F.trim("value") != "").select("value").first()
    if first is None:
        raise ValueError(f"{paths[0]} is empty")
    delimiter, header = sniff(first["value"])
    if delimiter != r"\s+":
        raw = spark.read.csv(paths, sep=delimiter, header=header, inferSchema=True)
        own = raw.columns if header else [str(i) for i in range(len(raw.columns))]
        df = named(raw).toDF(*own, *([] if stem is None else [stem]))
    else:
        names = re.split(r"\s+", first["value"].strip())
        rows = named(spark.read.text(paths)).where(F.trim("value") != "")
        rows = rows.where(F.col("value") != first["value"]) if header else rows
        parts = F.split(F.trim("value"), r"\s+")
        df = rows.select(parts.alias("p"), *([] if stem is None else [stem])).select(*[F.get("p", F.lit(i)).try_cast("double").alias(n if header else str(i)) for i, n in enumerate(names)], *([] if stem is None else [stem]))
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if filled[c]])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: parquet, pq, csv, tsv, txt, dat; a folder without one is parquet."""
    suffix = suffix_of(path)
    if suffix in (".parquet", ".pq", ""):
        return spark.read.parquet(path)
    if suffix in TEXT:
        return read_text(spark, path)
    raise ValueError(f"no reader for {suffix!r}")


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that the patterns name, in order; an error if there are none. Works in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found: list[str] = []
    for pattern in patterns:
        path = hadoop.Path(pattern)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        found += sorted(s.getPath().toString() for s in status)
    if not found:
        raise FileNotFoundError(f"nothing matches {patterns}")
    return found


def stem_column():
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_stream_files(spark: SparkSession, paths: list[str], stream_column: str | None = None, equal_lengths: bool = False) -> DataFrame:
    """Files of one schema as one table with ``stream``: the file's name, with ``__<key>`` for each stream within it.

    Files of a suffix are one scan; a folder is a table by itself. With ``equal_lengths`` streams of
    different numbers of rows are an error.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    scans: dict[str, list[str]] = {}
    for path in paths:
        place = hadoop.Path(path)
        folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
        scans.setdefault(path if folder else suffix_of(path), []).append(path)
    parts = None
    for kind, own in scans.items():
        if own == [kind]:
            df = read(spark, kind).withColumn("__stem", F.lit(PurePosixPath(urlparse(kind).path).stem))
        elif kind in (".parquet", ".pq"):
            df = spark.read.parquet(*own).select("*", stem_column().alias("__stem"))
        elif kind in TEXT:
            df = read_text(spark, own, "__stem")
        else:
            raise ValueError(f"no reader for {kind!r}")
        parts = df if parts is None else parts.unionByName(df)
    name = F.col("__stem") if stream_column is None else F.concat_ws("__", "__stem", F.col(stream_column).cast("string"))
    out = parts.withColumn("stream", name).drop("__stem")
    if equal_lengths:
        counts = out.groupBy("stream").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
        if counts["least"] != counts["most"]:
            raise ValueError(f"streams have from {counts['least']} to {counts['most']} rows")
    return out


def is_canonical(df: DataFrame) -> bool:
    return {f.name for f in NESTED.fields} <= set(df.columns)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """A nested stream set; its columns are checked."""
    df = spark.read.parquet(path)
    if not is_canonical(df):
        raise ValueError(f"{path} has {df.columns}, not {[f.name for f in NESTED.fields]}")
    return df


def write_canonical(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").parquet(path)


def write_streams(streams: DataFrame, path: str) -> None:
    """One folder for each stream; what an earlier run left is replaced. Rows are dealt by stream and a hash, so a long stream is several files."""
    spread = F.pmod(F.xxhash64("pos"), F.lit(8))
    streams.repartition(int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream", spread).write.mode("overwrite").partitionBy("stream").parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Parquet, or csv with one column for each term, by suffix."""
    if suffix_of(path) == ".csv":
        n = corpus.select(F.size("sig").alias("n")).first()["n"]
        own = [c for c in corpus.columns if c != "sig"]
        corpus.select(*own, *[F.get("sig", F.lit(i)).alias(f"sig_{i}") for i in range(n)]).write.mode("overwrite").csv(path, header=True)
    else:
        corpus.write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus with ``sig``; term columns must be sig_0, sig_1, ... in order."""
    df = spark.read.csv(path, header=True, inferSchema=True) if suffix_of(path) == ".csv" else spark.read.parquet(path)
    if "sig" in df.columns:
        return df
    names = [c for c in df.columns if c.startswith("sig_")]
    if names != [f"sig_{i}" for i in range(len(names))]:
        raise ValueError("term columns are out of order")
    return df.select(*[c for c in df.columns if c not in names], F.array(*[F.col(c).cast("double") for c in names]).alias("sig"))


def names_for_urls(urls: list[str]) -> dict[str, str]:
    """A file name for each url: its last part; those that collide get a number before the suffix."""
    taken: dict[str, int] = {}
    out = {}
    for url in urls:
        name = PurePosixPath(urlparse(url).path).name or "download"
        n = taken.get(name, 0)
        taken[name] = n + 1
        stem, suffix = PurePosixPath(name).stem, PurePosixPath(name).suffix
        out[url] = name if not n else f"{stem}_{n}{suffix}"
    return out


def read_timeeval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(values, labels) of a benchmark csv: the channels without timestamp and is_anomaly, and pos with label."""
    from pyspark.sql.window import Window

    df = spark.read.csv(path, header=True, inferSchema=True).withColumn("pos", F.row_number().over(Window.orderBy("timestamp")) - 1)
    channels = [c for c in df.columns if c not in ("timestamp", "is_anomaly", "pos")]
    return df.select("pos", *channels), df.select("pos", (F.col("is_anomaly") != 0).alias("label"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Timed events of traces, as labels.event_spans wants them."""
    return spark.read.csv(path, header=True, inferSchema=True).withColumnRenamed("trace_name", "stream")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Truth as one row for each point (stream, pos, label), or for each interval (stream, lo, hi), by what the file holds.

    A file has ``label`` of each point, or as an array for each stream, or ``anomalous``, an array of [lo, hi].
    """
    df = spark.read.csv(path, header=True, inferSchema=True) if suffix_of(path) == ".csv" else spark.read.parquet(path)
    kind = dict(df.dtypes)
    if kind.get("label", "").startswith("array"):
        return df.select("stream", F.posexplode("label").alias("pos", "label")).withColumn("label", F.col("label") != 0)
    if "label" in kind:
        return df.select("stream", "pos", (F.col("label").cast("int") != 0).alias("label"))
    if "anomalous" in kind:
        return df.select("stream", F.explode("anomalous").alias("a")).select("stream", F.col("a")[0].alias("lo"), F.col("a")[1].alias("hi"))
    if {"lo", "hi"} <= set(kind):
        return df.select("stream", "lo", "hi")
    raise ValueError(f"{path} has neither label, anomalous, nor lo and hi: {df.columns}")
