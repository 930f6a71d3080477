"""Reports, throughput tables and timings; only a few rows of results come to the driver."""

from __future__ import annotations

import html
import json
import threading
import time
from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flatten(values: dict, prefix: str = "") -> dict:
    """Nested dictionaries as one, with dotted keys."""
    out: dict = {}
    for k, v in values.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def _cell(v) -> str:
    return html.escape(f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v))


def table(df: DataFrame, limit: int = 50) -> str:
    """The first rows as an HTML table, and how many more there are."""
    rows = df.limit(limit + 1).collect()
    head = "".join(f"<th>{_cell(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows[:limit])
    more = "<p>more rows follow</p>" if len(rows) > limit else ""
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{more}"


def build(title: str, parts: Iterable[tuple[str, dict | DataFrame | str]]) -> str:
    """One self-contained page of summaries and tables."""
    sections = []
    for name, part in parts:
        if isinstance(part, dict):
            rows = "".join(f"<tr><th>{_cell(k)}</th><td>{_cell(v)}</td></tr>" for k, v in flatten(part).items())
            text = f"<table>{rows}</table>"
        else:
            text = table(part) if isinstance(part, DataFrame) else f"<p>{_cell(part)}</p>"
        sections.append(f"<h2>{_cell(name)}</h2>{text}")
    return f"<!doctype html><meta charset='utf-8'><title>{_cell(title)}</title><h1>{_cell(title)}</h1>{''.join(sections)}"


def throughput(jobs: DataFrame, counts: dict[str, float]) -> DataFrame:
    """One row: total seconds and largest memory of job rows (s, max_rss; '-' is missing), and rates of counts a second."""
    number = lambda c: F.try_to_number(F.nullif(F.col(c).cast("string"), F.lit("-")), F.lit("999999999999.999999")).cast("double")
    agg = jobs.agg(F.sum(number("s")).alias("seconds"), F.max(number("max_rss")).alias("max_rss"), F.count("*").alias("jobs"))
    return agg.select("*", *[F.lit(float(v)).alias(k) for k, v in counts.items()], *[F.try_divide(F.lit(float(v)), F.col("seconds")).alias(f"{k}_per_second") for k, v in counts.items()])


class Recorder:
    """Nested stages with their own time, without that of stages inside them, and the driver's peak memory."""

    def __init__(self):
        self.rows: list[dict] = []
        self._open: list[dict] = []

    @contextmanager
    def stage(self, name: str):
        row = {"stage": name, "start": time.perf_counter(), "inner": 0.0, "level": len(self._open)}
        self._open.append(row)
        try:
            yield row
        finally:
            self._open.pop()
            row["seconds"] = time.perf_counter() - row.pop("start")
            row["exclusive"] = row["seconds"] - row.pop("inner")
            if self._open:
                self._open[-1]["inner"] += row["seconds"]
            self.rows.append(row)


class MemorySampler(threading.Thread):
    """The largest resident size of this process while it runs, in MB."""

    def __init__(self, every: float = 0.05):
        super().__init__(daemon=True)
        self.every, self.peak, self._end = every, 0.0, threading.Event()

    def run(self) -> None:
        while not self._end.wait(self.every):
            pages = int(Path("/proc/self/statm").read_text().split()[1])
            self.peak = max(self.peak, pages * 4096 / 1e6)

    def stop(self) -> float:
        self._end.set()
        self.join()
        return self.peak


def breakdown(stages: DataFrame, by: str = "experiment") -> DataFrame:
    """Seconds of each stage of an experiment and their share of it."""
    sums = stages.groupBy(by, "stage").agg(F.sum("exclusive").alias("seconds"))
    return sums.withColumn("share", F.try_divide(F.col("seconds"), F.sum("seconds").over(Window.partitionBy(by))))


def compare(paths: dict[str, str], newest_input: float | None = None) -> list[dict]:
    """Flattened JSON summaries side by side; runs older than the newest input are stale."""
    out = []
    for name, path in paths.items():
        p = Path(path)
        if p.exists():
            out.append({"run": name, "stale": newest_input is not None and p.stat().st_mtime < newest_input} | flatten(json.loads(p.read_text())))
    return out
