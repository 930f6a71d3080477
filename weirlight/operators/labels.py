"""Ground truth from run-to-failure horizons and from tables of timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import locate, merge


def event_spans(events: DataFrame) -> DataFrame:
    """(stream, t_from, t_to, ...): from root_cause_start to the later of the cause's end and the extended effect's, if any."""
    end = F.greatest(F.coalesce("extended_effect_end", "root_cause_end"), F.col("root_cause_end"))
    return events.withColumn("t_from", F.col("root_cause_start").cast("double")).withColumn("t_to", end.cast("double"))


def intervals_from_events(points: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged intervals, detail): detail has each event's positions, null where no point falls into it."""
    spans = event_spans(events)
    detail = locate(points, spans)
    return merge(detail.where("lo is not null").select("stream", "lo", "hi")), detail
