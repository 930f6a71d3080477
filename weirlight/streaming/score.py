"""Scoring of unbounded streams: windows are closed as their points arrive and scored against a fitted detector.

This goes beyond batch scoring, which is the reference for its results. Window w of a stream is of its
points from ``(w - 1) * size`` to ``w * size``, as in batch. State is, for each stream, its points that are not yet
in a closed window and the number of the last closed one. Points may come in any order within the
watermark's delay: windows close in order, each once all its points are there, and points of closed
windows that come again are dropped. A stream that is silent until the watermark has passed its last
point by the delay is at its end: what is left is closed as it is, the last window short.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.calibrate import threshold_at
from ..operators.knn import distances, smallest
from ..operators.metric import Whitening
from ..operators.signature import sign


def closed_windows(points: DataFrame, channels: Sequence[str], size: int, delay: str = "1 hour") -> DataFrame:
    """(stream, window, points) of a streaming table (stream, pos, ts, t, channels): windows of ``size`` steps that share their ends."""
    path = ["t", *channels]
    kind = dict(points.dtypes)["stream"]
    out = f"stream {kind}, window int, points array<array<double>>"
    wait = int(pd.Timedelta(delay).total_seconds() * 1000)

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The state's points are kept as text: state rows take no nested arrays.
        closed, latest, text = state.get if state.exists else (0, 0, "{}")
        held = {int(p): x for p, x in json.loads(text).items()}
        found = []
        if state.hasTimedOut:
            state.remove()
            for w in range(closed + 1 if closed else min(held, default=0) // size + 1, (max(held, default=0) - 1) // size + 2):
                rest = [held[p] for p in range((w - 1) * size, w * size + 1) if p in held]
                if len(rest) > 1:
                    found.append((key[0], w, rest))
        else:
            for batch in batches:
                latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
                for p, x in zip(batch["pos"].tolist(), batch[path].to_numpy(float).tolist(), strict=True):
                    if p >= closed * size:
                        held.setdefault(p, x)
            while held:
                w = closed + 1 if closed else min(held) // size + 1
                span = range((w - 1) * size, w * size + 1)
                if not all(p in held for p in span):
                    break
                found.append((key[0], w, [held[p] for p in span]))
                # The last point of a window is the first of the next.
                closed, held = w, {p: x for p, x in held.items() if p >= w * size}
            state.update((closed, latest, json.dumps(held)))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait + 1)
        yield pd.DataFrame(found, columns=["stream", "window", "points"])

    marked = points.withWatermark("ts", delay)
    return marked.groupBy("stream").applyInPandasWithState(close, out, "closed int, latest long, held string", "append", GroupStateTimeout.EventTimeTimeout)


def score_windows(windows: DataFrame, refs: np.ndarray, metric: Whitening, thresholds: dict[int, float], k: int = 3, depth: int = 2) -> DataFrame:
    """windows with score (of the whole window, at depth 0), threshold and flag; refs are whitened references of depth 0's band."""
    limit = threshold_at(thresholds, 0)
    refs = np.asarray(refs, float)

    kind = dict(windows.dtypes)["stream"]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                paths = np.stack([np.stack([np.asarray(p, float) for p in x]) for x in b["points"]])
                near = smallest(distances(metric.apply(sign(paths, depth)), refs), k)[1]
                yield pd.DataFrame({"stream": b["stream"], "window": b["window"], "score": near[:, -1]})

    # Not a column function: those don't take rows straight from a stateful operator.
    found = windows.mapInPandas(scored, f"stream {kind}, window int, score double")
    return found.withColumn("threshold", F.lit(float(limit))).withColumn("flag", F.col("score") > F.col("threshold"))
