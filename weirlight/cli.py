"""Command line: detect anomalies of streams in files, or print the settings.

python -m weirlight.cli detect --corpus GLOB [--test GLOB] --channels a,b [--set key=value] [--out DIR]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import config as settings
from . import session
from .operators import streams
from .plans.detect import assess, detect
from .sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["detect", "settings"])
    parser.add_argument("--corpus", nargs="*", default=[])
    parser.add_argument("--test", nargs="*", default=[])
    parser.add_argument("--channels")
    parser.add_argument("--stream-column")
    parser.add_argument("--time-column")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    c: dict = {}
    for text in args.set:
        c = settings.merged(c, settings.override(text))
    c = settings.check(c)
    if args.command == "settings":
        print(json.dumps(c, indent=2))
        return 0
    spark = session.build()
    raw_names = c["raw"]
    time_name, stream_name = args.time_column or raw_names["time_column"], args.stream_column or raw_names["stream_column"]
    channels = args.channels.split(",") if args.channels else raw_names["channels"]
    sides = []
    for patterns in (args.corpus, args.test) if args.test else (args.corpus,):
        raw = files.read_stream_files(spark, files.expand(spark, patterns), stream_name)
        time = streams.time_column(raw.columns, time_name)
        names = channels or [x for x in raw.columns if x not in ("stream", time, stream_name)]
        if time is None:
            # Rows are in the order of their places in the files, which these numbers follow.
            raw = raw.withColumn("row", F.monotonically_increasing_id())
        sides.append(streams.canonicalise(raw, "stream", [time or "row"], dict(zip(names, names, strict=True)), time))
    found = detect(sides[0], sides[1] if args.test else None, names, c)
    if args.out:
        for name in ("points", "windows", "thresholds", "screened", "point_scores"):
            if name in found:
                found[name].write.mode("overwrite").parquet(f"{args.out}/{name}")
    if "thresholds" in found:
        found["thresholds"].orderBy("depth").show(truncate=False)
    e = c["evaluate"]
    if e["metrics"] and e["labels"]:
        truth = files.read_labels(spark, e["labels"])
        points = found["points"]
        scored = "point_scores" in found
        if scored:
            points = points.join(found["point_scores"], ["stream", "pos"], "left").fillna(0.0, ["point_score"])
        # The metrics go over the points many times.
        points = points.persist()
        print(json.dumps(assess(points, truth, "point_score" if scored or "point_score" in points.columns else None), indent=2, default=float))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
