"""Queries over the driver's tables, one for each operator, with the SQL that states the same.

Events are the main streams: one for each user, in order of time and id, with the event's value and the
number in its properties as channels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bagging, calibrate, copies, evaluate, interval_model, knn, labels, metric, normalise, reduce, report, scoring, signature, streams, transforms, windows
from .detect import detect

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CHANNELS = ["x1", "x2"]

CANON = """canon AS (
  SELECT user_id AS stream, CAST(row_number() OVER w - 1 AS INTEGER) AS pos,
         (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS t, value AS x1,
         CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS DOUBLE) AS x2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sizes AS (SELECT stream, CAST(count(*) AS INTEGER) AS n FROM canon GROUP BY stream)"""
BOUNDS = """bounds AS (
  SELECT stream, n, lo // 16 + 1 AS w, lo, least(lo + 16, n - 1) AS hi
  FROM (SELECT stream, n, CAST(unnest(range(0, n - 1, 16)) AS INTEGER) AS lo FROM sizes WHERE n >= 2))"""
CUT = """cut AS (
  SELECT b.stream || '_' || b.w AS stream, CAST(c.pos - b.lo AS INTEGER) AS pos, c.t, c.x1, c.x2, b.stream AS source, CAST(b.w AS INTEGER) AS win, b.lo AS off, hi - lo + 1 AS points
  FROM bounds b JOIN canon c ON c.stream = b.stream AND c.pos BETWEEN b.lo AND b.hi)"""
FLAGS = "flags AS (SELECT stream, pos, x1, x2, pos >= n - 21 AS label, x1 > 90 AS flag FROM canon JOIN sizes USING (stream))"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can state it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return streams.canonicalise(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], {"x1": "value", "x2": k}, "ts")


def cut(spark: SparkSession, sf_dir: str, min_points: int = 2) -> DataFrame:
    return windows.cut_windows(events(spark, sf_dir), 16, min_points)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, pos, channels, label (one of the last 21 points), flag (a value over 90)."""
    return evaluate.labels_to_failure(events(spark, sf_dir), 20).withColumn("flag", F.col("x1") > 90).drop("t")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Streams


@query(f"WITH {CANON} SELECT stream, pos, round(t, 3) AS t, x1, x2 FROM canon")
def canonical_streams(spark, d):
    return rounded(events(spark, d), 3, "t")


@query(f"""WITH {CANON} SELECT stream, count(*) AS length, CAST(2 AS BIGINT) AS channels, round(min(t), 3) AS t_start, round(max(t), 3) AS t_end, true AS finite FROM canon GROUP BY stream""")
def stream_summary(spark, d):
    return rounded(streams.summarise(events(spark, d), CHANNELS), 3, "t_start", "t_end")


LINES = """lines AS (
  SELECT l_suppkey AS stream, CAST(row_number() OVER w - 1 AS INTEGER) AS pos,
         (epoch_us(l_shipdate) - first_value(epoch_us(l_shipdate)) OVER w) / 1e6 AS t, l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return streams.canonicalise(table(spark, d, "lineitem"), "l_suppkey", order, {"quantity": "l_quantity", "price": "l_extendedprice"}, "l_shipdate")


@query(f"WITH {LINES} SELECT stream, pos, t, quantity, price FROM lines")
def elapsed_time(spark, d):
    return lines(spark, d)


@query(f"""WITH {CANON}, nested AS (SELECT stream, list(t ORDER BY pos) AS ts, list(x1 ORDER BY pos) AS a FROM canon GROUP BY stream)
SELECT CAST(stream AS VARCHAR) AS stream, len(ts) AS points, round(list_sum(a), 4) AS total, round(ts[len(ts)], 3) AS t_end, a[1] AS first_value FROM nested""")
def nested_streams(spark, d):
    rows = streams.nest(events(spark, d), CHANNELS)
    total = F.aggregate("Points", F.lit(0.0), lambda a, x: a + x[0])
    return rows.select("stream", F.size("Time").cast("long").alias("points"), F.round(total, 4).alias("total"), F.round(F.element_at("Time", -1), 3).alias("t_end"), F.get(F.get("Points", F.lit(0)), F.lit(0)).alias("first_value"))


def holed(spark, d):
    e = events(spark, d)
    x1 = F.when(F.pmod(F.col("stream") * 7 + F.col("pos"), F.lit(211)) == 0, F.lit(None)).otherwise(F.col("x1"))
    x2 = F.when(F.pmod(F.col("stream") * 5 + F.col("pos"), F.lit(307)) == 0, F.lit(float("inf"))).otherwise(F.col("x2"))
    return e.withColumns({"x1": x1, "x2": x2})


HOLED = CANON + """, holed AS (
  SELECT stream, pos, (stream * 7 + pos) % 211 = 0 AS no1, (stream * 5 + pos) % 307 = 0 AS no2, x1 FROM canon)"""


@query(f"""WITH {HOLED} SELECT stream, CAST(sum(no1::INT) AS BIGINT) AS n_nan, CAST(sum(no2::INT) AS BIGINT) AS n_inf, CAST(sum((no1 OR no2)::INT) AS BIGINT) AS rows,
 min(CASE WHEN no1 OR no2 THEN pos END) AS first_row,
 CASE WHEN bool_or(no1) AND bool_or(no2) THEN 'x1,x2' WHEN bool_or(no1) THEN 'x1' ELSE 'x2' END AS columns,
 CASE WHEN NOT bool_or(no2) THEN 'nan' WHEN NOT bool_or(no1) THEN 'inf' ELSE 'nan,inf' END AS reason
 FROM holed GROUP BY stream HAVING bool_or(no1 OR no2)""")
def screen_nonfinite(spark, d):
    return streams.screen(holed(spark, d), CHANNELS)[1]


@query(f"""WITH {HOLED} SELECT stream, count(*) AS points, round(sum(x1), 4) AS total FROM holed WHERE stream NOT IN (SELECT stream FROM holed WHERE no1 OR no2) GROUP BY stream""")
def screened_streams(spark, d):
    return streams.screen(holed(spark, d), CHANNELS)[0].groupBy("stream").agg(F.count("*").alias("points"), F.round(F.sum("x1"), 4).alias("total"))


@query(f"""WITH {CANON}, cuts AS (SELECT stream, least(n - 1, greatest(1, round_even(0.572 * n, 0))) AS c FROM sizes)
SELECT stream || CASE WHEN pos < c THEN '_a' ELSE '_b' END AS stream, CAST(CASE WHEN pos < c THEN pos ELSE pos - c END AS INTEGER) AS pos, x1 FROM canon JOIN cuts USING (stream)""")
def cut_in_time(spark, d):
    return streams.cut_in_time(events(spark, d), 0.572).select("stream", "pos", "x1")


@query("""SELECT n AS name, CASE WHEN regexp_replace(n, '_[0-9]+$', '') = '' THEN n ELSE regexp_replace(n, '_[0-9]+$', '') END AS source,
 CASE WHEN split_part(n, '_', 2) = '0' THEN 'corpus' ELSE 'test' END AS side
FROM (SELECT DISTINCT event_type || '_' || (user_id % 3) || '_' || (user_id % 7) AS n FROM events UNION SELECT '_' || (user_id % 5) FROM events)""")
def stream_names(spark, d):
    e = table(spark, d, "events")
    n = e.select(F.concat_ws("_", "event_type", F.col("user_id") % 3, F.col("user_id") % 7).alias("name")).union(e.select(F.concat(F.lit("_"), F.col("user_id") % 5))).distinct()
    return n.select("name", streams.source_of(F.col("name")).alias("source"), streams.side_of(F.col("name")).alias("side"))


@query(f"""WITH {CANON} SELECT 'x1' AS channel, round(stddev_pop(x1), 4) AS std, round(corr(x1, pos), 4) AS corr FROM canon UNION ALL SELECT 'x2', round(stddev_pop(x2), 4), round(corr(x2, pos), 4) FROM canon""")
def channel_spread(spark, d):
    return rounded(streams.channel_spread(events(spark, d), CHANNELS, "pos"), 4, "std", "corr")


@query(f"""WITH {CANON}, m AS (SELECT 'x1' AS channel, stddev_pop(x1) AS std FROM canon UNION ALL SELECT 'x2', stddev_pop(x2) FROM canon)
SELECT channel, round(std, 4) AS std FROM m ORDER BY m.std DESC, channel LIMIT 1""")
def top_channels(spark, d):
    return rounded(streams.top_channels(events(spark, d), CHANNELS, 1), 4, "std").select("channel", "std")


@query(f"WITH {CANON} SELECT stream, pos, x1, n - 1 - pos AS rul, n - 1 - pos <= 15 AS degraded, n - 1 - pos > 30 AS healthy FROM canon JOIN sizes USING (stream)")
def remaining_life(spark, d):
    return streams.remaining_life(events(spark, d), 15).drop("t", "x2")


@query(f"WITH {HOLED} SELECT stream, pos, CASE WHEN no1 THEN 0 ELSE x1 END AS x1 FROM holed WHERE pos % 4 = 0")
def strided_scan(spark, d):
    return streams.strided(holed(spark, d).select("stream", "pos", "x1"), 4, ["x1"])


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY user_id""")
def pivoted_counts(spark, d):
    names = ["click", "error", "purchase"]
    e = table(spark, d, "events").where(F.col("event_type").isin(names))
    return e.groupBy("user_id").pivot("event_type", names).count().fillna(0)


# Transforms


@query(f"""WITH {CANON} SELECT stream, pos, x1, x2, coalesce(lag(x1, 2) OVER w, first_value(x1) OVER w) AS x1_lag2, coalesce(lag(x2, 2) OVER w, first_value(x2) OVER w) AS x2_lag2 FROM canon WINDOW w AS (PARTITION BY stream ORDER BY pos)""")
def delay_columns(spark, d):
    return transforms.delay(events(spark, d), CHANNELS, 2).drop("t")


LEADLAG = """steps AS (SELECT stream, n, CAST(unnest(range(0, 2 * n - 1)) AS INTEGER) AS j FROM sizes),
leadlag AS (SELECT s.stream, s.j AS pos, a.x1, a.x2, b.x1 AS x1_lag, b.x2 AS x2_lag FROM steps s
  JOIN canon a ON a.stream = s.stream AND a.pos = (s.j + 1) // 2 JOIN canon b ON b.stream = s.stream AND b.pos = s.j // 2)"""


@query(f"WITH {CANON}, {LEADLAG} SELECT * FROM leadlag")
def lead_lag(spark, d):
    return transforms.lead_lag(events(spark, d), CHANNELS).drop("t")


@query(f"WITH {CANON}, {LEADLAG} SELECT stream, CAST((pos + 1) // 2 AS INTEGER) AS pos, bool_or(x1 - x1_lag > 40) AS flag FROM leadlag GROUP BY 1, 2")
def collapse_lead_lag(spark, d):
    return transforms.collapse_lead_lag(transforms.lead_lag(events(spark, d), CHANNELS).withColumn("flag", F.col("x1") - F.col("x1_lag") > 40))


@query(f"""WITH {CANON}, wide AS (SELECT stream, pos, x1 AS x1_0, coalesce(lag(x1, 1) OVER w, first_value(x1) OVER w) AS x1_1, coalesce(lag(x1, 2) OVER w, first_value(x1) OVER w) AS x1_2 FROM canon WINDOW w AS (PARTITION BY stream ORDER BY pos))
SELECT * FROM wide WHERE pos % 5 = 0""")
def context_rows(spark, d):
    return transforms.fit_rows(events(spark, d), ["x1"], 3, 5).drop("t")


@query(f"""WITH {CANON}, z AS (SELECT stream, pos, count(*) OVER w AS c, abs(x1 - avg(x1) OVER w) / nullif(stddev_pop(x1) OVER w, 0) AS a, abs(x2 - avg(x2) OVER w) / nullif(stddev_pop(x2) OVER w, 0) AS b
 FROM canon WINDOW w AS (PARTITION BY stream ORDER BY pos ROWS 9 PRECEDING))
SELECT stream, pos, CASE WHEN c = 10 THEN round(greatest(a, b), 4) END AS zscore FROM z""")
def rolling_zscore(spark, d):
    return rounded(transforms.rolling_zscore(events(spark, d), CHANNELS, 10), 4, "zscore")


@query(f"""WITH {CANON}, s AS (SELECT stream, x1, x2, sqrt((x1 - lag(x1) OVER w) ** 2 + (x2 - lag(x2) OVER w) ** 2) AS step FROM canon WINDOW w AS (PARTITION BY stream ORDER BY pos))
SELECT stream, round(avg(step) / sqrt(var_pop(x1) + var_pop(x2)), 4) AS smoothness FROM s GROUP BY stream""")
def path_smoothness(spark, d):
    return rounded(transforms.smoothness(events(spark, d), CHANNELS), 4, "smoothness")


PROFILE = """runs AS (SELECT stream, pos, list(x1) OVER w AS run, avg(x1) OVER w AS m, stddev_pop(x1) OVER w AS s FROM canon WINDOW w AS (PARTITION BY stream ORDER BY pos ROWS 7 PRECEDING)),
pairs AS (SELECT a.stream, a.pos, sqrt(greatest(16 * (1 - (list_dot_product(a.run, b.run) / 8 - a.m * b.m) / (a.s * b.s)), 0)) AS dist
  FROM runs a JOIN runs b ON a.stream = b.stream AND abs(a.pos - b.pos) > 2 AND len(a.run) = 8 AND len(b.run) = 8)"""


@query(f"WITH {CANON}, {PROFILE} SELECT stream, pos, round(min(dist), 3) AS profile FROM pairs GROUP BY 1, 2")
def matrix_profile_joined(spark, d):
    return rounded(transforms.matrix_profile_joined(events(spark, d), "x1", 8), 3, "profile")


@query(f"""WITH {CANON}, {PROFILE} SELECT c.stream, c.pos, round(min(dist), 3) AS profile FROM canon c LEFT JOIN pairs p ON p.stream = c.stream AND p.pos = c.pos GROUP BY 1, 2""")
def matrix_profile(spark, d):
    return rounded(transforms.matrix_profile(events(spark, d), ["x1"], 8), 3, "profile")


# Windows and intervals


@query(f'WITH {CANON}, {BOUNDS} SELECT stream, CAST(w AS INTEGER) AS "window", lo, CAST(hi AS INTEGER) AS hi FROM bounds')
def window_bounds(spark, d):
    return windows.bounds(windows.lengths(events(spark, d)), 16)


@query(f'WITH {CANON}, {BOUNDS}, {CUT} SELECT stream, pos, x1, source, win AS "window", off AS "offset" FROM cut WHERE points >= 9')
def window_streams(spark, d):
    return cut(spark, d, 9).drop("t", "x2")


@query(f"WITH {CANON} SELECT stream, pos, x1 > 90 AS flag FROM canon JOIN sizes USING (stream) WHERE n >= 2")
def reassemble(spark, d):
    return windows.reassemble(cut(spark, d).withColumn("flag", F.col("x1") > 90))


@query(f"""WITH {CANON}, {BOUNDS}, {CUT}, f AS (SELECT stream, pos, n, x1 > 90 AS flag FROM canon JOIN sizes USING (stream) WHERE n >= 2),
runs AS (SELECT stream, min(pos) AS lo, max(pos) AS hi FROM (SELECT stream, pos, pos - row_number() OVER (PARTITION BY stream ORDER BY pos) AS g FROM f WHERE flag) GROUP BY stream, g),
c AS (SELECT stream, count(*) AS k, CAST(sum(hi - lo + 1) AS BIGINT) AS p FROM runs GROUP BY stream), m AS (SELECT source AS stream, max(x1) AS max_score FROM cut GROUP BY source)
SELECT s.stream, s.n::BIGINT AS n, coalesce(k, 0) AS n_anomalous_intervals, coalesce(p, 0) AS n_anomalous_points, round(coalesce(p, 0) / s.n, 5) AS anomalous_fraction, round(max_score, 4) AS max_score
FROM (SELECT * FROM sizes WHERE n >= 2) s LEFT JOIN c USING (stream) LEFT JOIN m USING (stream)""")
def reassembled_counts(spark, d):
    c = cut(spark, d)
    scored = c.groupBy("stream", "source").agg(F.max("x1").alias("max_score"))
    return rounded(rounded(windows.reassembled_counts(windows.reassemble(c.withColumn("flag", F.col("x1") > 90)), scored), 5, "anomalous_fraction"), 4, "max_score")


SPANS = CANON + ", spans AS (SELECT stream, pos AS lo, CAST(pos + CAST(x2 AS INT) % 4 AS INTEGER) AS hi FROM canon WHERE x1 > 80)"
MERGED = SPANS + """, marked AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY stream ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM spans),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY stream ORDER BY lo, hi) AS run FROM marked),
merged AS (SELECT stream, min(lo) AS lo, max(hi) AS hi FROM runs GROUP BY stream, run)"""


def spans(spark, d):
    return events(spark, d).where("x1 > 80").select("stream", F.col("pos").alias("lo"), (F.col("pos") + F.col("x2").cast("int") % 4).alias("hi"))


@query(f"WITH {MERGED} SELECT * FROM merged")
def merge_intervals(spark, d):
    return windows.merge(spans(spark, d))


@query(f"WITH {SPANS} SELECT c.stream, c.pos, EXISTS (SELECT 1 FROM spans s WHERE s.stream = c.stream AND c.pos BETWEEN s.lo AND s.hi) AS flag FROM canon c")
def intervals_to_mask(spark, d):
    return windows.rasterise(events(spark, d).select("stream", "pos"), spans(spark, d))


@query(f"""WITH {CANON}, f AS (SELECT stream, pos, pos - row_number() OVER (PARTITION BY stream ORDER BY pos) AS run FROM canon WHERE x1 > 40)
SELECT stream, min(pos) AS lo, max(pos) AS hi FROM f GROUP BY stream, run""")
def mask_segments(spark, d):
    return windows.segments(events(spark, d).withColumn("flag", F.col("x1") > 40))


@query(f"""WITH {MERGED}, rows AS (SELECT m.stream, lo, least(hi, n - 1) AS hi, 0 AS last FROM merged m JOIN sizes USING (stream) UNION ALL SELECT stream, n - 1, n - 1, 1 FROM sizes),
b AS (SELECT stream, lo, coalesce(max(hi) OVER (PARTITION BY stream ORDER BY last, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows)
SELECT stream, CAST(before AS INTEGER) AS lo, CAST(lo AS INTEGER) AS hi FROM b WHERE lo > before""")
def invert_clean(spark, d):
    n = windows.lengths(events(spark, d))
    clean = windows.merge(spans(spark, d)).join(n, "stream").select("stream", "lo", F.least(F.col("hi"), F.col("n") - 1).alias("hi"))
    return windows.complement(clean, n)


@query("""WITH n AS (SELECT DISTINCT user_id AS stream, CAST(9 + user_id % 60 AS INTEGER) AS n FROM events)
SELECT stream, CAST(unnest(range(0, 9)) AS INTEGER) AS i, CAST(round_even(unnest(range(0, 9)) * (n - 1) / 8, 0) AS INTEGER) AS edge FROM n""")
def grid_edges(spark, d):
    n = table(spark, d, "events").select(F.col("user_id").alias("stream"), (9 + F.col("user_id") % 60).cast("int").alias("n")).distinct()
    return n.select("stream", F.posexplode(windows.grid_edges(F.col("n"), 3)).alias("i", "edge"))


@query(f"""WITH {CANON}, c AS (SELECT stream, n, unnest(range(0, 9)) AS i FROM sizes WHERE n >= 9), e AS (SELECT stream, i, CAST(round_even(i * (n - 1) / 8, 0) AS INTEGER) AS edge FROM c)
SELECT a.stream, CAST(round_even(3 - log2(b.i - a.i), 0) AS INTEGER) AS depth, a.edge AS lo, b.edge AS hi, CAST(b.i - a.i AS INTEGER) AS n_cells FROM e a JOIN e b ON a.stream = b.stream AND a.i < b.i""")
def grid_intervals(spark, d):
    return windows.grid(windows.lengths(events(spark, d)), 3)


@query(f"""WITH {SPANS}, w AS (SELECT DISTINCT stream, lo, hi, -log2(greatest(least((hi - lo + 1) / (n - 1), 1.0), 1e-12)) AS sought, CAST(round_even(-log2((hi - lo + 1) / (n - 1)), 0) AS INTEGER) AS own FROM spans JOIN sizes USING (stream))
SELECT stream, lo, hi, own, CASE WHEN abs(0 - sought) <= abs(2 - sought) THEN 0 WHEN abs(2 - sought) <= abs(3 - sought) THEN 2 ELSE 3 END AS depth FROM w""")
def depth_for_width(spark, d):
    rows = spans(spark, d).distinct().join(windows.lengths(events(spark, d)), "stream")
    width, span = F.col("hi") - F.col("lo") + 1, F.col("n") - 1
    return rows.select("stream", "lo", "hi", windows.scale_depth(width, span).alias("own"), windows.depth_of(width / span, [0, 2, 3]).alias("depth"))


SOUGHT = "sought AS (SELECT DISTINCT user_id AS stream, user_id * 997.0 AS t_from, user_id * 997.0 + 200000.0 + (user_id % 7) * 30000.0 AS t_to FROM events)"


@query(f"""WITH {CANON}, {SOUGHT} SELECT s.stream, t_from, t_to, min(pos) AS lo, max(pos) AS hi FROM sought s LEFT JOIN canon c ON c.stream = s.stream AND c.t BETWEEN t_from AND t_to GROUP BY 1, 2, 3""")
def locate_intervals(spark, d):
    e = events(spark, d)
    t = F.col("stream") * 997.0
    return windows.locate(e.select("stream", "pos", "t"), e.select("stream").distinct().select("stream", t.alias("t_from"), (t + 200000.0 + (F.col("stream") % 7) * 30000.0).alias("t_to")))


ENDS = """ends AS (SELECT stream, n, CAST(unnest(CASE WHEN n - 1 >= 8 THEN range(8, n, 3) ELSE [n - 1] END) AS INTEGER) AS e FROM sizes)"""


@query(f'WITH {CANON}, {ENDS} SELECT stream, e AS "end" FROM ends')
def window_ends(spark, d):
    return windows.window_ends(windows.lengths(events(spark, d)), 8, 3)


@query(f"""WITH {CANON}, {ENDS}, s AS (SELECT c.stream, c.pos, coalesce(min(CASE WHEN e >= c.pos THEN e END), max(e)) AS e FROM canon c JOIN ends ON ends.stream = c.stream GROUP BY 1, 2)
SELECT s.stream, s.pos, c.x1 AS score FROM s JOIN canon c ON c.stream = s.stream AND c.pos = s.e""")
def spread_to_points(spark, d):
    e = events(spark, d)
    ends = windows.window_ends(windows.lengths(e), 8, 3)
    scored = ends.join(e.select("stream", F.col("pos").alias("end"), F.col("x1").alias("score")), ["stream", "end"])
    return windows.spread_to_points(e, scored)


SLIDING = "slides AS (SELECT stream, lo, lo + 9 AS hi FROM (SELECT stream, CAST(unnest(range(0, n - 9, 5)) AS INTEGER) AS lo FROM sizes WHERE n >= 10))"


@query(f"WITH {CANON}, {SLIDING} SELECT stream, lo, CAST(hi AS INTEGER) AS hi FROM slides")
def sliding_windows(spark, d):
    return windows.sliding(windows.lengths(events(spark, d)), 10, 5)


@query(f"""WITH {CANON}, {SLIDING}, s AS (SELECT w.*, c.x1 AS score FROM slides w JOIN canon c ON c.stream = w.stream AND c.pos = w.lo)
SELECT c.stream, c.pos, max(score) AS score, max(score) IS NOT NULL AS covered FROM canon c LEFT JOIN s ON s.stream = c.stream AND c.pos BETWEEN s.lo AND s.hi GROUP BY 1, 2""")
def paint_scores(spark, d):
    e = events(spark, d)
    slides = windows.sliding(windows.lengths(e), 10, 5).join(e.select("stream", F.col("pos").alias("lo"), F.col("x1").alias("score")), ["stream", "lo"])
    return windows.paint(e, slides)


@query(f"""WITH {CANON}, {SLIDING}, {FLAGS} SELECT w.stream, w.lo, CAST(w.hi AS INTEGER) AS hi, avg(CASE WHEN label THEN 1.0 ELSE 0.0 END) >= 2.0 / 3 AS label FROM slides w JOIN flags f ON f.stream = w.stream AND f.pos BETWEEN w.lo AND w.hi GROUP BY 1, 2, 3""")
def window_labels(spark, d):
    f = flags(spark, d)
    return windows.window_labels(f, windows.sliding(windows.lengths(f), 10, 5))


@query(f"""WITH {CANON}, drawn AS (SELECT stream, n, CAST(unnest(range(0, 5)) AS INTEGER) AS draw FROM sizes WHERE n >= 10)
SELECT stream, draw, CAST(('0x' || substr(md5(stream || ':' || draw || ':7'), 1, 8))::BIGINT % (n - 9) AS INTEGER) AS lo, CAST(('0x' || substr(md5(stream || ':' || draw || ':7'), 1, 8))::BIGINT % (n - 9) + 9 AS INTEGER) AS hi FROM drawn""")
def jittered_windows(spark, d):
    return windows.jittered(windows.lengths(events(spark, d)), 10, 5, 7)


# Signatures and normalisers

PATH = ["t", *CHANNELS]


def sig_sql(points: str, intervals: str, keys: str) -> str:
    """CTEs that end in sigs: the keys and s_0 ... of depth 2, for intervals over points."""
    area = ", ".join(f"0.5 * (lag({a}) OVER w + {a}) * ({b} - lag({b}) OVER w) AS a{i * 3 + j}" for i, a in enumerate(PATH) for j, b in enumerate(PATH))
    first = ", ".join(f"max(CASE WHEN p.pos = i.hi THEN p.{a} END) AS h{i}, max(CASE WHEN p.pos = i.lo THEN p.{a} END) AS l{i}" for i, a in enumerate(PATH))
    sums = ", ".join(f"sum(CASE WHEN p.pos > i.lo THEN a{k} ELSE 0 END) AS u{k}" for k in range(9))
    terms = ", ".join([f"h{i} AS s{i}" for i in range(3)] + [f"u{i * 3 + j} + 0.5 * l{i} * l{j} AS s{3 + i * 3 + j}" for i in range(3) for j in range(3)])
    names = ", ".join(f"i.{k}" for k in keys.split(", "))
    return f"""areas AS (SELECT *, {area} FROM {points} WINDOW w AS (PARTITION BY stream ORDER BY pos)),
ends AS (SELECT {names}, {first}, {sums} FROM {intervals} i JOIN areas p ON p.stream = i.stream AND p.pos BETWEEN i.lo AND i.hi GROUP BY {names}),
sigs AS (SELECT {keys}, {terms} FROM ends)"""


#: Days instead of seconds, so that all channels are of like size.
DAYS = "days AS (SELECT stream, pos, t / 86400 AS t, x1, x2 FROM canon)"
WHOLE = "whole AS (SELECT stream, 0 AS lo, n - 1 AS hi FROM sizes)"


def days(spark, d):
    return events(spark, d).withColumn("t", F.col("t") / 86400)


def whole(points):
    return windows.lengths(points).select("stream", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))


def spelled(sigs: DataFrame, keys: list[str], digits: int = 4, n: int = 12, first: int = 0) -> DataFrame:
    return sigs.select(*keys, *[F.round(F.get("sig", F.lit(i)), digits).alias(f"s{i}") for i in range(first, n)])


def spelled_sql(digits: int = 4, n: int = 12, first: int = 0) -> str:
    return ", ".join(f"round(s{i}, {digits}) + 0.0 AS s{i}" for i in range(first, n))


@query(f"WITH {CANON}, {DAYS}, {WHOLE}, {sig_sql('days', 'whole', 'stream, lo, hi')} SELECT stream, {spelled_sql(4, 3)} FROM sigs")
def signature_level1(spark, d):
    p = days(spark, d)
    return spelled(signature.signatures(p, CHANNELS, whole(p), 1), ["stream"], 4, 3)


@query(f"WITH {CANON}, {DAYS}, {WHOLE}, {sig_sql('days', 'whole', 'stream, lo, hi')} SELECT stream, {spelled_sql(3, 12, 3)} FROM sigs")
def signature_level2(spark, d):
    p = days(spark, d)
    return spelled(signature.signatures(p, CHANNELS, whole(p), 2), ["stream"], 3, 12, 3)


def deep_sql() -> str:
    """Level 3 of whole streams: each step v from x adds S2 v, x v v / 2 and v v v / 6, and to S2 before x v and v v / 2."""
    steps = ", ".join(f"coalesce(lag({a}) OVER w, 0) AS b{i}, {a} - coalesce(lag({a}) OVER w, 0) AS v{i}" for i, a in enumerate(PATH))
    second = ", ".join(f"coalesce(sum(b{i} * v{j} + 0.5 * v{i} * v{j}) OVER before, 0) AS p{i}{j}" for i in range(3) for j in range(3))
    third = ", ".join(f"round(sum(p{i}{j} * v{k} + b{i} * v{j} * v{k} / 2 + v{i} * v{j} * v{k} / 6), 3) + 0.0 AS s{12 + 9 * i + 3 * j + k}" for i in range(3) for j in range(3) for k in range(3))
    return f"""steps AS (SELECT stream, pos, {steps} FROM days WINDOW w AS (PARTITION BY stream ORDER BY pos)),
parts AS (SELECT *, {second} FROM steps WINDOW before AS (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stream, {third} FROM parts GROUP BY stream"""


@query(f"WITH {CANON}, {DAYS}, {deep_sql()}")
def signature_deep(spark, d):
    p = days(spark, d)
    return spelled(signature.deep_signatures(p, CHANNELS, whole(p), 3), ["stream"], 3, 39, 12)


#: Points that a window needs to be in the corpus: the grid's edges. Windows to be tested need two.
CORPUS_POINTS = 9
GRID = f"""wcut AS (SELECT stream, pos, points, t / 86400 AS t, x1, x2 FROM cut WHERE points >= {CORPUS_POINTS}),
gridded AS (SELECT stream, CAST(round_even(3 - log2(j - i), 0) AS INTEGER) AS depth, CAST(round_even(i * (points - 1) / 8.0, 0) AS INTEGER) AS lo, CAST(round_even(j * (points - 1) / 8.0, 0) AS INTEGER) AS hi
  FROM (SELECT DISTINCT stream, points FROM wcut), range(0, 9) a(i), range(0, 9) b(j) WHERE i < j)"""
CORPUS = f"{CANON}, {BOUNDS}, {CUT}, {GRID}, {sig_sql('wcut', 'gridded', 'stream, depth, lo, hi')}"


def corpus(spark, d, fast: bool = False):
    """Signatures of all grid intervals of all windows that are long enough for the grid."""
    c = cut(spark, d, CORPUS_POINTS).withColumn("t", F.col("t") / 86400).select("stream", "pos", "t", *CHANNELS)
    return signature.corpus(c, CHANNELS, 3, 2, fast)


@query(f"WITH {CORPUS} SELECT stream, depth, lo, hi, {spelled_sql(3)} FROM sigs")
def grid_corpus(spark, d):
    return spelled(corpus(spark, d), ["stream", "depth", "lo", "hi"], 3)


@query(f"WITH {CORPUS} SELECT stream, depth, lo, hi, {spelled_sql(3)} FROM sigs")
def grid_corpus_prefix(spark, d):
    return spelled(corpus(spark, d, True), ["stream", "depth", "lo", "hi"], 3)


def normalised_sql(centre: str, scale: str) -> str:
    stats = ", ".join(f"{centre.format(c=f's{i}')} AS c{i}, CASE WHEN {scale.format(c=f's{i}')} = 0 THEN 1 ELSE {scale.format(c=f's{i}')} END AS v{i}" for i in range(12))
    terms = ", ".join(f"round((s{i} - c{i}) / v{i}, 4) + 0.0 AS s{i}" for i in range(12))
    return f"WITH {CORPUS}, stats AS (SELECT {stats} FROM sigs) SELECT stream, depth, lo, hi, {terms} FROM sigs, stats"


def _normalised(method: str):
    def f(spark, d):
        sigs = corpus(spark, d)
        return spelled(normalise.apply(sigs, normalise.fit(sigs, method, 3)), ["stream", "depth", "lo", "hi"])

    f.__name__ = f"normalise_{method}"
    return f


for _name, _centre, _scale in (("zscore", "avg({c})", "stddev_pop({c})"), ("scale", "0.0", "stddev_pop({c})"), ("maxabs", "0.0", "max(abs({c}))")):
    query(normalised_sql(_centre, _scale))(_normalised(_name))
query(f"WITH {CORPUS} SELECT stream, depth, lo, hi, " + ", ".join(f"round(s{i}{' * 2' if i > 2 else ''}, 4) + 0.0 AS s{i}" for i in range(12)) + " FROM sigs")(_normalised("factorial"))


# Neighbours and thresholds

VECTORS = "vectors AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z, label FROM embeddings)"
SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"), "label")


def nearest_sql(where: str, k: int) -> str:
    return f"""WITH {VECTORS}, pairs AS (SELECT q.id AS query, r.id AS ref, {SQUARED.format(a='q.z', b='r.z')} AS d FROM vectors q JOIN vectors r ON {where})
SELECT query, ref, round(d, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, ref) AS rank FROM pairs) WHERE rank <= {k}"""


def sides(spark, d):
    v = vectors(spark, d)
    return v.where("id % 50 = 0").withColumnRenamed("id", "query"), v.withColumnRenamed("id", "ref")


@query(nearest_sql("q.id % 50 = 0", 3))
def knn_exact(spark, d):
    q, r = sides(spark, d)
    return rounded(knn.nearest_blocked(q, r, 3), 5, "distance")


@query(nearest_sql("q.id % 50 = 0", 3))
def knn_joined(spark, d):
    q, r = sides(spark, d)
    return rounded(knn.nearest_joined(q.drop("label"), r.drop("label"), 3), 5, "distance")


@query(nearest_sql("q.id <> r.id", 1))
def knn_exclude_self(spark, d):
    v = vectors(spark, d)
    return rounded(knn.nearest_blocked(v.withColumnRenamed("id", "query"), v.withColumnRenamed("id", "ref"), 1, skip_self=True), 5, "distance")


@query(nearest_sql("q.id % 10 = 0 AND abs(q.label - r.label) <= 1", 2))
def knn_depth_band(spark, d):
    v = vectors(spark, d).withColumnRenamed("label", "depth")
    refs = knn.banded(v.withColumnRenamed("id", "ref"), 1).drop("depth").withColumnRenamed("probe", "depth")
    return rounded(knn.nearest_blocked(v.where("id % 10 = 0").withColumnRenamed("id", "query"), refs, 2, group="depth"), 5, "distance")


@query()
def knn_cells(spark, d):
    q, r = sides(spark, d)
    return rounded(knn.nearest_in_cells(q.drop("label"), r.drop("label"), 3), 5, "distance")


@query()
def knn_hashed(spark, d):
    q, r = sides(spark, d)
    return rounded(knn.nearest_hashed(q, r, 3), 5, "distance")


FOLD = "CAST(CAST(regexp_replace(stream, '_[0-9]+$', '') AS BIGINT) % 5 AS INTEGER)"
SQUARE = " + ".join(f"(q.z{i} - r.z{i}) * (q.z{i} - r.z{i})" for i in range(12))


def scaled_sql(where: str = "true") -> str:
    """CTEs that end in zs: z-scored signatures with their fold; statistics are of the rows where."""
    stats = ", ".join(f"avg(s{i}) AS c{i}, CASE WHEN stddev_pop(s{i}) = 0 THEN 1 ELSE stddev_pop(s{i}) END AS v{i}" for i in range(12))
    return f"""folded AS (SELECT *, {FOLD} AS fold FROM sigs), stats AS (SELECT {stats} FROM folded WHERE {where}),
zs AS (SELECT stream, depth, lo, hi, fold, {', '.join(f'(s{i} - c{i}) / v{i} AS z{i}' for i in range(12))} FROM folded, stats)"""


def third_sql(asked: str, refs: str, apart: str) -> str:
    """The squared distance of each row of asked to its third neighbour in refs, at most a depth away."""
    return f"""SELECT stream, depth, lo, hi, min(dd, 3)[3] AS distance FROM (
  SELECT q.stream, q.depth, q.lo, q.hi, {SQUARE} AS dd FROM {asked} q JOIN (SELECT *, unnest([depth - 1, depth, depth + 1]) AS probe FROM {refs}) r ON r.probe = q.depth AND {apart}) GROUP BY stream, depth, lo, hi"""


SCORED = f"{CORPUS}, {scaled_sql()}, dist AS ({third_sql('zs', 'zs', 'r.fold <> q.fold')})"


def folded(sigs: DataFrame) -> DataFrame:
    """(query, depth, fold, z): signatures by interval, dealt to five folds by user."""
    fold = (streams.source_of(F.col("stream")).cast("long") % 5).cast("int")
    return sigs.select(F.concat_ws(":", "stream", "lo", "hi").alias("query"), "depth", fold.alias("fold"), F.col("sig").alias("z"))


def in_folds(members: DataFrame) -> DataFrame:
    """(stream, kind, fold): windows with their users' folds."""
    return members.select("stream", "kind", (F.col("source") % 5).cast("int").alias("fold"))


def calibrated(spark, d):
    """(rows, members): z-scored grid intervals of kinds of windows, n copies in a fold, to those of other users' folds; and which windows they are."""
    with copies.shuffles_dropped(spark):
        points, members = copies.kinds(cut(spark, d, CORPUS_POINTS).withColumn("t", F.col("t") / 86400), CHANNELS)
        members = in_folds(members)
        own = copies.kept(copies.dealt(members, 3))
        sigs = copies.kept(signature.corpus(points, CHANNELS, 3, 2, True).withColumnRenamed("stream", "kind").join(own, "kind"))
        rows = normalise.apply(sigs, normalise.fit(sigs, "zscore", copies="copies")).withColumnRenamed("sig", "z")
        return calibrate.kind_distances(copies.kept(copies.numbered(rows)), 3, 1), members


@query(f"WITH {SCORED} SELECT stream || ':' || lo || ':' || hi AS query, depth, round(distance, 4) AS distance FROM dist")
def fold_distances(spark, d):
    rows, members = calibrated(spark, d)
    return rounded(rows.join(members, ["kind", "fold"]).select(copies.name_of("stream").alias("query"), "depth", "distance"), 4, "distance")


@query(f"""WITH {SCORED}, cuts AS (SELECT depth, quantile_cont(distance, 0.95) AS threshold FROM dist GROUP BY depth)
SELECT depth, CAST(2.0 ** -depth AS DOUBLE) AS relative_width, count(*) AS n_calibration, round(min(threshold), 4) AS threshold, round(quantile_cont(distance, 0.5), 4) AS median_distance,
 round(quantile_cont(distance, 0.9), 4) AS p90_distance, round(quantile_cont(distance, 0.99), 4) AS p99_distance, round(max(distance), 4) AS max_distance, count(*) FILTER (WHERE distance > threshold) AS n_above_threshold
FROM dist JOIN cuts USING (depth) GROUP BY depth""")
def calibrate_thresholds(spark, d):
    return rounded(calibrate.thresholds(calibrated(spark, d)[0], copies="n"), 4, "threshold", "median_distance", "p90_distance", "p99_distance", "max_distance")


@query(f"""WITH {VECTORS}, pairs AS (SELECT q.id, q.label, min({SQUARED.format(a='q.z', b='r.z')}) AS d FROM vectors q JOIN vectors r ON q.id <> r.id AND abs(q.label - r.label) <= 1 GROUP BY 1, 2)
SELECT label AS depth, count(*) AS n, round(quantile_cont(d, 0.5), 4) AS median, round(quantile_cont(d, 0.9), 4) AS p90, round(quantile_cont(d, 0.99), 4) AS p99, round(max(d), 4) AS max FROM pairs GROUP BY label""")
def score_distribution(spark, d):
    v = vectors(spark, d).withColumnRenamed("label", "depth")
    refs = knn.banded(v.withColumnRenamed("id", "ref"), 1).drop("depth").withColumnRenamed("probe", "depth")
    q = v.withColumnRenamed("id", "query")
    found = knn.nearest_blocked(q, refs, 1, group="depth", skip_self=True)
    return rounded(knn.score_distribution(found, q.select("query", "depth")), 4, "median", "p90", "p99", "max")


@query(f"""WITH {VECTORS}, r AS (SELECT id, label AS depth, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || id), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM vectors)
SELECT id, depth FROM r WHERE r <= greatest(1, round_even(0.3 * n, 0))""")
def stratified_subsample(spark, d):
    v = vectors(spark, d).withColumnRenamed("label", "depth")
    return knn.stratified(v, "id", 0.3).select("id", "depth")


# Votes, labels and metrics

VOTES = CANON + """, votes AS (SELECT stream, pos, CAST((x1 > 60)::INT + (x2 > 70)::INT + (x1 + x2 > 150)::INT AS INTEGER) AS votes, pos >= n - 21 AS label FROM canon JOIN sizes USING (stream))"""


def voted(spark, d):
    e = events(spark, d)
    rules = {0: F.col("x1") > 60, 1: F.col("x2") > 70, 2: F.col("x1") + F.col("x2") > 150}
    draws = F.explode(F.array(*[F.struct(F.lit(k).alias("draw"), c.alias("flag")) for k, c in rules.items()]))
    return bagging.count_votes(e.select("stream", "pos", draws.alias("r")).select("stream", "pos", "r.*"), 2)


@query(f"WITH {VOTES} SELECT stream, pos, votes, 3 AS draws, votes >= 2 AS flag, round(votes / 3.0, 4) AS point_score FROM votes")
def vote_masks(spark, d):
    return rounded(voted(spark, d), 4, "point_score")


@query(f"""WITH {VOTES}, c AS (SELECT v, count(*) FILTER (WHERE label AND votes >= v) AS tp, count(*) FILTER (WHERE NOT label AND votes >= v) AS fp, count(*) FILTER (WHERE label AND votes < v) AS fn FROM votes, range(1, 4) r(v) GROUP BY v),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT CAST(v AS INTEGER) AS v, tp, fp, fn, round(precision, 5) AS precision, round(recall, 5) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 5) AS f1 FROM p""")
def vote_curve(spark, d):
    both = voted(spark, d).drop("flag").join(flags(spark, d).select("stream", "pos", "label"), ["stream", "pos"])
    return rounded(evaluate.vote_curve(both, 3), 5, "precision", "recall", "f1")


@query(f"WITH {CANON}, {FLAGS} SELECT stream, pos, label FROM flags")
def labels_rul(spark, d):
    return flags(spark, d).select("stream", "pos", "label")


TRUTH = "marks AS (SELECT DISTINCT user_id AS stream, user_id * 997.0 AS a, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id * 997.0 + 400000.0 END AS extended, user_id * 997.0 + 200000.0 AS b FROM events)"


@query(f"""WITH {CANON}, {TRUTH} SELECT m.stream, min(pos) AS lo, max(pos) AS hi FROM marks m JOIN canon c ON c.stream = m.stream AND c.t BETWEEN a AND greatest(coalesce(extended, b), b) GROUP BY m.stream""")
def labels_from_events(spark, d):
    e = events(spark, d)
    t = F.col("stream") * 997.0
    marks = e.select("stream").distinct().select("stream", t.alias("root_cause_start"), (t + 200000.0).alias("root_cause_end"), F.when(F.col("stream") % 3 == 0, F.lit(None)).otherwise(t + 400000.0).alias("extended_effect_end"))
    return labels.intervals_from_events(e.select("stream", "pos", "t"), marks)[0]


SCORES = """c AS (SELECT count(*) FILTER (WHERE label AND {f}) AS tp, count(*) FILTER (WHERE NOT label AND {f}) AS fp, count(*) FILTER (WHERE label AND NOT {f}) AS fn, count(*) FILTER (WHERE NOT label AND NOT {f}) AS tn FROM {t}),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT tp, fp, fn, tn, round(precision, 5) AS precision, round(recall, 5) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 5) AS f1 FROM p"""


@query(f"WITH {CANON}, {FLAGS}, {SCORES.format(f='flag', t='flags')}")
def prf(spark, d):
    return rounded(evaluate.prf(flags(spark, d)), 5, "precision", "recall", "f1")


#: Labels that reach over the end of a stream into the next one, to join runs across streams.
EDGED = CANON + """, edged AS (SELECT stream, pos, n, x1 > 90 AS flag, pos >= n - 6 OR (pos < 4 AND stream % 2 = 1) OR pos BETWEEN 20 AND 24 AS label FROM canon JOIN sizes USING (stream)),
runs AS (SELECT *, sum(CASE WHEN label THEN 0 ELSE 1 END) OVER (ORDER BY stream, pos) AS gap FROM edged),
adjusted AS (SELECT stream, pos, label, flag, CASE WHEN label THEN bool_or(flag) FILTER (WHERE label) OVER (PARTITION BY gap) ELSE flag END AS adjusted FROM runs)"""


def edged(spark, d):
    e = evaluate.labels_to_failure(events(spark, d), 5)
    label = F.col("label") | ((F.col("pos") < 4) & (F.col("stream") % 2 == 1)) | F.col("pos").between(20, 24)
    return e.select("stream", "pos", label.alias("label"), (F.col("x1") > 90).alias("flag"))


@query(f"WITH {EDGED} SELECT * FROM adjusted")
def point_adjust(spark, d):
    return evaluate.point_adjust(edged(spark, d))


@query(f"""WITH {EDGED}, r AS (SELECT stream, min(pos) AS lo, max(pos) AS hi FROM (SELECT stream, pos, pos - row_number() OVER (PARTITION BY stream ORDER BY pos) AS g FROM edged WHERE label) GROUP BY stream, g),
s AS (SELECT stream, min(pos) AS lo, max(pos) AS hi FROM (SELECT stream, pos, pos - row_number() OVER (PARTITION BY stream ORDER BY pos) AS g FROM edged WHERE flag) GROUP BY stream, g),
rr AS (SELECT r.stream, r.lo, r.hi, count(s.lo) AS meets, coalesce(sum(greatest(least(r.hi, s.hi) - greatest(r.lo, s.lo) + 1, 0)), 0) / (r.hi - r.lo + 1) AS share, coalesce((min(greatest(s.lo, r.lo)) - r.lo) / (r.hi - r.lo + 1), 1.0) AS late
  FROM r LEFT JOIN s ON s.stream = r.stream AND s.lo <= r.hi AND r.lo <= s.hi GROUP BY 1, 2, 3),
pp AS (SELECT s.stream, s.lo, s.hi, count(r.lo) AS meets, coalesce(sum(greatest(least(r.hi, s.hi) - greatest(r.lo, s.lo) + 1, 0)), 0) / (s.hi - s.lo + 1) AS share
  FROM s LEFT JOIN r ON s.stream = r.stream AND s.lo <= r.hi AND r.lo <= s.hi GROUP BY 1, 2, 3),
p AS (SELECT avg(share) AS p1, avg(CASE WHEN meets = 1 THEN share ELSE 0 END) AS p4 FROM pp)
SELECT 'AD1' AS level, round(avg(CASE WHEN meets > 0 THEN 1.0 ELSE 0 END), 5) AS recall, (SELECT round(p1, 5) FROM p) AS precision FROM rr
UNION ALL SELECT 'AD2', round(avg(share), 5), (SELECT round(p1, 5) FROM p) FROM rr
UNION ALL SELECT 'AD3', round(avg(share * (1 - late)), 5), (SELECT round(p1, 5) FROM p) FROM rr
UNION ALL SELECT 'AD4', round(avg(CASE WHEN meets = 1 THEN share * (1 - late) ELSE 0 END), 5), (SELECT round(p4, 5) FROM p) FROM rr""")
def range_metrics(spark, d):
    return rounded(evaluate.range_metrics(edged(spark, d)), 5, "recall", "precision")


@query(f"""WITH {EDGED}, c AS (SELECT *, pos >= 3 AS covered FROM adjusted),
k AS (SELECT count(*) FILTER (label AND flag) AS tp, count(*) FILTER (NOT label AND flag) AS fp, count(*) FILTER (label AND NOT flag) AS fn, count(*) FILTER (NOT label AND NOT flag) AS tn,
 count(*) FILTER (label AND adjusted) AS atp, count(*) FILTER (NOT label AND adjusted) AS afp, count(*) FILTER (label AND NOT adjusted) AS afn, count(*) FILTER (NOT label AND NOT adjusted) AS atn FROM c WHERE covered),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q, coalesce(atp / nullif(atp + afp, 0), 0) AS ap, coalesce(atp / nullif(atp + afn, 0), 0) AS aq FROM k)
SELECT tp AS point_tp, fp AS point_fp, fn AS point_fn, tn AS point_tn, round(p, 5) AS point_precision, round(q, 5) AS point_recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 5) AS point_f1,
 atp AS adj_tp, afp AS adj_fp, afn AS adj_fn, atn AS adj_tn, round(ap, 5) AS adj_precision, round(aq, 5) AS adj_recall, round(coalesce(2 * ap * aq / nullif(ap + aq, 0), 0), 5) AS adj_f1,
 (SELECT round(avg(covered::INT), 5) FROM c) AS covered_fraction FROM r""")
def point_level(spark, d):
    found = evaluate.point_level(edged(spark, d).withColumn("covered", F.col("pos") >= 3))
    return rounded(found, 5, *[f"{a}_{b}" for a in ("point", "adj") for b in ("precision", "recall", "f1")], "covered_fraction")


RANKED = CANON + """, pts AS (SELECT pos >= n - 21 AS label, floor(x1) AS score FROM canon JOIN sizes USING (stream)),
by_score AS (SELECT score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM pts GROUP BY score),
curve AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM by_score WINDOW w AS (ORDER BY score DESC))"""


def ranked(spark, d):
    return flags(spark, d).withColumn("score", F.floor("x1").cast("double"))


@query(f"""WITH {RANKED} SELECT round(sum(n * ((tp - p) + p / 2)) / (max(pos) * max(neg)), 6) AS roc_auc, round(sum(p / pos * (tp / (tp + fp))), 6) AS average_precision,
 round(sum(p / pos * (tp / (tp + fp))) / (max(pos) / (max(pos) + max(neg))), 6) AS lift FROM curve""")
def ranking(spark, d):
    return rounded(evaluate.ranking(ranked(spark, d)), 6, "roc_auc", "average_precision", "lift")


WINDOWED = RANKED.replace("floor(x1) AS score FROM canon", "floor(x1) AS score, x1 > 90 AS flag FROM canon")
SHARES = """k AS (SELECT count(*) FILTER (label AND flag) AS tp, count(*) FILTER (NOT label AND flag) AS fp, count(*) FILTER (label AND NOT flag) AS fn, count(*) FILTER (NOT label AND NOT flag) AS tn, count(*) AS n_windows,
 avg(label::INT) AS positive_rate, avg(flag::INT) AS flagged_rate, quantile_cont(score, 0.5) AS score_median, quantile_cont(score, 0.05) AS score_p05, quantile_cont(score, 0.95) AS score_p95 FROM pts),
rk AS (SELECT sum(n * ((tp - p) + p / 2)) / (max(pos) * max(neg)) AS roc_auc, sum(p / pos * (tp / (tp + fp))) AS average_precision, max(pos) / (max(pos) + max(neg)) AS base FROM curve),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM k, rk)"""


@query(f"""WITH {WINDOWED}, {SHARES} SELECT tp, fp, fn, tn, round(precision, 5) AS precision, round(recall, 5) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 5) AS f1, n_windows,
 round(positive_rate, 5) AS positive_rate, round(flagged_rate, 5) AS flagged_rate, round(score_median, 4) AS score_median, round(score_p05, 4) AS score_p05, round(score_p95, 4) AS score_p95,
 round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(average_precision / base, 6) AS lift FROM r""")
def window_report(spark, d):
    out = evaluate.window_report(ranked(spark, d), "score")
    return rounded(rounded(rounded(out, 5, "precision", "recall", "f1", "positive_rate", "flagged_rate"), 4, "score_median", "score_p05", "score_p95"), 6, "roc_auc", "average_precision", "lift")


@query(f"""WITH {EDGED.replace("x1 > 90 AS flag", "x1 > 90 AS flag, floor(x1) AS score").replace("SELECT stream, pos, label, flag, CASE", "SELECT stream, pos, label, flag, score, CASE")},
by_score AS (SELECT score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM adjusted GROUP BY score),
curve AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM by_score WINDOW w AS (ORDER BY score DESC)),
rk AS (SELECT sum(n * ((tp - p) + p / 2)) / (max(pos) * max(neg)) AS roc_auc, sum(p / pos * (tp / (tp + fp))) AS average_precision, max(pos) / (max(pos) + max(neg)) AS base FROM curve),
k AS (SELECT count(*) FILTER (label AND flag) AS tp, count(*) FILTER (NOT label AND flag) AS fp, count(*) FILTER (label AND NOT flag) AS fn, count(*) FILTER (label AND adjusted) AS atp, count(*) FILTER (NOT label AND adjusted) AS afp,
 count(*) FILTER (label AND NOT adjusted) AS afn, avg(flag::INT) AS flagged, avg(label::INT) AS anomaly_rate FROM adjusted),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q, coalesce(atp / nullif(atp + afp, 0), 0) AS ap, coalesce(atp / nullif(atp + afn, 0), 0) AS aq FROM k, rk)
SELECT round(p, 5) AS precision, round(q, 5) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 5) AS f1, round(ap, 5) AS adj_precision, round(aq, 5) AS adj_recall, round(coalesce(2 * ap * aq / nullif(ap + aq, 0), 0), 5) AS adj_f1,
 round(flagged, 5) AS flagged, round(anomaly_rate, 5) AS anomaly_rate, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(average_precision / base, 6) AS lift FROM r""")
def detector_report(spark, d):
    points = edged(spark, d).join(events(spark, d).select("stream", "pos", F.floor("x1").cast("double").alias("score")), ["stream", "pos"])
    out = evaluate.detector_report(points, "score")
    return rounded(rounded(out, 5, "precision", "recall", "f1", "adj_precision", "adj_recall", "adj_f1", "flagged", "anomaly_rate"), 6, "roc_auc", "average_precision", "lift")


@query(f"""WITH {RANKED}, c AS (SELECT score, tp / pos AS tpr, fp / neg AS fpr FROM curve) SELECT score AS cut, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c ORDER BY c.tpr - c.fpr DESC, score DESC LIMIT 1""")
def youden_cut(spark, d):
    return rounded(evaluate.youden_cut(ranked(spark, d)), 6, "tpr", "fpr")


@query(f"""WITH {RANKED}, c AS (SELECT score, tp / (tp + fp) AS precision, tp / pos AS recall FROM curve), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c)
SELECT score AS cut, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score DESC LIMIT 1""")
def f1_cut(spark, d):
    return rounded(evaluate.f1_cut(ranked(spark, d)), 6, "precision", "recall", "f1")


OPERATING = CANON + """, pts AS (SELECT pos >= n - 21 AS label, x1 FROM canon JOIN sizes USING (stream)),
c AS (SELECT scale, count(*) FILTER (WHERE label AND x1 > 50 * scale) AS tp, count(*) FILTER (WHERE NOT label AND x1 > 50 * scale) AS fp, count(*) FILTER (WHERE label AND NOT x1 > 50 * scale) AS fn, count(*) FILTER (WHERE NOT label AND NOT x1 > 50 * scale) AS tn
  FROM pts, (VALUES (0.5), (1.0), (2.0), (4.0)) s(scale) GROUP BY scale),
r AS (SELECT CAST(scale AS DOUBLE) AS scale, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c)"""


def operating(spark, d):
    few = F.explode(F.array(*[F.lit(s) for s in (0.5, 1.0, 2.0, 4.0)]))
    pts = flags(spark, d).withColumn("scale", few).withColumn("flag", F.col("x1") > 50 * F.col("scale"))
    return evaluate.rates(pts, ["scale"])


@query(f"""WITH {OPERATING} SELECT scale, tp, fp, fn, tn, round(precision, 5) AS precision, round(recall, 5) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 5) AS f1, round(recall, 5) AS tpr, round(fpr, 5) AS fpr FROM r""")
def operating_points(spark, d):
    return rounded(operating(spark, d), 5, "precision", "recall", "f1", "tpr", "fpr")


@query(f"""WITH {OPERATING}, k AS (SELECT fpr, recall AS tpr FROM r UNION SELECT 0.0, 0.0 UNION SELECT 1.0, 1.0), l AS (SELECT fpr, tpr, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM k WINDOW w AS (ORDER BY fpr, tpr))
SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS area FROM l""")
def operating_point_auc(spark, d):
    return rounded(evaluate.trapezoid(operating(spark, d)), 6, "area")


@query(f"""WITH {CANON}, {FLAGS}, quantiles AS (SELECT quantile_cont(x1, [0.5, 0.9, 0.95, 0.99]) AS q FROM canon), cuts AS (SELECT unnest([50.0, 90.0, 95.0, 99.0])::DOUBLE AS percentile, unnest(q) AS cut FROM quantiles),
c AS (SELECT percentile, cut, count(*) FILTER (WHERE label AND x1 > cut) AS tp, count(*) FILTER (WHERE NOT label AND x1 > cut) AS fp, count(*) FILTER (WHERE label AND NOT x1 > cut) AS fn, count(*) FILTER (WHERE NOT label AND NOT x1 > cut) AS tn FROM flags, cuts GROUP BY 1, 2),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT percentile, round(cut, 4) AS cut, tp, fp, fn, tn, round(precision, 5) AS precision, round(recall, 5) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 5) AS f1 FROM p""")
def percentile_sweep(spark, d):
    return rounded(rounded(evaluate.percentile_sweep(flags(spark, d), [50, 90, 95, 99], "x1"), 5, "precision", "recall", "f1"), 4, "cut")


@query(f"""WITH {CANON} SELECT n - 1 - pos AS rul, round(avg(x1), 4) AS mean, round(quantile_cont(x1, 0.5), 4) AS median, round(quantile_cont(x1, 0.25), 4) AS q25, round(quantile_cont(x1, 0.75), 4) AS q75, count(DISTINCT stream) AS streams FROM canon JOIN sizes USING (stream) GROUP BY 1""")
def health_curve(spark, d):
    return rounded(evaluate.health_curve(streams.remaining_life(events(spark, d), 15), "x1"), 4, "mean", "median", "q25", "q75")


@query(f"WITH {CANON}, {FLAGS} SELECT round(quantile_cont(x1, 0.5) FILTER (WHERE label) / greatest(quantile_cont(x1, 0.5) FILTER (WHERE NOT label), 1e-9), 5) AS separation FROM flags")
def separation(spark, d):
    return rounded(evaluate.separation(flags(spark, d), "x1"), 5, "separation")


RATIOS = MERGED + ", ratios AS (SELECT m.stream, lo, least(hi, n - 1) AS hi, n, (least(hi, n - 1) - lo + 1) / 2.0 AS ratio FROM merged m JOIN sizes USING (stream))"


def ratios(spark, d):
    rows = windows.merge(spans(spark, d)).join(windows.lengths(events(spark, d)), "stream").withColumn("hi", F.least(F.col("hi"), F.col("n") - 1))
    return rows.select("stream", "lo", "hi", ((F.col("hi") - F.col("lo") + 1) / 2.0).alias("ratio"))


@query(f"WITH {RATIOS} SELECT stream, lo, CAST(hi AS INTEGER) AS hi, CAST(ratio AS DOUBLE) AS ratio, rank() OVER (ORDER BY ratio DESC) AS rank, CASE WHEN ratio > 1 THEN 'anomalous' ELSE 'inconclusive' END AS verdict FROM ratios")
def classify_intervals(spark, d):
    return evaluate.classify(ratios(spark, d))


@query(f"""WITH {RATIOS} SELECT s.stream, count(lo) AS n_intervals, count(*) FILTER (WHERE ratio > 1) AS n_anomalous, count(*) FILTER (WHERE ratio <= 1) AS n_inconclusive,
 CAST(coalesce(sum(CASE WHEN ratio > 1 THEN hi - lo + 1 END), 0) AS BIGINT) AS n_points, round(coalesce(sum(CASE WHEN ratio > 1 THEN hi - lo + 1 END), 0) / s.n, 5) AS fraction, CAST(max(ratio) AS DOUBLE) AS max_ratio
FROM sizes s LEFT JOIN ratios r ON r.stream = s.stream GROUP BY s.stream, s.n""")
def summarise_streams(spark, d):
    return rounded(evaluate.summarise(evaluate.classify(ratios(spark, d)), windows.lengths(events(spark, d))), 5, "fraction")


@query("""SELECT CAST(sum(event_id % 7) AS DOUBLE) AS seconds, CAST(max(event_id % 1000) AS DOUBLE) AS max_rss, count(*) AS jobs, 10000.0::DOUBLE AS points, round(10000.0 / sum(event_id % 7), 5) AS points_per_second FROM events""")
def throughput(spark, d):
    jobs = table(spark, d, "events").select((F.col("event_id") % 7).cast("string").alias("s"), (F.col("event_id") % 1000).cast("string").alias("max_rss"))
    return rounded(report.throughput(jobs, {"points": 10000}), 5, "points_per_second")


# Detectors


def flagged_sql() -> str:
    near = ", ".join(f"abs(log2((points - 1) / 16.0) + {k})" for k in range(4))
    return f"""WITH {CANON}, {BOUNDS}, {CUT}, {GRID.replace('wcut AS (', 'all_points AS (SELECT stream, pos, points, t / 86400 AS t, x1, x2 FROM cut), wcut AS (')},
intervals AS (SELECT *, 0 AS tested FROM gridded WHERE {FOLD} <> 4
  UNION ALL SELECT stream, CAST(list_position([{near}], list_min([{near}])) - 1 AS INTEGER), 0, points - 1, 1 FROM (SELECT DISTINCT stream, points FROM all_points) WHERE {FOLD} = 4),
{sig_sql('all_points', 'intervals', 'stream, depth, lo, hi, tested')}, {scaled_sql('tested = 0')},
known AS (SELECT * FROM zs WHERE fold <> 4), tests AS (SELECT * FROM zs WHERE fold = 4),
dist AS ({third_sql('known', 'known', 'r.fold <> q.fold')}), scores AS ({third_sql('tests', 'known', 'true')}),
cuts AS (SELECT depth, quantile_cont(distance, 0.95) AS threshold FROM dist GROUP BY depth)
SELECT stream, CAST(hi + 1 AS INTEGER) AS points, depth, round(distance, 4) AS distance, round(threshold, 4) AS threshold, distance > threshold AS flagged FROM scores JOIN cuts USING (depth)"""


@query(flagged_sql())
def flagged_windows(spark, d):
    """The flagship: every window of the test users, from two points on, against the grid intervals of the corpus users' windows.

    Signatures are z-scored by the corpus. A window's score is its distance to the third neighbour at
    most a depth away; the threshold is the 95th percentile, per depth, of corpus intervals against the
    corpus of other folds.
    """
    with copies.shuffles_dropped(spark):
        c = cut(spark, d).withColumn("t", F.col("t") / 86400)
        test = F.col("source") % 5 == 4
        points, members = copies.kinds(c.where(~test), CHANNELS)
        # Corpus windows that are too short for the grid have no intervals.
        own = copies.kept(copies.dealt(in_folds(members), 3))
        sigs = copies.kept(signature.corpus(points, CHANNELS, 3, 2, True).withColumnRenamed("stream", "kind").join(own, "kind"))
        norm = copies.kept(normalise.fit(sigs, "zscore", copies="copies"))
        known = copies.kept(copies.numbered(normalise.apply(sigs, norm).withColumnRenamed("sig", "z")))
        limits = copies.kept(calibrate.thresholds(calibrate.kind_distances(known, 3, 1), copies="n").select("depth", "threshold"))
        points, members = copies.kinds(c.where(test), CHANNELS)
        points = copies.kept(points)
        width = (F.col("n") - 1) / F.lit(16)
        asked = windows.lengths(points).select("stream", windows.depth_of(width, [0, 1, 2, 3]).alias("depth"), F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
        tests = copies.kept(normalise.apply(signature.prefix_signatures(points, CHANNELS, asked), norm).select(F.col("stream").alias("query"), "depth", "hi", F.col("sig").alias("z")))
    found = knn.nearest_blocked(tests, copies.references(known, "depth", "z", k=3), 3, group="depth", band=1).where("rank = 3")
    found = found.join(tests.select("query", "depth", "hi"), "query").join(limits, "depth").join(members.select("stream", F.col("kind").alias("query")), "query")
    out = found.select("stream", (F.col("hi") + 1).alias("points"), "depth", "distance", "threshold", (F.col("distance") > F.col("threshold")).alias("flagged"))
    return rounded(out, 4, "distance", "threshold")


def split_users(spark, d):
    e = days(spark, d)
    return e.where("stream % 5 <> 4"), e.where("stream % 5 = 4")


@query()
def whitening(spark, d):
    w, _ = metric.create(corpus(spark, d), 0.999)
    return metric.as_table(spark, w).select("component", F.round("scale", 5).alias("scale"), F.size("basis").alias("terms"))


@query()
def score_streams(spark, d):
    return detect(*split_users(spark, d), CHANNELS)["windows"].drop("anomalous")


@query()
def widest_first_search(spark, d):
    return detect(*split_users(spark, d), CHANNELS)["points"]


@query()
def isolation_forest(spark, d):
    c = {"detect": {"method": "isolation_forest", "neighbours": 1}}
    return detect(*split_users(spark, d), CHANNELS, c)["windows"].drop("anomalous")


@query()
def bagged_detector(spark, d):
    """Draws have no default but none; a bagged run has no operating points."""
    c = {"detect": {"bagged": {"draws": 2}}, "evaluate": {"operating_points": None}}
    return detect(*split_users(spark, d), CHANNELS, c)["points"]


@query()
def per_interval_detector(spark, d):
    c = windows.cut_windows(days(spark, d), 16, 17).select("stream", "pos", "t", *CHANNELS, "source")
    side = F.col("source") % 5
    return interval_model.detect(c.where(side != 4), c.where(side == 4), CHANNELS, statistic="p90", withheld=0.2)


def fitted(spark, d):
    """(detector, test streams, settings) at the defaults."""
    from ..config import check
    from . import detect as plan

    c = check({})
    corpus_, test = split_users(spark, d)
    return plan.fit(corpus_, CHANNELS, c), test, c


@query()
def point_scores(spark, d):
    from . import detect as plan

    det, test, c = fitted(spark, d)
    return plan.point_scores(det, test, CHANNELS, c)


@query()
def pooled_detector(spark, d):
    """Anomalous intervals of whole test streams by one threshold for all widths."""
    from . import detect as plan

    return plan.pooled(*split_users(spark, d), CHANNELS, 2.0)


@query()
def threshold_sweep(spark, d):
    """Rates of the whole search at several scales of its thresholds, against the last 21 points of each stream."""
    from . import detect as plan

    det, test, c = fitted(spark, d)
    truth = evaluate.labels_to_failure(test, 20).select(F.col("stream").cast("string").alias("stream"), "pos", "label")
    return rounded(plan.operating_points(det, test, CHANNELS, truth, c), 5, "precision", "recall", "f1", "tpr", "fpr")


@query()
def guarded_search(spark, d):
    """The search by cells, with infinite scores for matches outside the corpus' span."""
    c = {"detect": {"off_manifold": 0.5, "index": {"kind": "cells"}}}
    return detect(*split_users(spark, d), CHANNELS, c)["windows"].drop("anomalous")


@query()
def reduced_search(spark, d):
    """The search over signatures that were reduced to a few terms."""
    c = {"signature": {"normalise": False}, "signature_umap": {"dimension": 3, "rows": 2000}}
    return detect(*split_users(spark, d), CHANNELS, c)["windows"].drop("anomalous")


@query()
def off_manifold(spark, d):
    """Of every corpus interval, the share of its difference to the nearest one of other folds that leaves the span of the intervals of depth 0.

    That span is the first two principal directions, so that something can leave it.
    """
    import numpy as np

    sigs = corpus(spark, d, True).localCheckpoint()
    v = metric.spectrum(sigs.where("depth = 0")).vectors[:2]
    rows = folded(sigs).localCheckpoint()
    refs = rows.withColumnRenamed("query", "ref")
    near = knn.nearest_blocked(rows, refs, 1, group="depth", fold="fold", band=1).select("query", "ref")
    both = near.join(rows.select("query", "z"), "query").join(rows.select(F.col("query").alias("ref"), F.col("z").alias("ref_z")), "ref")

    def shares(batches):
        import pandas as pd

        for b in batches:
            if len(b):
                yield pd.DataFrame({"query": b["query"], "off": knn.off_manifold(np.stack(b["z"].to_numpy()), np.stack(b["ref_z"].to_numpy()), v)})

    return rounded(both.mapInPandas(shares, "query string, off double"), 4, "off")


@query()
def reduce_channels(spark, d):
    return reduce.project_channels(*split_users(spark, d), CHANNELS, 1, context=2, most=2000)[1]


@query()
def reduce_signatures(spark, d):
    out = reduce.project_signatures(corpus(spark, d), 2, most=2000)[0]
    return out.select("stream", "lo", "hi", F.round(F.get("sig", F.lit(0)), 5).alias("u1"), F.round(F.get("sig", F.lit(1)), 5).alias("u2"))


@query()
def trustworthiness(spark, d):
    import numpy as np

    x = reduce.drawn_rows(vectors(spark, d), ["z"], 2000, ["id"])
    p = reduce.fit(x, 2, rounds=50)
    return spark.createDataFrame([(float(round(reduce.trustworthiness(p.ambient, p.latent), 6)), float(np.round(p.fidelity, 6)))], "trustworthiness double, fidelity double")
