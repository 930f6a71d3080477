"""Operators against hand-made cases and NumPy."""

from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirlight import config
from weirlight.operators import bagging, calibrate, copies, evaluate, forest, knn, metric, normalise, reduce, report, scoring, search, signature, streams, transforms, windows
from weirlight.plans import detect as detection


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def walk(spark):
    """Three streams of 40 points with two channels."""
    rng = np.random.default_rng(0)
    data = [(s, p, float(p), *map(float, np.round(rng.normal(size=2), 3))) for s in ("a", "b", "c") for p in range(40)]
    return spark.createDataFrame(data, "stream string, pos int, t double, x1 double, x2 double").cache()


def test_grid_rounds_half_to_even(spark):
    n = spark.createDataFrame([("a", 13), ("b", 17), ("c", 8)], "stream string, n int")
    edges = n.where("stream = 'a'").select(windows.grid_edges(F.col("n"), 3).alias("e")).first()["e"]
    assert edges == [0, 2, 3, 4, 6, 8, 9, 10, 12]
    depths = rows(windows.grid(n, 3).where("stream = 'b'").groupBy("depth").count(), "depth", "count")
    assert depths == [(0, 6), (1, 15), (2, 7), (3, 8)]
    assert windows.grid(n, 3).where("stream = 'c'").count() == 0


def test_windows_share_their_boundary(spark, walk):
    n = windows.lengths(walk)
    assert rows(windows.bounds(n, 16).where("stream = 'a'"), "lo", "hi") == [(0, 16), (16, 32), (32, 39)]
    cut = windows.cut_windows(walk, 16)
    assert rows(cut.groupBy("window").count(), "window", "count") == [(1, 51), (2, 51), (3, 24)]
    back = windows.reassemble(cut.withColumn("flag", F.col("x1") > 0))
    assert back.count() == 120 and back.join(walk, ["stream", "pos"]).where(F.col("flag") != (F.col("x1") > 0)).count() == 0
    assert windows.cut_windows(walk, 16, 9).where("window = 3").count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 18, 33])
def test_cut_windows_are_bounds(spark, n):
    one = spark.range(n).select(F.lit("s").alias("stream"), F.col("id").cast("int").alias("pos"), F.col("id").cast("double").alias("t"))
    cut = rows(windows.cut_windows(one, 16).groupBy("window").agg(F.min("offset"), F.max(F.col("offset") + F.col("pos"))), "window", "min(offset)", "max((offset + pos))")
    assert cut == rows(windows.bounds(windows.lengths(one), 16), "window", "lo", "hi")


def test_merge_and_complement(spark):
    spans = spark.createDataFrame([("s", 0, 16), ("s", 16, 20), ("s", 21, 25), ("s", 30, 31)], "stream string, lo int, hi int")
    assert rows(windows.merge(spans), "lo", "hi") == [(0, 25), (30, 31)]
    clean = spark.createDataFrame([("s", 0, 8), ("s", 12, 16)], "stream string, lo int, hi int")
    n = spark.createDataFrame([("s", 17), ("t", 4)], "stream string, n int")
    assert rows(windows.complement(clean, n), "stream", "lo", "hi") == [("s", 8, 12), ("t", 0, 3)]


def test_search_examples():
    asked = []

    def clean(a, b):
        asked.append((a, b))
        return not a <= 9 <= b

    blocks = search.clean_blocks(0, 16, clean, 4)
    assert blocks == [(0, 8), (12, 16)] and search.uncovered(blocks, 0, 16) == [(8, 12)]
    assert len(asked) == 8 and len(set(asked)) == 6
    assert search.clean_blocks(0, 16, lambda a, b: True, 4) == [(0, 16)]
    asked.clear()
    assert search.clean_blocks(0, 3, clean, 4) == [] and not asked and search.uncovered([], 0, 3) == [(0, 3)]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 24), st.sets(st.integers(0, 23)), st.sampled_from([1, 2, 4]))
def test_search_blocks_are_clean_and_cover(n, bad, floor):
    clean = lambda a, b: not any(a <= x <= b for x in bad)
    blocks = search.clean_blocks(0, n - 1, clean, floor)
    assert all(clean(a, b) and b - a >= floor for a, b in blocks)
    assert all(b <= c for (_, b), (c, _) in zip(blocks, blocks[1:], strict=False))
    covered = {p for a, b in blocks + search.uncovered(blocks, 0, n - 1) for p in range(a, b + 1)}
    assert covered == set(range(n))


def chen(path, depth):
    """Signature by iterated sums over the subdivided path: independent of the kernel."""
    d = path.shape[1]
    steps = np.diff(np.vstack([np.zeros(d), path]), axis=0)
    levels = [np.ones(())] + [np.zeros((d,) * k) for k in range(1, depth + 1)]
    for v in steps:
        new = [levels[0]]
        for k in range(1, depth + 1):
            total = np.zeros((d,) * k)
            power = np.ones(())
            for i in range(k + 1):
                total = total + np.multiply.outer(levels[k - i], power)
                power = np.multiply.outer(power, v) / (i + 1)
            new.append(total)
        levels = new
    return np.concatenate([x.ravel() for x in levels[1:]])


def test_signatures_agree(spark, walk):
    spans = spark.createDataFrame([("a", 0, 39), ("b", 3, 20), ("c", 5, 5)], "stream string, lo int, hi int")
    pdf = walk.toPandas()
    for depth, found in ((1, signature.signatures(walk, ["x1", "x2"], spans, 1)), (2, signature.signatures(walk, ["x1", "x2"], spans, 2)), (2, signature.prefix_signatures(walk, ["x1", "x2"], spans)), (3, signature.deep_signatures(walk, ["x1", "x2"], spans, 3))):
        for r in found.collect():
            p = pdf[(pdf.stream == r["stream"]) & pdf.pos.between(r["lo"], r["hi"])].sort_values("pos")[["t", "x1", "x2"]].to_numpy()
            assert np.allclose(r["sig"], chen(p, depth), rtol=1e-9, atol=1e-7), (depth, r["stream"])


def test_composed_signatures_are_direct_ones():
    x = np.random.default_rng(1).normal(size=(20, 3))
    fast, exact = signature.Signer(x, 3, exact=False), signature.Signer(x, 3)
    for lo, hi in ((0, 19), (3, 9), (4, 5), (7, 7)):
        assert np.allclose(fast(lo, hi), exact(lo, hi))
    assert signature.truncation_of(3, 39) == 3 and signature.term_levels(2, 2) == [1, 1, 2, 2, 2, 2]
    with pytest.raises(ValueError):
        signature.truncation_of(3, 40)


def test_lead_lag_keeps_the_series_and_its_variation(spark, walk):
    doubled = transforms.lead_lag(walk.where("stream = 'a'"), ["x1"]).orderBy("pos").toPandas()
    x = walk.where("stream = 'a'").orderBy("pos").toPandas()["x1"].to_numpy()
    assert len(doubled) == 79 and np.allclose(doubled["x1"][::2], x)
    lead, lag = doubled["x1"].to_numpy(), doubled["x1_lag"].to_numpy()
    area = 0.5 * np.sum((lead[:-1] - lead[0]) * np.diff(lag) - (lag[:-1] - lag[0]) * np.diff(lead))
    assert np.isclose(abs(area), 0.5 * np.sum(np.diff(x) ** 2))
    with pytest.raises(ValueError):
        transforms.lagged(walk, ["x1"], 2, "lead_lag")


def test_screening_drops_whole_streams(spark):
    data = [("nan", 0, 0.0, float("nan")), ("nan", 1, 1.0, 1.0), ("inf", 0, 0.0, float("-inf")), ("ok", 0, 0.0, 1.0), ("null", 0, 0.0, None)]
    df = spark.createDataFrame(data, "stream string, pos int, t double, x double")
    clean, found = streams.screen(df, ["x"])
    assert rows(clean, "stream") == [("ok",)]
    assert rows(found, "stream", "reason", "rows", "columns") == [("inf", "inf", 1, "x"), ("nan", "nan", 1, "x"), ("null", "nan", 1, "x")]


def test_nested_round_trip(spark, walk):
    back = streams.unnest(streams.nest(walk, ["x1", "x2"]), ["x1", "x2"])
    assert rows(back, "stream", "pos", "t", "x1", "x2") == rows(walk, "stream", "pos", "t", "x1", "x2")
    with pytest.raises(Exception, match="number of channels"):
        streams.unnest(streams.nest(walk, ["x1", "x2"]), ["x1"]).collect()


def test_matrix_profile_forms_agree(spark, walk):
    one = {(r["stream"], r["pos"]): r["profile"] for r in transforms.matrix_profile(walk, ["x1"], 6).where("profile is not null").collect()}
    two = {(r["stream"], r["pos"]): r["profile"] for r in transforms.matrix_profile_joined(walk, "x1", 6).collect()}
    assert one.keys() == two.keys() and all(np.isclose(one[k], two[k], atol=1e-6) for k in one)


def test_knn_forms_agree(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(v) for v in rng.normal(size=5)], i % 3) for i in range(60)]
    v = spark.createDataFrame(data, "id int, z array<double>, fold int")
    q, r = v.withColumnRenamed("id", "query"), v.withColumnRenamed("id", "ref")
    joined = knn.nearest_joined(q.select("query", "z"), r.select("ref", "z"), 3)
    blocked = knn.nearest_blocked(q, r, 3)
    assert rows(joined, "query", "ref", "rank") == rows(blocked, "query", "ref", "rank")
    apart = knn.nearest_blocked(q, r, 1, fold="fold")
    assert apart.join(v.select(F.col("id").alias("query"), "fold"), "query").join(v.select(F.col("id").alias("ref"), F.col("fold").alias("f2")), "ref").where("fold = f2").count() == 0
    old, knn.BLOCK_VALUES = knn.BLOCK_VALUES, 100
    try:
        assert rows(knn.nearest_blocked(q, r, 3), "query", "ref", "rank") == rows(joined, "query", "ref", "rank")
    finally:
        knn.BLOCK_VALUES = old


def test_metric_whitens(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 6))
    sigs = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, sig array<double>").repartition(24)
    spec = metric.spectrum(sigs, fan_in=4)
    assert np.allclose(spec.values[:4], np.linalg.svd(x - x.mean(0), compute_uv=False)[:4])
    w, found = metric.create(sigs, variance_keep=None)
    assert found["rank"] == 4 and np.allclose(np.cov(w.apply(x).T, ddof=0), np.eye(4), atol=1e-8)
    metric.check_is_whitening(spec, w)
    with pytest.raises(ValueError):
        metric.check_is_whitening(spec, metric.Whitening(w.basis, w.scale**2))
    back = metric.from_table(metric.as_table(spark, w))
    assert np.allclose(back.apply(x), w.apply(x))
    p = metric.whitening(spec, None, None, "pinv")
    assert np.allclose(np.linalg.norm(p.apply(x[1:] - x[:-1]), axis=1), np.linalg.norm(w.apply(x[1:] - x[:-1]), axis=1))
    v = metric.numerical_subspace(spec)
    assert np.allclose(knn.off_manifold(x, x[::-1], v), 0, atol=1e-6) and knn.off_manifold(x + np.linalg.svd(x)[2][5], x, v).min() > 0.9


def test_thresholds_and_folds(spark):
    d = spark.createDataFrame([(i, i % 2, float(i)) for i in range(100)], "query int, depth int, distance double")
    for r in calibrate.thresholds(d, "p90").collect():
        values = np.arange(r["depth"], 100, 2)
        assert np.isclose(r["threshold"], np.percentile(values, 90)) and r["n_above_threshold"] == (values > np.percentile(values, 90)).sum()
    assert calibrate.threshold_at({0: 1.0, 2: 3.0}, 1) == 1.0
    dealt = calibrate.shuffled_folds(list("abcdefg"), 3, 0)
    assert sorted(np.bincount(list(dealt.values()))) == [2, 2, 3]
    with pytest.raises(ValueError):
        calibrate.shuffled_folds(["a"], 2, 0)
    with pytest.raises(ValueError):
        calibrate.quantile("mean")


def test_range_recall_falls_with_the_level(spark):
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([("s", p, bool(10 <= p < 20 or 40 <= p < 44), bool(rng.random() < 0.3)) for p in range(60)], "stream string, pos int, label boolean, flag boolean")
    recall = [r["recall"] for r in evaluate.range_metrics(pts).orderBy("level").collect()]
    assert recall == sorted(recall, reverse=True)
    assert all(k in evaluate.evaluate(pts) for k in ("f1", "adjusted_f1", "flag_all_f1", "ad4_recall"))


def test_ranking_counts_ties_half(spark):
    rng = np.random.default_rng(5)
    y, s = rng.random(300) < 0.3, np.round(rng.normal(size=300), 1)
    pts = spark.createDataFrame([("s", i, bool(a), float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "stream string, pos int, label boolean, score double")
    pairs = (s[y][:, None] > s[~y]).mean() + 0.5 * (s[y][:, None] == s[~y]).mean()
    assert np.isclose(evaluate.ranking(pts).first()["roc_auc"], pairs)
    assert evaluate.ranking(pts.withColumn("label", F.lit(True))).count() == 0


def test_forest_isolates_outliers(spark):
    rng = np.random.default_rng(6)
    data = [(i, 0, [float(v) for v in (rng.normal(size=3) if i else np.full(3, 9.0))]) for i in range(300)]
    df = spark.createDataFrame(data, "query int, depth int, z array<double>")
    scored = forest.score(df, forest.fit(df, trees=30, sample=64))
    assert scored.orderBy(F.desc("score")).first()["query"] == 0
    assert scored.agg(F.min("score"), F.max("score")).first()[0] > 0


def test_bagging_votes(spark):
    assert bagging.subset_size(38) == 6 and bagging.subset_size(2, 5) == 2
    flags = spark.createDataFrame([("s", 0, 0, True), ("s", 0, 1, True), ("s", 1, 0, False), ("s", 1, 1, True)], "stream string, pos int, draw int, flag boolean")
    assert rows(bagging.count_votes(flags, 2), "pos", "votes", "flag", "point_score") == [(0, 2, True, 1.0), (1, 1, False, 0.5)]


def test_projection_keeps_fitted_rows():
    x = np.random.default_rng(7).normal(size=(80, 5))
    p = reduce.fit(x, 2, rounds=20)
    assert np.allclose(p.transform(x), p.latent) and 0 <= reduce.trustworthiness(p.ambient, p.latent) <= 1


def test_scored_set_counts_shared_points_once(spark):
    found = spark.createDataFrame([("s", 17, [(0, 8)], [(8, 12, 1, 2.0, 1.0, False), (12, 16, 1, 3.0, 1.0, False)], 5)], scoring.VERDICT.format(kind="string"))
    r = scoring.scored_set(found).first()
    assert (r["n_anomalous_intervals"], r["n_anomalous_points"], r["max_score"]) == (2, 9, 3.0)


def test_config_rules():
    assert config.check({})["detect"]["neighbours"] == 3
    assert config.override("detect.neighbours=1") == {"detect": {"neighbours": 1}}
    for bad in ({"window": {"size": 12}}, {"detect": {"method": "isolation_forest"}}, {"detect": {"bagged": {"draws": 3}}}, {"preprocess": {"lag": 2, "lag_method": "lead_lag"}}):
        with pytest.raises(ValueError):
            config.check(bad)


def test_report_escapes(spark):
    page = report.build("t", [("a", {"x": {"y": 1.5}}), ("b", spark.createDataFrame([("<i>",)], "v string"))])
    assert "x.y" in page and "&lt;i&gt;" in page
    recorder = report.Recorder()
    with recorder.stage("outer"), recorder.stage("inner"):
        pass
    assert {r["stage"] for r in recorder.rows} == {"outer", "inner"}


def test_pairs_of_candidates():
    assert search.candidates(4, 2) == [p for p in combinations(range(4), 2) if p[1] - p[0] >= 2]


def test_smallest_of_wide_rows():
    d = np.round(np.random.default_rng(8).random((20, 5003)), 3)
    order = np.argsort(d, 1, kind="stable")[:, :3]
    columns, values = knn.smallest(d, 3)
    assert (values == np.take_along_axis(d, order, 1)).all() and (columns == order).all()


def test_per_interval_model_in_blocks_of_normal_streams(spark, monkeypatch):
    from weirlight.operators import interval_model

    rng = np.random.default_rng(8)
    data = [(f"{s:02d}", p, float(p), *map(float, rng.normal(size=2) + (20 if s == 41 and p > 8 else 0))) for s in range(44) for p in range(17)]
    df = spark.createDataFrame(data, "stream string, pos int, t double, x1 double, x2 double").cache()
    normal, test = df.where("stream < '40'"), df.where("stream >= '40'")
    one = lambda: rows(interval_model.detect(normal, test, ["x1", "x2"], statistic="p90", withheld=1.0), "stream", "start_index", "end_index", F.round("score", 6), F.round("threshold", 6))
    whole = one()
    assert any(r[0] == "41" and r[2] > 8 for r in whole)
    monkeypatch.setattr(interval_model, "BLOCK_BYTES", 17 * 3 * 8 * 10)
    held = interval_model.normal_blocks(normal, ["t", "x1", "x2"])
    assert len(held) > 1 and sum(len(b.value) for b in held) == 40
    assert one() == whole
    model = lambda room: interval_model.IntervalModel(normals(room), 2, 9, 0.999, "p90", 1.0, 0)

    def normals(room):
        n = interval_model.Normal([lambda b=b: b.value for b in held], 2)
        n.room = room
        return n

    kept, made = model(1 << 20), model(0)
    assert kept.kept is not None and made.kept is None and kept.threshold == made.threshold


def test_cells_find_nine_tenths_of_the_neighbours(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(2000, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(z)], "id long, z array<double>").cache()
    queries, refs = df.where("id % 20 = 0").withColumnRenamed("id", "query"), df.withColumnRenamed("id", "ref")
    found = {(r["query"], r["ref"]) for r in knn.nearest_in_cells(queries, refs, 4).collect()}
    d = knn.distances(z[::20], z)
    true = {(20 * k, int(r)) for k, row in enumerate(d) for r in np.argsort(row)[1:4]}
    assert len(true & found) >= 0.9 * len(true)


def test_every_setting_is_read():
    source = "".join(p.read_text() for p in Path(config.__file__).parent.rglob("*.py") if p.name != "config.py" and "llm" not in p.parts)

    def leaves(part):
        for key, value in part.items():
            yield key
            if isinstance(value, dict):
                yield from leaves(value)

    floors = Path(config.__file__).read_text().split("def floor")[1]
    unread = [k for k in leaves(config.DEFAULTS) if f'["{k}"]' not in source + floors and f'.get("{k}"' not in source]
    assert not unread


def test_settings_of_indexes_are_checked():
    for text in ("detect.index.kind=other", "detect.index.nprobe=0", "detect.index.tables=0", "detect.off_manifold=1.5", "signature_umap.dimension=0"):
        with pytest.raises(ValueError):
            config.check(config.merged({"signature": {"normalise": False}}, config.override(text)))
    assert config.check(config.override("detect.off_manifold=null")) == config.check({})


def plain_segments(lo, hi, clean, width, step_least):
    """Clean blocks by the rule as stated: halves, left first; steps halve when they fail or leave the region."""

    def longest(a, b):
        if b - a < width:
            return None
        if clean(a, b):
            return a, b
        middle = (a + b) // 2
        return None if b - a == 1 else longest(a, middle) or longest(middle, b)

    if hi <= lo or (block := longest(lo, hi)) is None:
        return []
    a, b = block
    for side in (-1, 1):
        step = 1
        while 2 * step <= max((b - a) // 2, 1):
            step *= 2
        step = max(step, step_least)
        while step >= step_least:
            x, y = (a - step, b) if side < 0 else (a, b + step)
            if lo <= x and y <= hi and clean(x, y):
                a, b = x, y
            else:
                step //= 2
    return sorted([(a, b), *plain_segments(lo, a, clean, width, step_least), *plain_segments(b, hi, clean, width, step_least)])


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 30), st.integers(0, 2**31), st.sampled_from([1, 2, 4]), st.sampled_from([None, 1, 2, 4, 8]), st.floats(0.05, 0.95))
def test_search_by_the_rule(n, seed, floor, step, share):
    table = np.random.default_rng(seed).random((n, n)) < share
    clean = lambda a, b: bool(table[a, b])
    assert search.clean_blocks(0, n - 1, clean, floor, step) == plain_segments(0, n - 1, clean, floor, step or floor)


def test_steps_over_the_limit_are_halved():
    assert (5, 15) in search.clean_blocks(0, 16, lambda a, b: not a <= 3 <= b, 2)
    assert search.widen(6, 8, 5, -1, lambda a, b: True, 2) == 6 and search.widen(6, 8, 5, -1, lambda a, b: True, 1) == 5
    assert config.floor(config.check({"detect": {"tol": 1}})) == 4 and config.step_floor(config.check({"detect": {"tol": 1}})) == 2 and config.step_floor(config.check({})) == 4


def test_blocks_of_neighbours_are_merged(spark, monkeypatch):
    rng = np.random.default_rng(11)
    data = [(f"r{i:03d}", [float(v) for v in rng.integers(-9, 9, 3)], int(rng.integers(0, 3)), int(rng.integers(0, 2))) for i in range(300)]
    refs = spark.createDataFrame(data, "ref string, z array<double>, depth int, fold int").cache()
    queries = refs.withColumnRenamed("ref", "query").where("query < 'r100'")
    z, depth, fold = np.array([d[1] for d in data]), np.array([d[2] for d in data]), np.array([d[3] for d in data])
    distance = ((z[:, None] - z[None]) ** 2).sum(-1)
    for values, pairs in ((8_000_000, 10**9), (60, 500)):
        monkeypatch.setattr(knn, "BLOCK_VALUES", values)
        monkeypatch.setattr(knn, "TASK_PAIRS", pairs)
        for options, allowed in (({}, np.ones((300, 300), bool)), ({"group": "depth", "fold": "fold"}, (depth[:, None] == depth) & (fold[:, None] != fold)), ({"skip_self": True}, ~np.eye(300, dtype=bool))):
            found = {}
            for r in knn.nearest_blocked(queries, refs, 2, **options).collect():
                found.setdefault(r["query"], []).append((r["rank"], r["ref"], round(r["distance"], 9)))
            for i in range(100):
                order = sorted((round(distance[i, j], 9), data[j][0]) for j in range(300) if allowed[i, j])[:2]
                assert sorted(found[data[i][0]]) == [(k + 1, name, d) for k, (d, name) in enumerate(order)]
    assert knn.nearest_blocked(queries.limit(0), refs, 2).count() == knn.nearest_blocked(queries, refs.limit(0), 2).count() == 0


def test_neighbours_by_regions(spark, monkeypatch):
    """As by brute force, with copies, queries out of reach, other folds and bands; pairs do not decide how often a row is sent."""
    rng = np.random.default_rng(21)
    z = np.r_[rng.normal(size=(500, 2)) @ rng.normal(size=(2, 4)), np.tile(rng.normal(size=4), (100, 1))].round(3)
    z[:5] += 50
    depth, fold = np.r_[rng.integers(0, 4, 599), 9], rng.integers(0, 3, 600)
    data = [(f"r{i:03d}", [float(v) for v in z[i]], int(depth[i]), int(fold[i])) for i in range(600)]
    refs = spark.createDataFrame([*data, ("none", data[0][1], None, 0)], "ref string, z array<double>, depth int, fold int").cache()
    queries = refs.withColumnRenamed("ref", "query")
    monkeypatch.setattr(knn, "TASK_PAIRS", 1)
    distance = ((z[:, None] - z[None]) ** 2).sum(-1)
    near = lambda band: abs(depth[:, None] - depth[None]) <= band
    apart = fold[:, None] != fold[None]
    for values, sample in ((300, 120), (120, 10**6)):
        monkeypatch.setattr(knn, "REGION_VALUES", values)
        monkeypatch.setattr(knn, "SAMPLE_VALUES", sample)
        for options, allowed in (({"group": "depth", "fold": "fold", "band": 1}, near(1) & apart), ({"group": "depth"}, near(0)), ({"fold": "fold"}, apart)):
            asked = queries.where("depth is not null") if "group" not in options else queries
            given = refs.where("depth is not null") if "group" not in options else refs
            found = {}
            result = knn._in_regions(asked, given, 3, options.get("group"), options.get("fold"), options.get("band", 0))
            for r in result.collect():
                found.setdefault(r["query"], []).append((r["rank"], r["ref"], round(r["distance"], 9)))
            for i in range(600):
                order = sorted((round(distance[i, j], 9), data[j][0]) for j in np.flatnonzero(allowed[i]))[:3]
                assert sorted(found.pop(data[i][0], [])) == [(n + 1, name, d) for n, (d, name) in enumerate(order)]
            assert not found
    assert knn.nearest_blocked(queries.limit(0), refs, 2, band=1, group="depth").count() == knn.nearest_blocked(queries, refs.limit(0), 2, band=1, group="depth").count() == 0


def test_hashed_search_sends_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(22)
    refs = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=6)]) for i in range(500)], "ref long, z array<double>").cache()
    queries = refs.withColumnRenamed("ref", "query").where("query % 25 = 0")
    exact = {(r["query"], r["ref"]) for r in knn.nearest_joined(queries, refs, 3).collect()}
    monkeypatch.setattr(knn, "BLOCK_VALUES", 1000)
    found = knn.nearest_hashed(queries, refs, 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert len({(r["query"], r["ref"]) for r in found.collect()} & exact) >= 0.9 * len(exact) == 54


def test_normal_streams_come_as_columns(spark, monkeypatch):
    """They are not collected as Python's rows, and blocks are in order of stream and position."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from weirlight.operators import interval_model

    rows_ = [(f"s{i}", p, float(i), float(p)) for i in range(12) for p in range(5)]
    df = spark.createDataFrame(rows_[::-1], "stream string, pos int, a double, b double")
    monkeypatch.setattr(Classic, "toPandas", lambda self: pytest.fail("collected as rows"))
    for most in (1 << 20, 5 * 2 * 8 * 4):
        monkeypatch.setattr(interval_model, "BLOCK_BYTES", most)
        blocks = [b.value for b in interval_model.normal_blocks(df, ["a", "b"])]
        assert (len(blocks) == 1) == (most > 1000) and sorted(b[0, 0] for x in blocks for b in x) == [float(i) for i in range(12)]
        assert all((x[:, :, 1] == np.arange(5)).all() and (x[:, :, 0] == x[:, :1, 0]).all() for x in blocks)


def test_indexes_by_group_agree_with_exact_search(spark):
    rng = np.random.default_rng(15)
    data = [(i, [float(v) for v in rng.normal(size=6)], i % 2) for i in range(800)]
    refs = spark.createDataFrame(data, "ref long, z array<double>, depth int").cache()
    queries = refs.withColumnRenamed("ref", "query").where("query % 20 = 0")
    exact = {(r["query"], r["ref"]) for r in knn.nearest("exact", queries, refs, 3, "depth").collect()}
    assert len(exact) == 120
    for kind in ("cells", "hashed"):
        found = knn.nearest(kind, queries, refs, 3, "depth").collect()
        assert len({(r["query"], r["ref"]) for r in found} & exact) / len(exact) >= 0.9
        assert all(r["query"] % 2 == r["ref"] % 2 for r in found)
    with pytest.raises(ValueError):
        knn.nearest("other", queries, refs, 3)


def test_folds_are_balanced_and_seeded(spark):
    names = spark.createDataFrame([(f"s{i}_{w}",) for i in range(103) for w in (1, 2)], "stream string")
    dealt = {r["stream"]: r["fold"] for r in calibrate.folds(names, 5, True, 1).collect()}
    sizes = np.bincount([dealt[f"s{i}_1"] for i in range(103)])
    assert sorted(sizes) == [20, 20, 21, 21, 21] and all(dealt[f"s{i}_1"] == dealt[f"s{i}_2"] for i in range(103))
    assert dealt == {r["stream"]: r["fold"] for r in calibrate.folds(names, 5, True, 1).collect()}
    assert dealt != {r["stream"]: r["fold"] for r in calibrate.folds(names, 5, True, 2).collect()}
    few = spark.createDataFrame([("a", 0, 0, [1.0]), ("b", 0, 1, [2.0])], "query string, depth int, fold int, z array<double>")
    assert calibrate.fold_distances(few, 1).count() == 2
    with pytest.raises(Exception, match="fewer than 2 neighbours"):
        calibrate.fold_distances(few, 2).collect()


def test_forest_band_takes_in_near_depths(spark):
    rng = np.random.default_rng(16)
    data = [(i, i % 4, [float(v) for v in rng.normal(size=2)]) for i in range(400)]
    df = spark.createDataFrame(data, "query long, depth int, z array<double>")
    drawn = lambda band: {r["depth"]: r["m"] for r in forest.fit(df, 3, 1000, 0, band).groupBy("depth").agg(F.max("drawn").alias("m")).collect()}
    assert drawn(0) == {d: 100 for d in range(4)} and drawn(1) == {0: 200, 1: 300, 2: 300, 3: 200}


def test_copies_are_compared_once(spark):
    """Of copies those references stay that a query of some fold can have among its nearest; equal queries are one."""
    rng = np.random.default_rng(23)
    z = np.repeat(rng.normal(size=(40, 3)), 30, 0)
    n, k = len(z), 3
    fold, g = rng.integers(0, 4, n), np.zeros(n, np.int64)
    rule = knn._Rule(np.zeros(1, np.int64), np.arange(4), 0)
    left = pa.table({"ref": [f"r{i:05d}" for i in range(n)], "z": pa.array(list(z), pa.list_(pa.float64())), "g": g, "f": fold})
    block, names = knn._references(left, rule, k)
    assert len(names) < n / 2
    row, place, _ = block.nearest(z, g, fold, k, np.full(n, np.inf))
    distance = ((z[:, None] - z[None]) ** 2).sum(-1)
    distance[fold[:, None] == fold[None]] = np.inf
    right = np.argsort(distance, 1, kind="stable")[:, :k]
    for i in range(n):
        assert [names[int(p)].as_py() for p in place[row == i]] == [f"r{j:05d}" for j in right[i]]
    order, starts = knn._alike(z, g, fold)
    assert sorted(order) == list(range(n)) and len(starts) == len({(i // 30, f) for i, f in enumerate(fold)})


def test_distances_for_thresholds_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(len(b))
            yield b

    found = calibrate.thresholds(spark.range(200).selectExpr("cast(id % 2 as int) depth", "cast(id as double) distance").mapInPandas(rows, "depth int, distance double"))
    assert sorted((r["depth"], r["n_calibration"], r["n_above_threshold"]) for r in found.collect()) == [(0, 100, 5), (1, 100, 5)]
    assert made.value == 200


@pytest.mark.parametrize("width", [3, 40, 2000, 20_000])
def test_smallest_sorts_only_what_it_returns(width, monkeypatch):
    """As by a whole stable sort, with ties, infinite values and NaN; whole rows are sorted only where the k-th value is a tie."""
    rng = np.random.default_rng(24)
    d = rng.normal(size=(30, width))
    d[10:20], d[20, :], d[21, 1:], d[22, 0] = d[10:20].round(1), 5.0, np.inf, np.nan
    assert (knn.smallest(d[:22], 4)[0] == np.argsort(d[:22], 1, kind="stable")[:, :4]).all()
    if width <= 2000:
        assert (knn.smallest(d, 4)[0] == np.argsort(d, 1, kind="stable")[:, :4]).all()
    widest, sort = [], np.argsort
    monkeypatch.setattr(knn.np, "argsort", lambda a, *more, **how: widest.append(a.shape[1] if len(a) else 0) or sort(a, *more, **how))
    knn.smallest(rng.normal(size=(30, width)), 4)
    assert width in (3, 20_000) or max(widest) == 4


def test_streams_of_equal_points_are_one_kind(spark):
    """Nulls at different places are different; every stream is a member of the kind of its first."""
    rng = np.random.default_rng(25)
    paths = [[(float(i), *map(float, rng.normal(size=2))) for i in range(5)] for _ in range(3)]
    paths += [[(0.0, None, 1.0), (1.0, 1.0, 1.0)], [(0.0, 1.0, None), (1.0, 1.0, 1.0)], paths[0][:4]]
    data = [(f"s{10 * c + p}", i, *x) for p, path in enumerate(paths) for c in range(1, 4) for i, x in enumerate(path)]
    df = spark.createDataFrame(data, "stream string, pos int, t double, x1 double, x2 double")
    points, members = copies.kinds(df, ["x1", "x2"])
    assert {(r["stream"], r["kind"]) for r in members.collect()} == {(f"s{10 * c + p}", f"s{10 + p}") for c in range(1, 4) for p in range(6)}
    assert sorted((r["stream"], r["pos"]) for r in points.collect()) == sorted((s, i) for s, i, *_ in data if int(s[1:]) < 20)


def test_kinds_have_the_distances_and_thresholds_of_all_copies(spark):
    rng = np.random.default_rng(26)
    z = rng.normal(size=(60, 3))
    count = rng.integers(1, 8, 60)
    names = [(f"w{10 * i + c}_1", f"w{10 * i}_1", int(rng.integers(0, 3))) for i in range(60) for c in range(count[i])]
    members = spark.createDataFrame(names, "stream string, kind string, fold int")
    rows = spark.createDataFrame([(f"w{10 * i}_1", 0, 4, i % 2, [float(v) for v in z[i]]) for i in range(60)], "kind string, lo int, hi int, depth int, z array<double>")
    found = calibrate.kind_distances(rows.join(copies.dealt(members, 3), "kind").persist(), 3, 0).persist()
    all_rows = rows.join(members, "kind").select(copies.name_of("stream").alias("query"), "depth", "fold", "z").persist()
    want = calibrate.fold_distances(all_rows, 3, 0).persist()
    ours = {r["query"]: r["distance"] for r in found.join(members, ["kind", "fold"]).select(copies.name_of("stream").alias("query"), "distance").collect()}
    theirs = {r["query"]: r["distance"] for r in want.collect()}
    assert ours.keys() == theirs.keys() and all(abs(ours[q] - theirs[q]) < 1e-9 for q in ours)
    assert found.count() < want.count() and 0 < sum(d == 0 for d in ours.values()) < len(ours)
    a, b = (calibrate.thresholds(*x).orderBy("depth").toPandas() for x in ((found, "p90", "n"), (want, "p90")))
    assert np.allclose(a, b)
    refs = {(r["ref"], r["fold"]) for r in copies.references(rows.join(copies.dealt(members, 3), "kind"), "z", k=3).collect()}
    firsts = {}
    for s, k, f in sorted(names, key=lambda x: x[0] + ":"):
        firsts.setdefault(k, []).append((f"{s}:0:4", f))
    assert refs == {x for some in firsts.values() for x in some[:3]}


def test_statistics_count_copies(spark):
    rng = np.random.default_rng(27)
    x, n = rng.normal(size=(200, 4)) * [1, 5, 0.1, 2] + 3, rng.integers(1, 9, 200)
    df = spark.createDataFrame([([float(v) for v in row], int(c)) for row, c in zip(x, n, strict=True)], "sig array<double>, copies int")
    whole = np.repeat(x, n, 0)
    spec = metric.spectrum(df, copies="copies")
    assert spec.n == len(whole) and np.allclose(spec.mean, whole.mean(0)) and np.allclose(spec.values, np.linalg.svd(whole - whole.mean(0), compute_uv=False))
    for method, scale in (("zscore", whole.std(0)), ("maxabs", abs(whole).max(0))):
        found = normalise.fit(df, method, copies="copies").first()
        assert np.allclose(found["scale"], scale) and np.allclose(found["centre"], whole.mean(0) if method == "zscore" else 0)


def test_trees_draw_each_copy_alike():
    """Without a row, or a hash, for each tree: a table of n rows costs about as many draws as it has drawn rows."""
    h = np.random.default_rng(28).integers(-(2**63), 2**63 - 1, 20_000)
    row, cell = forest.drawn_cells(h, np.full(len(h), 200), np.full(len(h), 0.003))
    assert abs(len(row) - 12_000) < 600 and len(set(zip(row.tolist(), cell.tolist(), strict=True))) == len(row)
    assert abs(np.bincount(cell, minlength=200) - 60).max() < 40 and cell.max() < 200
    row, cell = forest.drawn_cells(h[:5], np.full(5, 7), np.full(5, 2.0))
    assert sorted(zip(row.tolist(), cell.tolist(), strict=True)) == [(r, c) for r in range(5) for c in range(7)]


def test_all_cells_are_all_neighbours_in_a_band(spark, monkeypatch):
    """A query that looks at all cells finds what an exact search does, with units of cells that are dealt to several tasks."""
    rng = np.random.default_rng(29)
    z, depth = rng.normal(size=(400, 3)), rng.integers(0, 4, 400)
    refs = spark.createDataFrame([(f"r{i}", int(g), [float(v) for v in x]) for i, (x, g) in enumerate(zip(np.repeat(z, 2, 0), np.repeat(depth, 2), strict=True))], "ref string, depth int, z array<double>")
    queries = spark.createDataFrame([(f"q{i}", int(depth[i]), [float(v) + 0.1 for v in z[i]]) for i in range(90)], "query string, depth int, z array<double>")
    monkeypatch.setattr(knn, "REGION_VALUES", 150)
    monkeypatch.setattr(knn, "FITTED", 300)
    found = {(r["query"], r["ref"], r["rank"]) for r in knn.nearest_in_cells(queries, refs, 3, 10_000, group="depth", band=1).collect()}
    want = {(r["query"], r["ref"], r["rank"]) for r in knn.nearest_joined(queries, knn.banded(refs, 1).drop("depth").withColumnRenamed("probe", "depth"), 3, "depth").collect()}
    assert found == want and len(want) == 270


def test_kth_distances_take_turns(spark, monkeypatch):
    """The distances of all pairs, by regions, with several turns, blocks and equal rows; a query with too few neighbours has no row."""
    rng = np.random.default_rng(30)
    z, depth, fold = np.repeat(rng.normal(size=(200, 3)), 3, 0), rng.integers(0, 5, 600), rng.integers(0, 3, 600)
    depth[:2] = 40
    data = [(i, f"r{i}", int(g), int(f), [float(v) for v in x]) for i, (x, g, f) in enumerate(zip(z, depth, fold, strict=True))]
    df = spark.createDataFrame(data, "query long, ref string, depth int, fold int, z array<double>").cache()
    refs, queries = df.drop("query"), df.drop("ref")
    distance = ((z[:, None] - z[None]) ** 2).sum(-1)
    near = lambda band: abs(depth[:, None] - depth[None]) <= band
    apart = fold[:, None] != fold[None]
    turns = []
    monkeypatch.setattr(copies, "kept", lambda x, kept=copies.kept: turns.append(1) or kept(x))
    monkeypatch.setattr(knn, "PACK_BYTES", 200)
    for values, sample in ((300, 120), (120, 10**6)):
        monkeypatch.setattr(knn, "REGION_VALUES", values)
        monkeypatch.setattr(knn, "SAMPLE_VALUES", sample)
        for options, allowed in (({"group": "depth", "fold": "fold", "band": 1}, near(1) & apart), ({"group": "depth"}, near(0)), ({"fold": "fold"}, apart)):
            turns.clear()
            found = {r["query"]: r["distance"] for r in knn.kth_distances(queries, refs, 3, **options).collect()}
            want = {i: np.sort(distance[i, allowed[i]])[2] for i in range(600) if allowed[i].sum() > 2}
            assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want)
            assert len(want) == (600 if options == {"fold": "fold"} else 598) and len(turns) > 1
    monkeypatch.undo()
    found = {r["query"]: r["distance"] for r in knn.kth_distances(queries, refs, 3, "depth").collect()}
    assert found.keys() == set(range(2, 600)) and all(abs(found[i] - np.sort(distance[i, near(0)[i]])[2]) < 1e-9 for i in found)


def test_screening_reads_streams_once(spark, walk):
    """A join with the report would deal all points out once more."""
    clean = streams.screen(walk, ["x1", "x2"])[0]
    assert "Join" not in clean._jdf.queryExecution().executedPlan().toString()


def test_point_scores_are_made_when_asked_for(spark, walk, monkeypatch):
    """They are a search of their own, of which a query of windows has nothing."""
    made = []
    monkeypatch.setattr(detection, "fit", lambda *_: detection.Detector(walk, None, {0: 1.0}, walk, None, None, {}))
    monkeypatch.setattr(detection, "_flags", lambda *_: (walk, walk))
    monkeypatch.setattr(detection, "point_scores", lambda *_: made.append(1) or walk)
    found = detection.detect(walk, walk, ["x1", "x2"])
    assert not made and "point_scores" in found
    assert found["point_scores"] is found["point_scores"] is walk and made == [1]


def test_kept_tables_leave_no_garbage_in_the_driver(spark):
    jvm = spark.sparkContext._jvm
    row = jvm.java.lang.Object()
    still = jvm.java.lang.ref.WeakReference(row)
    jvm.System.gc()  # it is old from here on, and goes when the whole heap is collected
    spark.sparkContext._gateway.detach(row)
    del row
    assert copies.kept(spark.range(3)).count() == 3
    assert still.get() is None


def test_per_interval_model_signs_equal_streams_once_and_counts_them_all(spark):
    from weirlight.operators import interval_model

    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 17, 3)).cumsum(1)
    times = rng.integers(1, 4, 30)
    whole = interval_model.IntervalModel(interval_model.Normal([lambda: np.repeat(x, times, 0)], 2), 2, 9, 0.999, "p90", 0.5, 0)
    parts = [slice(0, 13), slice(13, 30)]
    few = interval_model.IntervalModel(interval_model.Normal([lambda p=p: x[p] for p in parts], 2, [times[p] for p in parts]), 2, 9, 0.999, "p90", 0.5, 0)
    assert sum(map(len, few.kept)) == 30 and few.threshold == pytest.approx(whole.threshold, abs=1e-9)
    sig = signature.sign(rng.normal(size=(1, 8, 3)), 2)[0]
    assert few.score(sig) == pytest.approx(whole.score(sig))
    data = [(f"{c}{s:02d}", p, float(p), float(x[s, p, 1]) + (20 if s > 27 and p > 8 else 0)) for c in "ab" for s in range(30) for p in range(17)]
    df = spark.createDataFrame(data, "stream string, pos int, t double, x1 double")
    side = F.substring("stream", 2, 2) >= "26"
    found = interval_model.detect(df.where(~side), df.where(side), ["x1"], statistic="p90", withheld=1.0)
    a, b = (rows(found.where(F.col("stream").startswith(c)), F.substring("stream", 2, 2), "start_index", "end_index", "score", "threshold") for c in "ab")
    assert a == b and len(a) > 0
