"""Every stream query runs; those with SQL equal DuckDB's result."""

import os

import duckdb
import pytest

from weirlight.plans import queries as Q


def normal(df):
    cell = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, sf_dir, duck, name):
    ours, theirs = Q.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(Q.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


#: What a row of a query without SQL must be, beyond there being rows.
SANE = {
    "whitening": lambda f: (f["scale"] > 0).all() and f["scale"].is_monotonic_increasing and f["component"].tolist() == list(range(len(f))),
    "score_streams": lambda f: f["anomalous_fraction"].between(0, 1).all() and (f["n_anomalous_points"] <= f["n"]).all() and f["max_score"].notna().sum() == (f["n_anomalous_intervals"] > 0).sum(),
    "guarded_search": lambda f: f["anomalous_fraction"].between(0, 1).all(),
    "reduced_search": lambda f: f["anomalous_fraction"].between(0, 1).all(),
    "isolation_forest": lambda f: f["anomalous_fraction"].between(0, 1).all() and f["max_score"].dropna().between(0, 1).all(),
    "widest_first_search": lambda f: not f.duplicated(["stream", "pos"]).any() and f["flag"].nunique() == 2,
    "bagged_detector": lambda f: f["votes"].between(0, 2).all() and (f["flag"] == (f["votes"] >= 1)).all(),
    "point_scores": lambda f: (f["point_score"] >= 0).all() and not f.duplicated(["stream", "pos"]).any(),
    "threshold_sweep": lambda f: sorted(f["scale"]) == [0.5, 1.0, 2.0, 4.0] and (f["tp"] + f["fn"]).nunique() == 1 and (f["fp"] + f["tn"]).nunique() == 1,
    "pooled_detector": lambda f: (f["start_index"] < f["end_index"]).all() and (f["start_time"] <= f["end_time"]).all() and f["score"].notna().all(),
    "off_manifold": lambda f: f["off"].between(0, 1).all() and f["off"].nunique() > len(f) / 4,
    "trustworthiness": lambda f: f["trustworthiness"].between(0, 1).all(),
    "knn_cells": lambda f: (f.sort_values(["query", "rank"]).groupby("query")["distance"].diff().dropna() >= 0).all(),
    "knn_hashed": lambda f: (f.sort_values(["query", "rank"]).groupby("query")["distance"].diff().dropna() >= 0).all(),
}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_rows_are_sane(spark, sf_dir, name):
    found = Q.QUERIES[name](spark, sf_dir).toPandas()
    assert (len(found) or name == "per_interval_detector") and SANE.get(name, lambda f: True)(found)


def test_search_of_all_windows_by_brute_force(spark, sf_dir):
    """The whole detector at its defaults but for the granularity, with NumPy in place of each stage."""
    import numpy as np

    from weirlight import config
    from weirlight.operators import search
    from weirlight.plans import detect as plan

    c = config.check({})
    corpus, test = Q.split_users(spark, sf_dir)
    det = plan.fit(corpus, Q.CHANNELS, c)
    refs = det.refs.toPandas()
    z, depth = np.stack(refs["z"].to_numpy()), refs["depth"].to_numpy()
    norm = det.normaliser.first()
    few = test.where("stream < 25").persist()
    found = {r["stream"]: r for r in plan._flags(det, few, Q.CHANNELS, c)[1].collect()}
    cut = plan.windowed(few, c, False).toPandas().sort_values(["stream", "pos"])
    assert set(found) == set(cut["stream"]) and len(found) > 5
    for stream, g in cut.groupby("stream"):
        x = g[["t", *Q.CHANNELS]].to_numpy(float)
        scores = {}

        def score(a, b, x=x, scores=scores):
            if (a, b) not in scores:
                raw = (Q.signature.sign(x[None, a : b + 1], 2)[0] - np.array(norm["centre"])) / np.array(norm["scale"])
                own = int(min(set(depth.tolist()), key=lambda k: (abs(k + np.log2((b - a) / 16)), k)))
                near = np.sort(((z[abs(depth - own) <= 1] - det.metric.apply(raw[None])[0]) ** 2).sum(1))
                scores[a, b] = near[2], det.thresholds[own]
            return scores[a, b]

        blocks = search.clean_blocks(0, len(x) - 1, lambda a, b: score(a, b)[0] <= score(a, b)[1], 4)
        want = search.uncovered(blocks, 0, len(x) - 1)
        assert [(r["lo"], r["hi"]) for r in found[stream]["anomalous"]] == want
        assert all(abs(r["score"] - score(r["lo"], r["hi"])[0]) < 1e-6 * max(1, r["score"]) for r in found[stream]["anomalous"])


def test_per_interval_detector_takes_all_whole_windows(spark, sf_dir, monkeypatch):
    asked = {}
    monkeypatch.setattr(Q.interval_model, "detect", lambda normal, test, *a, **k: asked.update(normal=normal, test=test) or test)
    Q.QUERIES["per_interval_detector"](spark, sf_dir)
    whole = {r["stream"] for r in Q.cut(spark, sf_dir, 17).select("stream").distinct().collect()}
    sides = [{r["stream"] for r in asked[x].select("stream").distinct().collect()} for x in ("normal", "test")]
    assert sides[0] | sides[1] == whole and not sides[0] & sides[1] and {int(s.split("_")[0]) % 5 for s in sides[1]} == {4}


def test_detector_queries_have_default_settings(spark, sf_dir, monkeypatch):
    from weirlight import config
    from weirlight.plans import detect as plan

    used = []

    def noted(corpus, channels, c):
        used.append(c)
        raise KeyboardInterrupt

    monkeypatch.setattr(plan, "fit", noted)
    for name in ("score_streams", "widest_first_search", "isolation_forest", "bagged_detector", "point_scores"):
        with pytest.raises(KeyboardInterrupt):
            Q.QUERIES[name](spark, sf_dir)
    assert len(used) == 5
    for c in used:
        assert all(c[x] == config.DEFAULTS[x] for x in ("window", "signature", "metric", "calibrate"))
        assert c["detect"]["forest"] == config.DEFAULTS["detect"]["forest"] and c["detect"]["sig_tol"] == config.DEFAULTS["detect"]["sig_tol"]


def test_whitening_by_numpy(spark, sf_dir):
    import numpy as np

    x = np.stack([r["sig"] for r in Q.corpus(spark, sf_dir).collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    energy = np.cumsum(s**2) / (s**2).sum()
    keep = int(np.searchsorted(energy, 0.999)) + 1
    found = Q.QUERIES["whitening"](spark, sf_dir).toPandas().sort_values("component")
    assert np.allclose(found["scale"], np.sqrt(len(x)) / s[:keep], rtol=1e-3, atol=1e-5)


def test_cells_and_hashes_find_nine_tenths_of_the_neighbours(spark, sf_dir):
    exact = Q.QUERIES["knn_exact"](spark, sf_dir).toPandas()
    for name in ("knn_cells", "knn_hashed"):
        found = Q.QUERIES[name](spark, sf_dir).toPandas()
        assert len(found.merge(exact, on=["query", "ref"])) >= 0.9 * len(exact)
