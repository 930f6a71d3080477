"""Readers and writers on small files."""

import pytest

from weirlight.operators import streams
from weirlight.sources import files


def test_sniffed_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,v,gone\n0,1.5,\n1,2.5,\n")
    (tmp_path / "b.txt").write_text("1 2  3 \n4 5  6 \n")
    (tmp_path / "c.tsv").write_text("1\t2\n3\t4\n")
    assert files.read(spark, str(tmp_path / "a.csv")).columns == ["time", "v"]
    assert sorted(map(tuple, files.read(spark, str(tmp_path / "b.txt")).collect())) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert files.read(spark, str(tmp_path / "c.tsv")).columns == ["0", "1"]
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path / "d.xyz"))
    assert len(files.expand(spark, [f"{tmp_path}/*.csv"])) == 1
    with pytest.raises(FileNotFoundError):
        files.expand(spark, [f"{tmp_path}/*.none"])


def test_stream_files_to_canonical(spark, tmp_path):
    (tmp_path / "m.csv").write_text("unit,time,v\n1,0,1\n1,1,2\n2,0,3\n")
    raw = files.read_stream_files(spark, [str(tmp_path / "m.csv")], "unit")
    assert sorted(r[0] for r in raw.select("stream").distinct().collect()) == ["m__1", "m__2"]
    long = streams.canonicalise(raw, "stream", ["time"], {"v": "v"}, streams.time_column(raw.columns))
    nested = streams.nest(long, ["v"])
    files.write_canonical(nested, str(tmp_path / "set.parquet"))
    assert files.read_canonical(spark, str(tmp_path / "set.parquet")).count() == 2
    files.write_streams(long, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 3


def test_corpus_forms(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, [1.0, 2.0])], "stream string, depth int, sig array<double>")
    for name in ("c.csv", "c.parquet"):
        files.write_corpus(df, str(tmp_path / name))
        assert files.read_corpus(spark, str(tmp_path / name)).first()["sig"] == [1.0, 2.0]


def test_names_that_collide():
    assert files.names_for_urls(["http://a/x.csv", "http://b/x.csv"]) == {"http://a/x.csv": "x.csv", "http://b/x.csv": "x_1.csv"}


def test_many_files_are_one_scan(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"s{i}.csv").write_text("time,v\n0,1.5\n1,2.5\n" + ("2,3.5\n" if i == 4 else ""))
        (tmp_path / f"w{i}.txt").write_text("1 2 \n4 5 \n")
    spark.createDataFrame([(0, 9.0)], "time int, v double").coalesce(1).write.parquet(str(tmp_path / "folder.parquet"))
    found = files.read_stream_files(spark, files.expand(spark, [f"{tmp_path}/*.csv", f"{tmp_path}/folder.parquet"]))
    counts = {r["stream"]: r["count"] for r in found.groupBy("stream").count().collect()}
    assert counts == {**{f"s{i}": 2 for i in range(4)}, "s4": 3, "folder": 1}
    text = files.read_stream_files(spark, files.expand(spark, [f"{tmp_path}/*.txt"]), equal_lengths=True)
    assert sorted(text.columns) == ["0", "1", "stream"] and text.select("stream").distinct().count() == 5
    with pytest.raises(ValueError, match="from 2 to 3 rows"):
        files.read_stream_files(spark, files.expand(spark, [f"{tmp_path}/*.csv"]), equal_lengths=True)


def test_names_of_columns_without_a_header(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], ["0", "1", "2"])
    for time, columns, name in ((None, ["Variable_1", "Variable_2", "Variable_3"], None), (0, ["Time", "Variable_1", "Variable_2"], "Time"), (-1, ["Variable_1", "Variable_2", "Time"], "Time"), ("1", ["Variable_1", "Time", "Variable_2"], "Time")):
        named, found = streams.name_columns(df, time)
        assert named.columns == columns and found == name
    for wrong in (3, -4, "when"):
        with pytest.raises(ValueError):
            streams.name_columns(df, wrong)
    own = df.toDF("a", "Date", "b")
    assert streams.name_columns(own)[1] == "Date" and streams.name_columns(own)[0].columns == own.columns


def test_labels_in_all_forms(spark, tmp_path):
    forms = {
        "points": spark.createDataFrame([("a", 0, 1), ("a", 1, 0)], "stream string, pos int, label int"),
        "arrays": spark.createDataFrame([("a", [1, 0])], "stream string, label array<int>"),
        "pairs": spark.createDataFrame([("a", [[0, 0]])], "stream string, anomalous array<array<int>>"),
        "spans": spark.createDataFrame([("a", 0, 0)], "stream string, lo int, hi int"),
    }
    for name, df in forms.items():
        df.write.parquet(str(tmp_path / name))
        found = sorted(tuple(r) for r in files.read_labels(spark, str(tmp_path / name)).collect())
        assert found == ([("a", 0, True), ("a", 1, False)] if name in ("points", "arrays") else [("a", 0, 0)])
    spark.createDataFrame([("a", 1)], "stream string, other int").write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.read_labels(spark, str(tmp_path / "none"))
