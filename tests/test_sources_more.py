"""Archives, literals, remote predictors, the reliability head, windows on streams."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import metrics, reliability
from gaugeworks.sources import files
from gaugeworks.streaming import logs


def test_tar_and_literals(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, text in (("x/a.json", '{"a": 1}'), ("x/b.txt", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    assert [(r["member"], r["text"]) for r in files.read_tar(spark, str(tmp_path / "a.tar.gz")).collect()] == [("x/a.json", '{"a": 1}')]
    df = spark.createDataFrame([("['a', 2]",), ("oops(",), (None,)], "x string")
    assert [r[0] for r in df.select(files.literal_list(F.col("x"))).collect()] == [["a", "2"], None, None]


def test_asked(spark):
    def send(text):
        return (422, None) if text == "bad" else (500, None) if text == "down" else (200, text.upper())

    df = spark.createDataFrame([("1", "ok"), ("2", "bad")], "id string, text string")
    assert sorted(map(tuple, files.asked(df, send).collect())) == [("1", 200, "OK"), ("2", 422, None)]
    with pytest.raises(Exception, match="status 500"):
        files.asked(spark.createDataFrame([("3", "down")], "id string, text string"), send, tries=2, wait=0.0).collect()


def test_reliability_head(spark):
    rows = [(str(k), [0.5 + (k % 50) / 100, 0.5 - (k % 50) / 100], (k % 50) > 20 or k % 7 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, p array<double>, ok boolean")
    got = reliability.reranked(df, reliability.fit(df))
    assert got.where("conf between 0 and 1").count() == 300
    assert metrics.area_under_roc(got, "conf", "ok").first()[0] > 0.85


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:55:00", "a", 2.0), ("2024-01-01 03:00:00", "a", 1.0)]
    spark.createDataFrame(rows, "ts string, k string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "k", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(str(tmp_path / "in"))
    q = logs.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["value"]) for r in spark.table("windowed").collect()) == [(1, 1.0), (2, 3.0)]
