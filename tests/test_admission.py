"""Fixed values of the admission operators."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import admission as A


def test_spot_gate(spark):
    sample = spark.createDataFrame([("a", "q", "x"), ("b", "q", "y")], "id string, question string, label string")
    reviews = lambda rows: spark.createDataFrame(rows, "id string, question string, label string, verdict string")
    good = [("a", "q", "x", "accept"), ("b", "q", "y", "reject")]
    assert A.spot_gate(sample, reviews(good), 1) == {"agreed": 1, "questions": 2}
    for rows, least in ((good, 2), (good[:1], 1), ([*good, ("c", "q", "z", "accept")], 1), ([good[0], ("b", "q", "z", "accept")], 1)):
        with pytest.raises(ValueError):
            A.spot_gate(sample, reviews(rows), least)


def test_prepared(spark):
    rows = spark.createDataFrame([(" " + "x" * 3 + "\n", "n"), ("xx", "n"), ("  ", "n"), ("xxx", "other"), (None, "n"), ("xxx", None)], "text string, name string")
    got = sorted((r["text"], r["key"], r["bucket"], r["text_sha256"] is None) for r in A.prepared(rows, {"n": "k"}, [("b", 3, 9)]).collect())
    assert got == [("xx", "k", None, True), ("xxx", "k", "b", False)]


def test_softened(spark):
    rows = spark.createDataFrame([("a", "q", 0, [0.25, 0.75]), ("b", "q", 1, [0.25, 0.75]), ("c", "q", 0, [0.45, 0.55])], "id string, question string, label int, p array<double>")
    assert [tuple(r) for r in A.softened(rows.select("id", "question"), rows).collect()] == [("a", "q", [0.625, 0.375])]
    with pytest.raises(ValueError):
        A.softened(rows, rows, threshold=0.4)


def test_odds_shift(spark):
    rows = spark.createDataFrame([([0.5, 0.25, 0.25], [0.25, 0.25, 0.25, 0.25])], "p array<double>, p_more array<double>")
    got = A.odds_shift(rows).first()
    assert got["n"] == 1 and abs(got["mean_shift"] + 0.6931471805599453) < 1e-12 and A.odds_shift(rows.where(F.lit(False))).first()["n"] == 0
