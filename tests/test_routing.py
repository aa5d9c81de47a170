"""Fixed values of the routing operators."""

from pyspark.sql import functions as F

from gaugeworks.operators import routing as R


def test_padded(spark):
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 16, 17, 129, 1000)], "n long").select(R.power_of_two(F.col("n")), R.padded_length(F.col("n")), R.padded_count(F.col("n"))).collect()]
    assert got == [(2, 0, 0), (1, 16, 1), (2, 16, 2), (8, 16, 6), (16, 16, 16), (32, 32, 24), (256, 160, 192), (1024, 1024, 1024)]


def test_labels(spark):
    got = [r[0] for r in spark.createDataFrame([("A Big-Dog",), ("big dog, cat",), ("nothing",), (None,), ("KITTY",)], "t string").select(R.extracted_label(F.col("t"), ["big_dog", "cat"], {"cat": ["kitty"]})).collect()]
    assert got == ["big_dog", None, None, None, "cat"]


def test_options(spark):
    moves = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.495), ("a", "z", 0.4), ("b", "x", 0.5), ("b", "y", 0.5), ("c", "x", 0.1)], "grp string, key string, value double")
    got = {r["grp"]: (r["best"], sorted(r["options"])) for r in R.drawn_options(moves, "1").collect()}
    assert got == {"a": ("x", ["x", "z"])}


def test_policies_of_nothing(spark):
    rows = spark.createDataFrame([], "direct_correct boolean, thinking_correct boolean, confidence double, direct_tokens long, thinking_tokens long")
    assert R.policies(rows, [0.5]).collect() == []


def test_leaks(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("a", "2")], "id string, item_ref string")
    assert sorted(r["id"] for r in R.leaked(rows, spark.createDataFrame([("x", "2"), ("c", None)], "id string, item_ref string")).collect()) == ["a", "b", "c"]
