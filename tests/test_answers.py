"""Typed answers against plain Python on made-up rows."""

import math

from pyspark.sql import functions as F

from gaugeworks.operators import answers as A


def test_answers_go_back_to_probabilities(spark):
    rows = spark.createDataFrame([(1, "choice", ["a", "b", "c"], [0.2, 0.5, 0.3], "b"), (2, "noul", ["false", "true"], [0.5, 0.5], "true"), (3, "score", ["0", "1", "2"], [0.25, 0.0, 0.75], "2"), (4, "score", ["0", "1"], [0.5, 0.5], "0")], "id int, type string, keys array<string>, p array<double>, label string")
    served = A.answered(rows)
    got = {r["id"]: r for r in A.to_probs(served.drop("p")).withColumn("ok", A.correct(F.col("label"))).withColumn("at", A.label_index(F.col("keys"), F.col("label"))).collect()}
    assert (got[1]["choice"], got[1]["p"], got[1]["ok"], got[1]["at"]) == ("b", [0.2, 0.5, 0.3], True, 1)
    assert (got[2]["noul"], got[2]["p"], got[2]["confidence"], got[2]["ok"]) == (0.5, [0.5, 0.5], None, True)
    assert (got[3]["score"], got[3]["ok"]) == (1.5, True)  # 1.5 rounds to 2
    assert (got[4]["score"], got[4]["ok"]) == (0.5, True)  # 0.5 rounds to 0
    keys = rows.select(A.question_keys(F.col("type"), F.array(*map(F.lit, "xy"))).alias("k"), A.label_index(F.col("keys"), F.lit("zz")).alias("no")).collect()
    assert [r["k"] for r in keys] == [["x", "y"], ["false", "true"], ["0", "1"], ["0", "1"]] and {r["no"] for r in keys} == {None}


def test_chance_parity_and_sources(spark):
    (r,) = A.chance(spark.createDataFrame([("r", 2), ("r", 4), ("r", 5)], "id string, k int"), "id").collect()
    assert r["n"] == 3 and math.isclose(r["accuracy"], (0.5 + 0.25 + 0.2) / 3) and math.isclose(r["case_exact"], 0.025)
    old = spark.createDataFrame([("a", "q", [0.6, 0.4]), ("b", "q", [0.9, 0.1]), ("gone", "q", [1.0])], "id string, question string, p array<double>")
    new = spark.createDataFrame([("a", "q", [0.45, 0.55], "long", "x", True), ("b", "q", [0.9, 0.1], "long", "y", False)], "id string, question string, p array<double>, bucket string, part string, efficient boolean")
    got = {r["key"]: tuple(r)[1:] for r in A.parity(old, new).collect()}
    assert got == {"long": (2, 0.15, 0.075, 1, 1), "long/x": (1, 0.15, 0.15, 1, 1), "long/y": (1, 0.0, 0.0, 0, 0)}
    traces = spark.createDataFrame([(1, "s", 10, True, False), (2, "s", None, None, True), (3, None, 5, None, False)], "id int, source string, n_thinking_tokens int, correct boolean, unparsed boolean")
    got = {r["source"]: tuple(r)[1:] for r in A.by_source(traces, spark.createDataFrame([(1,), (1,)], "id int")).collect()}
    assert got == {"s": (2, 1.0, 5.0, 0.5, 1.0, 1, 2), "unknown": (1, None, 5.0, 0.0, 0.0, 0, 0)}


def test_four_decimals_are_those_of_the_double(spark):
    """Held against Python's own rounding of doubles; the halves are fixed values."""
    values = [0.00015, 0.00025, 0.03125, 0.09375, 0.5, 1.0, 0.0, 2.34565, 0.99995, 254.00005, 1 / 3, 0.00005, 1e-300, *[k / 20000 for k in range(1, 4000, 7)], *[k / 16384 for k in range(0, 16384, 61)]]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "p double")
    got = [r[0] for r in df.select(A.rounded(F.col("p"))).collect()]
    assert got[: len(values)] == [round(v, 4) for v in values] and got[-2] is None and got[-1] != got[-1]
