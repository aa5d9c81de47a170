"""Scores, calibration and paired statistics on hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import probability as P
from gaugeworks.operators import calibrate, metrics, paired


def rows(spark, conf, ok):
    return spark.createDataFrame(list(zip(map(float, conf), ok)), "conf double, ok boolean")


def one(spark, expr, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {'array<double>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int'}" for n, v in columns.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_coverage_moves_tie_blocks(spark):
    r = rows(spark, [0.99] * 100, [True] * 90 + [False] * 10)
    got = metrics.coverage_at_error(r, (0.05, 0.10)).first()
    assert (got["coverage_at_5"], got["coverage_at_10"]) == (0.0, 1.0)
    assert metrics.coverage_at_error(r.limit(0), (0.05,)).first()["coverage_at_5"] == 0.0
    for bad in (float("nan"), 1.5, -0.1):
        with pytest.raises(Exception, match="confidence must be"):
            metrics.coverage_at_error(rows(spark, [0.5, bad], [True, True]), (0.05,)).collect()
    for budget in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            metrics.coverage_at_error(r, (budget,))
    with pytest.raises(ValueError):
        metrics.select_threshold(r, 0.1, 0)


def test_risk_curve(spark):
    r = rows(spark, [0.99, 0.99, 0.9, 0.8], [True, False, True, True])
    got = metrics.risk_curve(r).orderBy(F.desc("threshold")).collect()
    assert [x["accepted"] for x in got] == [2, 3, 4] and [x["risk"] for x in got] == pytest.approx([0.5, 1 / 3, 0.25])
    assert metrics.coverage_at_error(r, (0.25,)).first()[0] == 1.0


def test_area_under_risk(spark):
    assert metrics.area_under_risk(rows(spark, [0.99, 0.9, 0.8], [True, True, False])).first()[0] == pytest.approx(1 / 9)
    assert metrics.area_under_risk(rows(spark, [0.7] * 10, [True] * 9 + [False])).first()[0] == pytest.approx(0.1)


def test_thresholds(spark):
    r = rows(spark, [0.99, 0.98, 0.97, 0.6], [True, True, True, False])
    assert metrics.select_threshold(r, 0.05).first()["threshold"] == 0.97
    got = metrics.evaluate_threshold(rows(spark, [0.99, 0.7, 0.6], [False, True, True]), F.lit(0.97)).first()
    assert (got["accepted"], got["errors"], got["risk"]) == (1, 1, 1.0) and got["coverage"] == pytest.approx(1 / 3)
    none = metrics.evaluate_threshold(r, F.lit(None).cast("double")).first()
    assert none["accepted"] == 0 and none["risk"] is None


def test_top_bins_and_bias(spark):
    r = rows(spark, [0.99, 0.99, 0.6], [True, False, True]).withColumn("nll", F.lit(0.0)).withColumn("brier", F.lit(0.0))
    assert {x["threshold"]: (x["n"], x["errors"]) for x in metrics.top_bins(r).collect()}[0.99] == (2, 1)
    assert metrics.metric_block(r).first()["confidence_bias"] == pytest.approx((0.99 + 0.99 + 0.6) / 3 - 2 / 3)


def test_lengths(spark):
    length = [[100, 9000, 20000, 40000][k % 4] for k in range(40)]
    length[0] = 70000
    r = spark.createDataFrame([(n, 0.5, True, 0.25) for n in length], "length long, conf double, ok boolean, brier double")
    got = {x["bucket"]: x["n"] for x in metrics.by_length(r).collect()}
    assert got == {"under_8k": 9, "8k_16k": 10, "16k_32k": 10, "32k_64k": 10, "64k_plus": 1, "8k_plus": 31, "16k_plus": 21, "32k_plus": 11}
    empty = {x["bucket"]: (x["n"], x["acc"]) for x in metrics.by_length(r.where("length < 200")).collect()}
    assert empty["64k_plus"] == (0, None) and empty["under_8k"][0] == 9
    edge = {x["bucket"]: x["n"] for x in metrics.by_length(r.limit(2).withColumn("length", F.when(F.col("length") == 70000, 8191).otherwise(8192).cast("long"))).collect()}
    assert edge["under_8k"] == 1 and edge["8k_16k"] == 1
    assert [b[0] for b in metrics.length_buckets((1024, 4096))] == ["under_1k", "1k_4k", "4k_plus", "1k_plus"]
    for bad in ((), (2048, 1024), (1000,)):
        with pytest.raises(ValueError):
            metrics.length_buckets(bad)


def test_ranks_in_two_steps(spark):
    import random

    r = random.Random(6)
    data = [(k % 3, r.choice([r.uniform(-2, 2), r.uniform(-1e6, 1e6), float(r.randrange(5))])) for k in range(400)]
    got = {x["g"]: x for x in metrics.nearest_rank(spark.createDataFrame(data, "g int, v double"), "v", (0.05, 0.5, 0.95, 1.0), ["g"]).collect()}
    for g in range(3):
        v = sorted(x for k, x in data if k == g)
        assert [got[g][f"q{q}"] for q in (5, 50, 95, 100)] == [v[min(len(v) - 1, int(s * len(v)))] for s in (0.05, 0.5, 0.95, 1.0)]


def test_calibration_edges_are_the_float_ones(spark):
    assert [one(spark, P.calibration_bin(F.col("c")), c=c) for c in (0.0, 0.1, 0.3, 0.6, 0.7, 0.8, 1.0)] == [0, 1, 2, 5, 6, 8, 9]


def test_temperatures(spark):
    assert one(spark, P.nll_at(F.col("p"), F.col("y"), F.col("z"), 2.0), p=[1.0, 0.0], z=[0.0, -100.0], y=1) == pytest.approx(50)
    assert one(spark, P.at_temperature(F.col("p"), F.col("z"), 2.0), p=[1.0, 0.0], z=[0.0, -100.0])[1] == pytest.approx(math.exp(-50))
    assert one(spark, P.at_temperature(F.col("p"), F.col("z"), 1.0), p=[0.25, 0.75], z=[9.0, 1.0]) == [0.25, 0.75]
    r = spark.createDataFrame([("t", [0.0, -100.0], 1)], "task string, logits array<double>, label int")
    assert calibrate.fit_temperature(r).first()["temperature"] == pytest.approx(4.0)


def test_first_maximum_wins(spark):
    assert one(spark, P.first_argmax(F.col("p")), p=[0.2, 0.4, 0.4]) == 1


def test_confidences(spark):
    s = lambda p: one(spark, P.score_confidence(F.col("p")), p=p)
    assert s([0.5, 0.0, 0.5]) == pytest.approx(0) and s([0.0, 0.74, 0.26]) == pytest.approx(0.61, abs=0.005) and s([1 / 3] * 3) == pytest.approx(0) and s([1.0]) == 1
    c = lambda p: one(spark, P.choice_confidence(F.col("p")), p=p)
    assert c([1.0]) == 1 and c([0.25] * 4) == pytest.approx(0) and c([0.0, 1.0]) == pytest.approx(1) and c([0.0, 0.0]) == pytest.approx(0)


def test_distributions(spark):
    v = lambda p: one(spark, P.valid_distribution(F.col("p")), p=p)
    assert v([0.5, 0.5]) and v([0.505, 0.5]) and not v([0.9, 0.5]) and not v([0.0, 0.0]) and not v([float("nan"), 1.0]) and not v([1.2, -0.2])


def test_auroc(spark):
    df = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True)], "s double, y boolean")
    assert metrics.area_under_roc(df, "s", "y").first()[0] == pytest.approx(0.875)
    assert metrics.area_under_roc(df.where("y"), "s", "y").first()[0] == 0.5


def test_exact_binomial():
    assert paired.exact_binomial(0, 0) == 1 and paired.exact_binomial(5, 5) == 1
    assert paired.exact_binomial(1, 9) == pytest.approx(2 * 11 / 1024) and paired.exact_binomial(0, 4) == pytest.approx(0.125)


def test_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(f"s{k % 3}", k // 2, k) for k in range(60)], "source string, grp long, k long")
    got = calibrate.grouped_folds(df, 4)
    assert got.count() == 60 and got.groupBy("source", "grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in got.select("source", "grp", "fold").distinct().groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_single_cluster_bootstrap_has_no_width(spark):
    df = spark.createDataFrame([("s", 0, "t", 0.9)] * 20, "source string, grp long, task string, d double")
    r = paired.bootstrap_delta(df, "d", 50).first()
    assert r["delta"] == pytest.approx(0.9) and r["lower"] == pytest.approx(0.9) and r["upper"] == pytest.approx(0.9)


def test_pair_flips(spark):
    s = "pair_id string, question string, sibling string, keys array<string>, label int, pred int"
    df = spark.createDataFrame([("p", "q", "a", ["x", "y"], 0, 0), ("p", "q", "b", ["y", "x"], 0, 0)], s)
    r = paired.pair_flips(df).first()
    assert (r["relevant"], r["flip_rate"], r["both_correct"]) == (True, 1.0, 1.0)
    with pytest.raises(Exception, match="pair without both"):
        paired.pair_flips(df.limit(1)).collect()


def test_realigned_by_name(spark):
    s = "id string, keys array<string>, p array<double>"
    got = paired.realigned(spark.createDataFrame([("1", ["b", "a"], [0.9, 0.1])], s), spark.createDataFrame([("1", ["a", "b"], [0.2, 0.8])], s), ["id"]).first()
    assert got["p"] == [0.1, 0.9] and got["o_p"] == [0.2, 0.8]


def test_raw_undoes_serving(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.0, math.log(4)])], "p array<double>, logits array<double>")
    r = calibrate.raw(calibrate.served(calibrate.served(df, 2.0), 1.5)).first()
    assert r["p"] == pytest.approx([0.2, 0.8]) and r["inference_temperature"] == 1.0
