"""Scores of prediction rows: calibration, selective prediction, risk against coverage.

Every function takes rows with ``conf`` and ``ok`` (or the columns it names) and grouping keys, and stays a grouped plan: a
confidence-tie block is one row before any running sum, so ties move as a block and what a window sorts is already aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.functions import probability as P


def scored(rows: DataFrame, p: str = "p", label: str = "label", logits: str | None = None) -> DataFrame:
    """rows with conf, pred, ok, nll, brier."""
    at, y = F.col(p), F.col(label)
    rows = rows.withColumn("conf", P.confidence(at)).withColumn("pred", P.first_argmax(at))
    return rows.withColumn("ok", F.col("pred") == y).withColumn("nll", P.nll_at(at, y, F.col(logits) if logits else None, 1.0)).withColumn("brier", P.brier(at, y))


def knowable(rows: DataFrame) -> DataFrame:
    """Clean rows whose source isn't the unknowable one."""
    return rows.where((F.col("variant") == "clean") & (F.col("source") != "unknowable"))


def _by(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys)


def checked(conf: Column) -> Column:
    """conf; a row whose confidence is no number from 0 to 1 stops the query."""
    good = ~F.isnan(conf.cast("double")) & (conf >= 0) & (conf <= 1)
    return F.when(good, conf).otherwise(F.raise_error(F.lit("confidence must be a number from 0 to 1")).cast("double"))


def checked_budget(budget: float, least: int = 1) -> None:
    if not 0 <= budget <= 1 or least < 1:  # also false for nan
        raise ValueError("an error budget lies from 0 to 1, and at least one row is accepted")


def _curve(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """risk_curve() with c, the rows of each block.

    Running sums in two steps: over 4096 ranges of confidence (few rows), then within each range, so no task sorts a whole key.
    """
    rows = rows.withColumn("conf", checked(F.col("conf")))
    blocks = _by(rows, [*keys, "conf"]).agg(F.count("*").alias("c"), F.sum((~F.col("ok")).cast("long")).alias("e")).withColumn("_range", F.floor(F.col("conf") * 4096))
    down = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    ranges = _by(blocks, [*keys, "_range"]).agg(F.sum("c").alias("_c"), F.sum("e").alias("_e"))
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_c").over(down), F.lit(0)).alias("_above"), F.coalesce(F.sum("_e").over(down), F.lit(0)).alias("_wrong"), F.sum("_c").over(W.partitionBy(*keys)).alias("n"))
    within = W.partitionBy(*keys, "_range").orderBy(F.desc("conf")).rowsBetween(W.unboundedPreceding, 0)
    out = blocks.withColumn("accepted", F.sum("c").over(within)).withColumn("errors", F.sum("e").over(within)).join(ranges, [*keys, "_range"])
    out = out.select(*keys, F.col("conf").alias("threshold"), "c", (F.col("accepted") + F.col("_above")).alias("accepted"), (F.col("errors") + F.col("_wrong")).alias("errors"), "n")
    return out.withColumn("coverage", F.col("accepted") / F.col("n")).withColumn("risk", F.col("errors") / F.col("accepted"))


def risk_curve(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, threshold, accepted, errors, n, coverage, risk: a row for each distinct confidence, from the highest on."""
    return _curve(rows, keys).drop("c")


def coverage_at_error(rows: DataFrame, budgets: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """For each budget the greatest share that can be accepted with errors of at most budget * accepted; 0 where none, and for no rows at all."""
    for x in budgets:
        checked_budget(x)
    curve = risk_curve(rows, keys)
    return _by(curve, keys).agg(*[(F.coalesce(F.max(F.when(F.col("errors") <= b * F.col("accepted"), F.col("accepted"))), F.lit(0)) / F.coalesce(F.max("n"), F.lit(1))).alias(f"coverage_at_{round(100 * b)}") for b in budgets])


def area_under_risk(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the steps of coverage times the risk at their end."""
    return _by(_curve(rows, keys), keys).agg((F.sum(F.col("c") * F.col("risk")) / F.max("n")).alias("aurc"))


def expected_calibration_error(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum over ten bins of the share of rows times the gap of accuracy and mean confidence."""
    bins = _by(rows.withColumn("bin", P.calibration_bin(F.col("conf"))), [*keys, "bin"]).agg(F.count("*").alias("c"), F.abs(F.avg(F.col("ok").cast("double")) - F.avg("conf")).alias("gap"))
    return _by(bins, keys).agg((F.sum(F.col("c") * F.col("gap")) / F.sum("c")).alias("ece"))


def metric_block(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each group: n, nll, acc, brier, mean_conf, confident errors and the coverage and calibration figures."""
    sure, ok = F.col("conf") >= 0.9, F.col("ok").cast("double")
    main = _by(rows, keys).agg(
        F.count("*").alias("n"), F.avg("nll").alias("nll"), F.avg(ok).alias("acc"), F.avg("brier").alias("brier"), F.avg("conf").alias("mean_conf"),
        F.avg((sure & ~F.col("ok")).cast("double")).alias("confident_error_rate"), F.avg(sure.cast("double")).alias("coverage_at_0_9"),
        F.avg(F.when(sure, ok)).alias("accuracy_at_0_9"), F.avg(F.when(sure, 1 - ok)).alias("error_rate_at_0_9"), (F.avg("conf") - F.avg(ok)).alias("confidence_bias"),
    )
    parts = [expected_calibration_error(rows, keys), coverage_at_error(rows, (0.05, 0.01), keys), area_under_risk(rows, keys)]
    for part in parts:
        main = main.join(part, list(keys)) if keys else main.crossJoin(part)  # without keys each side is one row
    return main


def top_bins(rows: DataFrame, thresholds: Sequence[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    """threshold, n, errors of the rows at or above each threshold."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("conf") >= t).alias("in")) for t in thresholds]))
    return rows.select("ok", each.alias("b")).groupBy(F.col("b.threshold").alias("threshold")).agg(F.sum(F.col("b.in").cast("long")).alias("n"), F.sum((F.col("b.in") & ~F.col("ok")).cast("long")).alias("errors"))


def selective(rows: DataFrame, shares: Sequence[float] = (0.5, 0.8), keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy of rows at or above the confidence of rank max(1, ceil(n * share)); ties at the cut-off are kept."""
    curve = risk_curve(rows, keys)
    pick = [F.min_by(F.struct("accepted", "errors"), F.when(F.col("accepted") >= F.greatest(F.lit(1), F.ceil(F.col("n") * s)), F.col("accepted"))).alias(f"s{k}") for k, s in enumerate(shares)]
    out = _by(curve, keys).agg(*pick)
    return out.select(*keys, *[c for k, s in enumerate(shares) for c in ((F.col(f"s{k}.accepted")).alias(f"n_{round(100 * s)}"), (1 - F.col(f"s{k}.errors") / F.col(f"s{k}.accepted")).alias(f"acc_{round(100 * s)}"))])


def select_threshold(rows: DataFrame, budget: float, least: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """The lowest threshold whose accepted rows (at least ``least``) keep to the budget; null where none does."""
    checked_budget(budget, least)
    fits = (F.col("errors") <= budget * F.col("accepted")) & (F.col("accepted") >= least)
    return _by(risk_curve(rows, keys), keys).agg(F.min(F.when(fits, F.col("threshold"))).alias("threshold"))


def evaluate_threshold(rows: DataFrame, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    """accepted, errors, coverage, risk at a fixed threshold; a null threshold accepts nothing and has a null risk."""
    yes = F.coalesce(F.col("conf") >= threshold, F.lit(False))
    out = _by(rows, keys).agg(F.sum(yes.cast("long")).alias("accepted"), F.sum((yes & ~F.col("ok")).cast("long")).alias("errors"), F.count("*").alias("n"))
    return out.select(*keys, "accepted", "errors", (F.col("accepted") / F.col("n")).alias("coverage"), F.when(F.col("accepted") > 0, F.col("errors") / F.col("accepted")).alias("risk"))


#: State-token edges of the length buckets.
LENGTH_EDGES = (8192, 16384, 32768, 65536)


def length_buckets(edges: Sequence[int] = LENGTH_EDGES) -> list[tuple[str, int, int | None]]:
    """(name, from, below) of the buckets between edges, then of the open tails from each edge but the last. Names count in units of 1024."""
    edges = list(edges)
    if not edges or edges != sorted(set(edges)) or any(e < 1024 or e % 1024 for e in edges):
        raise ValueError("edges must be rising multiples of 1024")
    k = [f"{e // 1024}k" for e in edges]
    inner = [(f"{k[i]}_{k[i + 1]}", edges[i], edges[i + 1]) for i in range(len(edges) - 1)]
    return [(f"under_{k[0]}", 0, edges[0]), *inner, (f"{k[-1]}_plus", edges[-1], None), *((f"{k[i]}_plus", edges[i], None) for i in range(len(edges) - 1))]


def by_length(rows: DataFrame, length: str = "length", edges: Sequence[int] = LENGTH_EDGES) -> DataFrame:
    """bucket, n, acc, mean_conf, brier, confident_error_rate, ece; buckets overlap, and empty ones are there with n = 0."""
    buckets = length_buckets(edges)
    names = rows.sparkSession.createDataFrame([(name,) for name, _, _ in buckets], "bucket string")
    inside = [F.when((F.col(length) >= lo) & (F.col(length) < hi if hi else F.lit(True)), F.lit(name)) for name, lo, hi in buckets]
    each = rows.withColumn("bucket", F.explode(F.array_compact(F.array(*inside))))
    wrong = ((F.col("conf") >= 0.9) & ~F.col("ok")).cast("double")
    main = each.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("acc"), F.avg("conf").alias("mean_conf"), F.avg("brier").alias("brier"), F.avg(wrong).alias("confident_error_rate"))
    main = main.join(expected_calibration_error(each, ["bucket"]), "bucket")
    return names.join(main, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def area_under_roc(rows: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with mean ranks of ties; 0.5 where a class is empty."""
    blocks = _by(rows, [*keys, score]).agg(F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("pos"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = blocks.withColumn("rank", before + (F.col("c") + 1) / 2.0)
    out = _by(ranked, keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("c").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return out.select(*keys, F.when((p == 0) | (n == 0), F.lit(0.5)).otherwise((F.col("r") - p * (p + 1) / 2.0) / (p * n)).alias("auroc"))


def _placed(rows: DataFrame, value: Column, keys: Sequence[str], within: Sequence[Column | str]) -> DataFrame:
    """rows with _rank (from 1, by value rising, then within) and _n, by keys.

    Ranks in two steps: rows are counted by ranges of the value (8192 up to 1, then 1024 for each doubling), then numbered within these, so no task sorts a whole key.
    """
    size = F.abs(value.cast("double"))
    place = F.signum(value.cast("double")) * F.when(size <= 1, size * 8192).otherwise(8192 + F.log2(size) * 1024)
    spread = rows.withColumn("_v", value).withColumn("_range", F.floor(place))
    up = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = _by(spread, [*keys, "_range"]).agg(F.count("*").alias("_c"))
    ranges = ranges.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_below"), F.sum("_c").over(W.partitionBy(*keys)).alias("_n"))
    numbered = spread.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_range").orderBy("_v", *within)))
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for j, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{j}"))
    return numbered.join(ranges, same).withColumn("_rank", F.col("_in") + F.col("_below"))


def top_share_accuracy(rows: DataFrame, shares: Sequence[float], first: Column, within: Sequence[Column | str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy of the max(1, round-half-even(n * share)) rows that come first by first (a number, rising), then within."""
    ranked = _placed(rows, first, keys, within)
    return _by(ranked, keys).agg(*[F.avg(F.when(F.col("_rank") <= F.greatest(F.lit(1.0), F.bround(F.col("_n") * s)), F.col("ok").cast("double"))).alias(f"acc_{round(100 * s)}") for s in shares])


def escalation(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """tau, accuracy, cost: rows below tau take the slow answer (slow_ok, slow_cost added). One pass: thresholds are few, and Spark broadcasts them where their size allows."""
    low = F.col("conf") < F.col("tau")
    return rows.crossJoin(thresholds).groupBy("tau").agg(F.avg(F.when(low, F.col("slow_ok")).otherwise(F.col("ok")).cast("double")).alias("accuracy"), F.avg(F.col("cost") + F.when(low, F.col("slow_cost")).otherwise(0)).alias("cost"))


def nearest_rank(rows: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Values at index min(n - 1, int(share * n)) of the ascending order, counting from 0."""
    ranked = _placed(rows.where(F.col(value).isNotNull()), F.col(value), keys, ())
    return _by(ranked, keys).agg(*[F.max(F.when(F.col("_rank") == F.least(F.col("_n"), F.floor(F.col("_n") * s) + 1), F.col(value))).alias(f"q{round(100 * s)}") for s in shares])
