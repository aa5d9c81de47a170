"""Temperatures: grid fits, out-of-fold fits, serving."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.functions import probability as P
from gaugeworks.operators.paired import resampled


def grid(points: int = 81, low: float = 0.25, high: float = 4.0) -> list[float]:
    """Points of equal ratio from low to high."""
    return [low * math.exp(k * math.log(high / low) / (points - 1)) for k in range(points)]


def losses(rows: DataFrame, temperatures: Sequence[float], keep: Sequence[str], logits: str = "logits", label: str = "label") -> DataFrame:
    """keep, i, temperature, loss: each row's negative log likelihood at each temperature. The grid is an array literal: no join."""
    z, y = F.col(logits), F.col(label)
    at = F.explode(F.transform(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(t).alias("temperature")) for k, t in enumerate(temperatures)]), lambda g: F.struct(g["i"].alias("i"), g["temperature"].alias("temperature"), P.let(F.array_max(z), lambda m: F.ln(P.total(F.transform(z, lambda x: F.exp((x - m) / g["temperature"])))) - (F.get(z, y) - m) / g["temperature"]).alias("loss"))))
    return rows.select(*keep, at.alias("g")).select(*keep, "g.i", "g.temperature", "g.loss")


def _first_least(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.min_by(F.struct("temperature", F.col("mean").alias("nll")), F.struct("mean", "i")).alias("b")).select(*keys, "b.temperature", "b.nll")


def fit_temperature(rows: DataFrame, aggregation: str = "macro", temperatures: Sequence[float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, temperature, nll: the first of least mean loss; macro takes the mean of the tasks' means.

    Losses are summed by (keys, task, temperature) before anything else, so what is compared are a few numbers for each task.
    """
    each = losses(rows, temperatures or grid(), [*keys, "task"])
    by_task = each.groupBy(*keys, "task", "i", "temperature").agg(F.sum("loss").alias("s"), F.count("*").alias("c"))
    mean = F.avg(F.col("s") / F.col("c")) if aggregation == "macro" else F.sum("s") / F.sum("c")
    return _first_least(by_task.groupBy(*keys, "i", "temperature").agg(F.round(mean, 10).alias("mean")), keys)


def grouped_folds(rows: DataFrame, folds: int = 5, order: Column | None = None) -> DataFrame:
    """rows with ``fold``: the groups of each source, in the given order (default: by group), go round the folds, on from where the last source stopped."""
    groups = rows.select("source", "grp").distinct()
    groups = groups.withColumn("_k", F.row_number().over(W.partitionBy("source").orderBy(order if order is not None else F.col("grp"))) - 1)
    count = groups.groupBy("source").agg(F.count("*").alias("_c"))
    start = count.withColumn("_start", F.coalesce(F.sum("_c").over(W.orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a source
    placed = groups.join(start, "source").select("source", "grp", ((F.col("_k") + F.col("_start")) % folds).alias("fold"))
    return rows.join(placed, ["source", "grp"])


def out_of_fold_temperatures(rows: DataFrame, folds: int = 5, temperatures: Sequence[float] | None = None) -> DataFrame:
    """fold, temperature: fitted on all other folds. Losses are summed once by fold; the others' sums are total less own."""
    each = losses(grouped_folds(rows, folds), temperatures or grid(), ["fold"]).groupBy("fold", "i", "temperature").agg(F.sum("loss").alias("s"), F.count("*").alias("c"))
    every = W.partitionBy("i")
    mean = (F.sum("s").over(every) - F.col("s")) / (F.sum("c").over(every) - F.col("c"))
    return _first_least(each.withColumn("mean", F.round(mean, 10)), ["fold"]).select("fold", "temperature")


def served(rows: DataFrame, temperature: Column | float) -> DataFrame:
    """rows with p at the temperature, whose own product with an earlier one is kept in inference_temperature."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    had = F.coalesce(F.col("inference_temperature"), F.lit(1.0)) if "inference_temperature" in rows.columns else F.lit(1.0)
    return rows.withColumn("p", P.at_temperature(F.col("p"), F.col("logits"), t)).withColumn("logits", F.transform("logits", lambda x: x / t)).withColumn("inference_temperature", had * t)


def raw(rows: DataFrame) -> DataFrame:
    """rows as they were before any temperature: logits times the kept temperature, p from them."""
    t = F.coalesce(F.col("inference_temperature"), F.lit(1.0))
    rows = rows.withColumn("logits", F.when(t == 1.0, F.col("logits")).otherwise(F.transform("logits", lambda x: x * t)))
    return rows.withColumn("p", F.when(t == 1.0, F.col("p")).otherwise(P.softmax(F.col("logits")))).withColumn("inference_temperature", F.lit(1.0))


def pool(reads: DataFrame, sources: Mapping[str, Sequence[str]] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The knowable rows of reads (a column ``read`` names each) that a pooled temperature is fitted on: a read with sources gives only those, and no record whose id exclude has."""
    rows = reads
    for read, own in (sources or {}).items():
        rows = rows.where((F.col("read") != read) | F.col("source").isin(*own))
    rows = rows.where((F.col("variant") == "clean") & (F.col("source") != "unknowable"))
    return rows if exclude is None else rows.join(exclude.select("id").distinct(), "id", "left_anti")


def temperature_interval(rows: DataFrame, temperatures: Sequence[float] | None = None, level: float = 0.9, samples: int = 2000, keys: Sequence[str] = ()) -> DataFrame:
    """keys, questions, temperature, lower, upper: the grid's first temperature of least mean loss over all questions, and the interval of what the same fit gives on resamples of clusters within each source.

    A cluster is an array of its losses on the grid, summed once; a resample adds up the arrays of the clusters it draws, one column a grid point, and takes the place of the least. Rows x grid x samples are never there.
    """
    points = list(temperatures or grid())
    z, y = F.col("logits"), F.col("label")
    at = lambda t: P.let(F.array_max(z), lambda m: F.ln(P.total(F.transform(z, lambda x: F.exp((x - m) / t)))) - (F.get(z, y) - m) / t)
    lossy = rows.withColumn("_losses", F.transform(F.array(*map(F.lit, points)), at))
    sums = {f"_g{k}": F.get("_losses", F.lit(k)) for k in range(len(points))}
    least = lambda df: P.let(F.array(*[F.round(F.col(c), 9) for c in sums]), lambda g: F.get(F.array(*map(F.lit, points)), (F.array_position(g, F.array_min(g)) - 1).cast("int")))
    fits = resampled(lossy, sums, samples, keys)
    fits = fits.select(*keys, least(fits).alias("t")).groupBy(*keys).agg(F.percentile("t", F.array(F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2))).alias("q"))
    point = lossy.groupBy(*keys).agg(F.count("*").alias("questions"), *[F.sum(c).alias(n) for n, c in sums.items()])
    point = point.select(*keys, "questions", least(point).alias("temperature"))
    both = point.join(fits, list(keys)) if keys else point.crossJoin(fits)  # without keys one row each
    return both.select(*keys, "questions", "temperature", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))
