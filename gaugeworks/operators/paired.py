"""Two systems on the same questions: strict joins, deltas, cluster bootstrap, exact tests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.packing import numbered

#: Of resampling: numbers of clusters (rows x columns) in a block, 64 MB; ranges of resamples; draws a task should make, and tasks at most.
BLOCK_CELLS, RANGES, TASK_DRAWS, MOST_TASKS = 8_000_000, 16, 50_000_000, 2_000
#: The congruence of draw() in one step.
MODULUS = 2147483647
FACTOR = 48271 * 16807 % MODULUS


def join_problems(a: DataFrame, b: DataFrame, keys: Sequence[str], equal: Sequence[str]) -> DataFrame:
    """problem, n: doubled keys of either side, keys of one side only, rows that differ in a column that must be equal."""
    twice = lambda df, name: df.groupBy(*keys).count().where("count > 1").select(F.lit(name).alias("problem"))
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in equal], F.lit(True).alias("in_a")).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in equal], F.lit(True).alias("in_b")), list(keys), "full_outer")
    differ = F.array(*[F.when(F.col("in_a") & F.col("in_b") & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(f"differs: {c}")) for c in equal], F.when(F.col("in_b").isNull(), F.lit("only in a")), F.when(F.col("in_a").isNull(), F.lit("only in b")))
    found = both.select(F.explode(F.filter(differ, lambda x: x.isNotNull())).alias("problem"))
    return found.union(twice(a, "twice in a")).union(twice(b, "twice in b")).groupBy("problem").agg(F.count("*").alias("n"))


def draw(b: Column, slot: Column, n: Column) -> Column:
    """A number from 0 to n-1 for a resample and a slot of it: a fixed linear congruence, the same in any SQL engine."""
    return F.pmod(F.pmod((b * 1000003 + slot * 7919 + 17) * 48271, F.lit(2147483647)) * 16807, F.lit(2147483647)) % n


def resampled(rows: DataFrame, sums: Mapping[str, Column], samples: int, keys: Sequence[str] = (), cluster: str = "grp", stratum: str = "source") -> DataFrame:
    """keys, b, and each of sums (a number of a row, as a double) over resample b: within each (keys, stratum) as many clusters as it has, drawn with replacement, a cluster's rows as often as it is drawn.

    Rows are summed by cluster first, and all sums of a resample come from the same draws. Clusters are numbered in two steps over ranges, then dealt as blocks of at most BLOCK_CELLS numbers, each block once for every
    range of resamples: a task draws its resamples, counts how often each cluster of the block comes, and multiplies counts by numbers. Draws never travel, only the clusters (RANGES times) and one row of sums a block
    and resample. A stratum of several blocks is drawn once for each of them.
    """
    by = [*keys, stratum]
    each = rows.groupBy(*by, cluster).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()]).dropna(subset=by)
    each = numbered(each, by, [cluster], "slot")
    size = each.groupBy(*by).agg(F.count("*").alias("_n"))
    block, ranges = max(1, BLOCK_CELLS // len(sums)), min(RANGES, samples)
    parts = min(MOST_TASKS, 1 + each.count() * samples // TASK_DRAWS)
    dealt = each.join(size, by).select(*by, "slot", "_n", F.floor(F.col("slot") / block).alias("_block"), F.array(*sums).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("_range"))
    group = [*by, "_block", "_range"]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    drawn = dealt.repartition(parts, *group).groupBy(*group).applyInArrow(_drawn(list(keys), len(sums), samples, ranges, block), f"{kinds + ', ' if kinds else ''}b long, _s array<double>")
    return drawn.groupBy(*keys, "b").agg(*[F.sum(F.get("_s", F.lit(k))).alias(n) for k, n in enumerate(sums)])


def _drawn(keys: list[str], width: int, samples: int, ranges: int, block: int):
    """Of one block of a stratum's clusters and one range of resamples: keys, b and the sums over the block's clusters that draw() gives; null where none of those drawn has a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        first = {c: got.column(c)[0].as_py() for c in ("_n", "_block", "_range")}
        n, low = first["_n"], first["_block"] * block
        place = got.column("slot").to_numpy() - low
        flat = got.column("_v").combine_chunks().flatten()
        there = np.empty((len(place), width), bool)
        there[place] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
        values = np.empty((len(place), width))
        values[place] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
        values[~there] = 0
        holes, finite = np.flatnonzero(~there.all(axis=0)), np.isfinite(values).all()
        # the congruence is linear: what the slot and what the resample adds, modulo MODULUS
        slots = (np.arange(n, dtype=np.int64) * 7919 % MODULUS * FACTOR % MODULUS).astype(np.uint32)
        every = range(first["_range"] * samples // ranges, (first["_range"] + 1) * samples // ranges)
        many = max(1, (1 << 22) // len(place))
        for at in range(0, len(every), many):
            some = every[at : at + many]
            counts = np.zeros((len(some), len(place)))
            for row, b in zip(counts, some):
                shift = np.uint32((b * 1000003 + 17) % MODULUS * FACTOR % MODULUS)
                for from_ in range(0, n, 1 << 20):
                    x = slots[from_ : from_ + (1 << 20)] + shift
                    x -= np.uint32(MODULUS) * (x >= MODULUS)
                    x -= x // np.uint32(n) * np.uint32(n)
                    if len(place) < n:
                        x = x[(x >= low) & (x < low + len(place))] - np.uint32(low)
                    row += np.bincount(x, minlength=len(place))
            out = counts @ values if finite else np.stack([c[c > 0] @ values[c > 0] for c in counts])
            empty = np.zeros(out.shape, bool)
            empty[:, holes] = counts @ there[:, holes] == 0
            empty |= counts.sum(axis=1, keepdims=True) == 0
            sums = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * width, pa.array(out.ravel(), mask=empty.ravel()))
            own = [pa.array([got.column(k)[0].as_py()] * len(some), got.schema.field(k).type) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, pa.array(some, pa.int64()), sums], names=[*keys, "b", "_s"])

    return run


def bootstrap_ratios(rows: DataFrame, ratios: Mapping[str, tuple[Column, Column]], samples: int = 1000, keys: Sequence[str] = (), cluster: str = "grp", stratum: str = "source", level: float = 0.95) -> DataFrame:
    """keys, name, delta, lower, upper of each ratio (sum of the first over sum of the second), and its interval over resamples of clusters."""
    sums = {f"_{part}{k}": c for k, pair in enumerate(ratios.values()) for part, c in zip("ab", pair)}
    named = lambda df: F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col(f"_a{k}") / F.nullif(F.col(f"_b{k}"), F.lit(0))).alias("m")) for k, n in enumerate(ratios)])).alias("x")
    each = resampled(rows, sums, samples, keys, cluster, stratum)
    each = each.select(*keys, named(each)).select(*keys, "x.name", "x.m")
    ends = each.groupBy(*keys, "name").agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2))).alias("q"))
    point = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    point = point.select(*keys, named(point)).select(*keys, "x.name", F.col("x.m").alias("delta"))
    return point.join(ends, [*keys, "name"]).select(*keys, "name", "delta", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))


def bootstrap_delta(pairs: DataFrame, value: str, samples: int = 1000, macro: bool = False, cluster: str = "grp", stratum: str = "source") -> DataFrame:
    """delta, lower, upper of the mean of value (micro) or of the tasks' means (macro), over cluster resamples; an additive statistic. Of tasks there are few: each has its two sums in a resample."""
    one = F.lit(1)
    if not macro:
        return bootstrap_ratios(pairs, {"delta": (F.col(value), one)}, samples, (), cluster, stratum).drop("name")
    tasks = [r[0] for r in pairs.select("task").distinct().orderBy("task").collect()]
    own = {f"_{part}{k}": F.when(F.col("task").eqNullSafe(F.lit(t)), c) for k, t in enumerate(tasks) for part, c in (("a", F.col(value)), ("b", one))}
    # a task that a resample leaves out is not among its means
    means = F.array_compact(F.array(*[F.col(f"_a{k}") / F.col(f"_b{k}") for k in range(len(tasks))]).cast("array<double>"))
    mean = lambda df: df.select(F.aggregate(means, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(means).alias("n")).select((F.col("s") / F.col("n")).alias("m"))
    ends = mean(resampled(pairs, own, samples, (), cluster, stratum)).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = mean(pairs.agg(*[F.sum(c).alias(n) for n, c in own.items()]))
    return point.crossJoin(ends).select(F.col("m").alias("delta"), F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))  # one row each


def index_interval(values: DataFrame, value: str, samples: int = 2000) -> DataFrame:
    """mean, lower, upper of row resamples; ends are the sorted means at int(.025 B) and min(B - 1, int(.975 B))."""
    v = F.col(value).cast("double")
    means = resampled(values.withColumn("_all", F.lit(0)), {"_s": v, "_c": F.lit(1)}, samples, (), "id", "_all").select((F.col("_s") / F.col("_c")).alias("m"))
    s = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # samples numbers
    return values.agg(F.avg(v).alias("mean")).crossJoin(s).select("mean", F.get("m", F.lit(int(0.025 * samples))).alias("lower"), F.get("m", F.lit(min(samples - 1, int(0.975 * samples)))).alias("upper"))


def bootstrap_index(outcomes: DataFrame, areas: Mapping[str, Sequence[str]], samples: int = 2000) -> DataFrame:
    """system, score, lower, upper, difference, d_lower, d_upper: the index of each system, its 95 % interval, and those of its difference from the first system by name (null for that one).

    outcomes has a row a record and system: dataset, record, system, correct, units, chance (units' chances summed). Each resample draws records within every dataset, the same for all systems; a dataset's skill is
    (score - chance) / (1 - chance) within 0 to 1, an area's the mean of its datasets', the index 100 times the mean of the areas'. Datasets outside areas are left out; a record that a system lacks adds nothing to it.
    """
    names = [r[0] for r in outcomes.select("system").distinct().orderBy("system").collect()]
    placed = {d: (a, len(ds)) for a, ds in areas.items() for d in ds}
    of = lambda n: F.col("system") == F.lit(n)
    sums = {f"_{c}{k}": F.when(of(n), F.col(c)) for k, n in enumerate(names) for c in ("correct", "units", "chance")}
    rows = outcomes.where(F.col("dataset").isin(*placed)).withColumn("_all", F.lit(0))

    def indexes(df: DataFrame, by: list[str]) -> DataFrame:
        ratio = lambda c, k: F.col(f"_{c}{k}") / F.col(f"_units{k}")
        skill = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio("correct", k) - ratio("chance", k)) / (1 - ratio("chance", k))))
        share = F.lit(0.0)
        for d, (_, n) in placed.items():
            share = F.when(F.col("dataset") == d, F.lit(100.0 / n / len(areas))).otherwise(share)
        return df.withColumn("_share", share).groupBy(*by).agg(*[F.sum(F.col("_share") * skill(k)).alias(f"i{k}") for k in range(len(names))])

    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("system"), F.col(f"i{k}").alias("i"), (F.col(f"i{k}") - F.col("i0") if k else F.lit(None).cast("double")).alias("d")) for k, n in enumerate(names)])).alias("x")).select("x.*")
    ends = F.array(F.lit(0.025), F.lit(0.975))
    each = long(indexes(resampled(rows, sums, samples, ["dataset"], "record", "_all"), ["b"])).groupBy("system").agg(F.percentile("i", ends).alias("q"), F.percentile("d", ends).alias("e"))
    point = long(indexes(rows.groupBy("dataset").agg(*[F.sum(c).alias(n) for n, c in sums.items()]), []))
    return point.join(each, "system").select("system", F.col("i").alias("score"), F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"), F.col("d").alias("difference"), F.get("e", F.lit(0)).alias("d_lower"), F.get("e", F.lit(1)).alias("d_upper"))


def exact_binomial(b: int, c: int) -> float:
    """Two-sided, of the discordant counts; 1 without any. The tail is summed from its greatest term down, each from the one before, until terms no longer count: about the root of b + c of them, whatever the counts."""
    n, k = b + c, min(b, c)
    if n == 0 or 2 * k == n:
        return 1.0
    top = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    term, tail, i = 1.0, 1.0, k
    while i > 0 and term > tail * 1e-17:
        term *= i / (n - i + 1)
        tail += term
        i -= 1
    return min(1.0, 2 * top * tail)


def mcnemar(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, b, c (right in one system only), p: the exact two-sided test."""

    @F.pandas_udf("double")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([exact_binomial(int(i), int(j)) for i, j in zip(x, y)])

    counts = pairs.groupBy(*keys).agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(~F.col(a) & F.col(b)).alias("c"))
    return counts.withColumn("p", test("b", "c"))


def averaged(runs: DataFrame, keys: Sequence[str] = ("id", "question")) -> DataFrame:
    """Mean p by option of several runs of the same questions (a row each), and logits = ln(max(p, 1e-12))."""
    each = runs.select(*keys, F.posexplode("p").alias("k", "x")).groupBy(*keys, "k").agg(F.avg("x").alias("x"))
    out = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("p"))
    return out.withColumn("logits", F.transform("p", lambda x: F.ln(F.greatest(x, F.lit(1e-12)))))


def realigned(rows: DataFrame, original: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows of permuted options beside their originals (o_keys, o_p), with p in the original's order."""
    o = original.select(*on, F.col("keys").alias("o_keys"), F.col("p").alias("o_p"))
    return rows.join(o, list(on)).withColumn("p", F.transform("o_keys", lambda k: F.get(F.col("p"), (F.array_position(F.col("keys"), k) - 1).cast("int"))))


def pair_flips(rows: DataFrame) -> DataFrame:
    """relevant, n, flip_rate, both_correct of contrastive pairs: siblings a and b by pair and question, compared by option name.

    A pair without one of its siblings, or with one twice, raises.
    """
    name = F.get(F.col("keys"), F.col("pred"))
    each = rows.groupBy("pair_id", "question").agg(*[F.max(F.when(F.col("sibling") == s, F.struct(name.alias("said"), F.get(F.col("keys"), F.col("label")).alias("truth"), (F.col("pred") == F.col("label")).alias("ok")))).alias(s) for s in "ab"], F.count("*").alias("n"))
    good = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("n") == 2)
    each = each.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("pair without both siblings, or one twice: "), "pair_id")).cast("boolean")))
    return each.groupBy((F.col("a.truth") != F.col("b.truth")).alias("relevant")).agg(F.count("*").alias("n"), F.avg((F.col("a.said") != F.col("b.said")).cast("double")).alias("flip_rate"), F.avg((F.col("a.ok") & F.col("b.ok")).cast("double")).alias("both_correct"))
