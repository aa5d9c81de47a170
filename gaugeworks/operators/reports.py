"""Trial ledgers, gates and small reports: recipes, baselines, rates by kind, permutation spread, matched controls, costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.operators.packing import numbered
from gaugeworks.operators.paired import draw

#: Hourly prices of accelerators, in cost bounds.
HOURLY = {"H100": 3.95, "H200": 4.54, "B200": 6.25, "T4": 0.59}


def recipe(config: Column, without: Sequence[str] = ("seed", "snapshot")) -> Column:
    """Digest of a map of settings, less some of them, in key order."""
    entries = F.array_sort(F.map_entries(F.map_filter(config, lambda k, _: ~k.isin(*without))))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "\n"), 256)


def changed_settings(config: Column, defaults: Mapping[str, str], infrastructure: Sequence[str] = ()) -> Column:
    """Settings that differ from their defaults."""
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_filter(config, lambda k, v: ~k.isin(*infrastructure) & ~v.eqNullSafe(F.try_element_at(known, k)))


def release_candidates(trials: DataFrame, gates: Sequence[str]) -> DataFrame:
    """recipe, seeds, candidate: all gates pass in every trial and two seeds or more."""
    passed = F.bool_and(F.forall(F.array(*[F.coalesce(F.col(g), F.lit(False)) for g in gates]), lambda x: x))
    return trials.groupBy("recipe").agg(F.count_distinct("seed").alias("seeds"), passed.alias("passed")).select("recipe", "seeds", (F.col("passed") & (F.col("seeds") >= 2)).alias("candidate"))


def against_baseline(trials: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """trials with the value of the first trial of their keys, and the difference."""
    first = F.first_value(value).over(W.partitionBy(*keys).orderBy(order))
    return trials.withColumn("baseline", first).withColumn("gain", F.col(value) - F.col("baseline"))


def gate(accuracies: DataFrame, baseline: DataFrame, slack: float = 0.05) -> DataFrame:
    """passed, worst: every task's accuracy at least the baseline's less slack; a task the baseline lacks passes."""
    d = accuracies.join(baseline.withColumnRenamed("acc", "base"), "task", "left").withColumn("d", F.coalesce(F.col("acc") - F.col("base"), F.lit(0.0)))
    return d.agg(F.bool_and(F.col("d") >= -slack).alias("passed"), F.min("d").alias("worst"))


def rates(rows: DataFrame, kinds: Sequence[str], events: Mapping[str, Column]) -> DataFrame:
    """Mean of each event by each of kinds on its own (a grouping set each), ``by`` and ``name``; an event that is null does not count."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("by"), F.col(k).cast("string").alias("name")) for k in kinds]))
    flat = rows.select(each.alias("g"), *[c.cast("double").alias(n) for n, c in events.items()])
    return flat.groupBy("g.by", "g.name").agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in events])


def permutation_spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, spread (greatest over options of max - min of p), flips: of several answers to one question (p in the same order)."""
    each = rows.select(*keys, F.posexplode("p").alias("k", "x")).groupBy(*keys, "k").agg((F.max("x") - F.min("x")).alias("d"))
    best = rows.groupBy(*keys).agg((F.count_distinct(F.array_position("p", F.array_max("p"))) > 1).alias("flips"))
    return each.groupBy(*keys).agg(F.max("d").alias("spread")).join(best, list(keys))


def matched_controls(rows: DataFrame, keys: Sequence[str], case: Column, control: Column, order: Column) -> DataFrame:
    """case_id, control_id: each case with one control of its keys, none used twice; cases without one go."""
    w = W.partitionBy(*keys).orderBy(order)
    a = rows.where(case).select(*keys, F.col("id").alias("case_id"), F.row_number().over(w).alias("_k"))
    b = rows.where(control).select(*keys, F.col("id").alias("control_id"), F.row_number().over(w).alias("_k"))
    return a.join(b, [*keys, "_k"]).drop("_k")


#: Ranges that a shuffle key's numbers are counted by.
_RANGES = 4096


def repeated_splits(rows: DataFrame, splits: int = 200, thresholds: Sequence[float] = (), most_loss: float = 0.01) -> DataFrame:
    """seed, tau, loss, saving: on each half split of every source choose tau by the first half (most saving with at most most_loss, of equal ones the least tau), judge it on the second. A seed for which no tau keeps to most_loss has no row.

    rows: id, source, conf, ok, slow_ok, slow_cost. A source's rows are numbered by id once; for each seed a fixed congruence turns the numbers into distinct keys in another order, and the half with the lesser keys (less one of an
    odd number) is the first. The key in the middle is found by counting keys in ranges, then in the one range it falls in, so rows x splits are never shuffled: they are read twice and summed by task.
    """
    numbers = numbered(rows, ["source"], ["id"], "slot")
    size = numbers.groupBy("source").agg(F.floor(F.count("*") / 2).alias("half"))
    prime = 2_147_483_647
    seeds = numbers.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("key", draw(F.col("seed").cast("long"), F.col("slot"), F.lit(prime)))
    place = F.floor(F.col("key") * _RANGES / prime).cast("int")
    counts = seeds.groupBy("source", "seed", place.alias("range")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("source", "seed").orderBy("range"))
    middle = counts.withColumn("upto", upto).join(size, "source").where((F.col("upto") > F.col("half")) & (F.col("upto") - F.col("n") <= F.col("half")))
    middle = middle.select("source", "seed", "range", (F.col("half") - F.col("upto") + F.col("n")).alias("left"))
    # the first key of the second half: as many keys of its range are below it as are left
    near = seeds.withColumn("range", place).join(middle, ["source", "seed", "range"])
    cut = near.groupBy("source", "seed").agg(F.get(F.array_sort(F.collect_list("key")), F.first("left").cast("int")).alias("cut"))
    halves = seeds.join(cut, ["source", "seed"]).withColumn("dev", F.col("key") < F.col("cut"))
    low = lambda t: F.col("conf") < t
    sums = [F.struct(F.lit(t).alias("tau"), F.avg(F.when(low(t), F.col("slow_ok")).otherwise(F.col("ok")).cast("double") - F.col("slow_ok").cast("double")).alias("gain"), (1 - F.sum(F.when(low(t), F.col("slow_cost")).otherwise(0)) / F.sum("slow_cost")).alias("saving")) for t in thresholds]
    sums = halves.groupBy("seed", "dev").agg(F.array(*sums).alias("t")).select("seed", "dev", F.explode("t").alias("t")).select("seed", "dev", "t.*")
    dev = sums.where("dev and gain >= " + repr(-most_loss)).groupBy("seed").agg(F.max_by("tau", F.struct("saving", -F.col("tau"))).alias("tau"))
    test = sums.where("not dev").select("seed", "tau", (0.0 - F.col("gain")).alias("loss"), "saving")
    return dev.join(test, ["seed", "tau"])


def split_summary(splits: DataFrame, most_loss: float = 0.01, bar: float = 0.3) -> DataFrame:
    """splits, mean_loss, p90_loss, mean_saving, meeting of repeated_splits(): one row; p90 is the sorted loss at int(0.9 n), meeting the share that keeps to most_loss and saves the bar."""
    s = F.sort_array(F.collect_list("loss"))  # a number a split
    return splits.agg(F.count("*").alias("splits"), F.avg("loss").alias("mean_loss"), F.get(s, F.least(F.floor(0.9 * F.count("*")), F.count("*") - 1).cast("int")).alias("p90_loss"), F.avg("saving").alias("mean_saving"), F.avg(((F.col("loss") <= most_loss) & (F.col("saving") >= bar)).cast("double")).alias("meeting"))


def cost_bound(jobs: DataFrame) -> DataFrame:
    """jobs with usd: hourly price * seconds / 3600 * trials * (1 + retries); an unknown accelerator has a null price."""
    price = F.try_element_at(F.create_map(*[F.lit(x) for kv in HOURLY.items() for x in kv]), F.col("gpu"))
    return jobs.withColumn("usd", price * F.col("seconds") / 3600 * F.col("trials") * (1 + F.col("retries")))


def parsed_jobs(jobs: Column) -> Column:
    """'run@suite@name[@--flags]' parted from the right, so a run may hold an at sign."""
    parts = F.split(jobs, "@")
    flagged = F.element_at(parts, -1).startswith("--")
    core = F.when(flagged, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.struct(F.array_join(F.slice(core, F.lit(1), F.size(core) - 2), "@").alias("run"), F.get(core, F.size(core) - 2).alias("suite"), F.get(core, F.size(core) - 1).alias("name"), F.when(flagged, F.element_at(parts, -1)).alias("flags"))


def checked_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim, ok: the printed number is the fact at its printed precision; a path that does not name exactly one fact is not ok."""
    one = facts.groupBy("path").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    places = F.length(F.regexp_extract("printed", r"\.([0-9]+)", 1))
    close = F.abs(F.col("value") - F.col("printed").cast("double")) <= 0.5 * F.pow(F.lit(10.0), -places) + 1e-12
    return claims.join(one, "path", "left").select("claim", F.coalesce((F.col("n") == 1) & close, F.lit(False)).alias("ok"))


def soft_targets(teacher: Column, label: Column, weight: float) -> Column:
    """weight * teacher + (1 - weight) * one-hot label."""
    return F.transform(teacher, lambda x, k: weight * x + F.when(k == label, 1 - weight).otherwise(0.0))


def rotations(rows: DataFrame, r: int) -> DataFrame:
    """r cyclic rotations of each question's options: turn, keys, label of the rotated question."""
    k = F.size("keys")
    turned = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(r - 1)))).withColumn("at", F.col("turn") % k)
    return turned.select("id", "question", "turn", F.concat(F.slice("keys", F.col("at") + 1, k), F.slice("keys", F.lit(1), F.col("at"))).alias("keys"), ((F.col("label") - F.col("at") + k) % k).alias("label"))


def rotation_average(rows: DataFrame) -> DataFrame:
    """id, question, keys (in order of the first turn), p: softmax of the mean log probability of each option over its turns."""
    each = rows.select("id", "question", "turn", F.explode(F.arrays_zip("keys", "p", F.sequence(F.lit(0), F.size("keys") - 1).alias("k"))).alias("x"))
    mean = each.groupBy("id", "question", F.col("x.keys").alias("key")).agg(F.avg(F.ln(F.greatest("x.p", F.lit(1e-12)))).alias("z"), F.min_by(F.col("x.k"), "turn").alias("k"))
    w = W.partitionBy("id", "question")
    weighed = mean.withColumn("e", F.exp(F.col("z") - F.max("z").over(w))).withColumn("v", F.col("e") / F.sum("e").over(w))
    return weighed.groupBy("id", "question").agg(F.array_sort(F.collect_list(F.struct("k", "key", "v"))).alias("s")).select("id", "question", F.col("s.key").alias("keys"), F.col("s.v").alias("p"))


def predicted(requests: DataFrame, predictor, schema: str) -> DataFrame:
    """Rows of a predictor: a callable from a pandas frame of requests to one of predictions, applied batch by batch on the executors."""
    def run(batches):
        for b in batches:
            yield predictor(b)

    return requests.mapInPandas(run, schema)
