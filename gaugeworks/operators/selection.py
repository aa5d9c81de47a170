"""Admission with re-selection: pools choose their records one after another, a state that one has taken is no other's, and what fails in its final form is passed over.

The rule is one of turns: pools choose in their order; in a pool the strata take turns, each offering its next record; a record is refused for a reason of its own, for a key (a state, an origin) that an earlier record
holds, or for a group that has its share already; a pool stops at its quota. Whether a record is refused depends on what came before it, so a loop over records would be the plain way. Here all records are judged at once
against the choice of the round before, until no judgement changes: only one choice agrees with itself, and every round settles at least one more record, most of them nearly all.

A pool with a quota stops long before it has asked for all of its records, so a round judges a front: the first strata of each pool and the first records of each of these, as many as its quota is likely to ask for. Where the choice turns out
to ask a stratum for a record beyond the front, the pool's front is doubled, up to all it has, so the result is that over all records.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.functions import text as T
from gaugeworks.operators.packing import numbered
from gaugeworks.operators.scoring import canonical_json, semantic_hash
from gaugeworks.operators.suite import capped
from gaugeworks.sources.files import work_folder

#: Records whose refusals one task adds up.
BLOCK = 1 << 16

#: Strata of a pool, and records of a stratum, that the first front has beyond twice those that fill the quota.
SPARE = 16


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: a round reads what the one before it wrote, so plans stay short and lost executors cost no earlier round."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def first_of_state(rows: DataFrame, keys: Sequence[str], id: str = "id") -> DataFrame:
    """One row for each combination of keys (a source and its state, say): that of the smallest id. Combined before the shuffle, so a state that a third of the rows hold is no large group."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), id).alias("_row")).select(*keys, "_row.*")


def strings(state: Column) -> Column:
    """The string values of a JSON text at any depth, in order; names of fields are none."""
    found = F.regexp_extract_all(state, F.lit(r'("(?:[^"\\]++|\\.)*+"(?:\s*+:)?)'), F.lit(1))
    values = F.filter(found, lambda x: x.endswith('"'))
    return F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")


def fingerprint(state: Column) -> Column:
    """The digest of a JSON state's longest string (the first of equals); of the state itself where it has none. A policy with a case is known by its semantic hash, so the order of its sentences does not count. Null for null."""
    found = strings(state)
    longest = F.array_max(F.transform(found, lambda x, i: F.struct(F.char_length(x).alias("n"), (-i).alias("at"), x.alias("x"))))["x"]
    both = F.get_json_object(state, "$.policy").isNotNull() & F.get_json_object(state, "$.case").isNotNull()
    return F.when(both, semantic_hash(state)).otherwise(T.digest(F.coalesce(longest, canonical_json(state))))


def fresh(rows: DataFrame, reserved: DataFrame, by: Sequence[Sequence[str]]) -> DataFrame:
    """rows that agree with none of reserved on any list of columns in by (a fingerprint, or repository, split and row). A null agrees with nothing.

    Each list is an anti-join against its distinct values, so a value that many reserved rows hold travels once.
    """
    for columns in by:
        rows = rows.join(reserved.select(*columns).dropna().distinct(), list(columns), "left_anti").select(*rows.columns)
    return rows


def training_states(records: DataFrame) -> DataFrame:
    """text_sha256 of what a suite trains or calibrates on, each once."""
    return records.where("split in ('train', 'calibration')").select("text_sha256").dropna().distinct()


def _shares(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By block and by stratum: how many may be admitted before the block; how many turns the stratum gets, and the last turn of its pool.

    A pool's quota is poured over its strata: each gets T turns or all it has, and the first of those with more get one beyond. Rows are strata here, not records.
    """
    strata = ["pool", "stratum"]
    sums = table.groupBy(*strata, "block").agg(F.sum(F.col("why").isNull().cast("long")).alias("open"), F.max("quota").alias("quota"))
    before = F.coalesce(F.sum("open").over(W.partitionBy(*strata).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = sums.groupBy(*strata).agg(F.sum("open").alias("total"), F.max("quota").alias("quota"))
    pool, rising = W.partitionBy("pool"), W.partitionBy("pool").orderBy("total", "stratum")
    # a pool with fewer than its quota is asked for all it has; one with just as many stops at the last of these
    each = each.withColumn("size", F.sum("total").over(pool)).withColumn("whole", F.col("size") < F.col("quota")).withColumn("quota", F.least("size", "quota"))
    lower = F.coalesce(F.sum("total").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wide = F.count("*").over(pool) - F.row_number().over(rising) + 1  # strata with as many or more
    each = each.withColumn("_lower", lower).withColumn("_wide", wide)
    # the strata from the first, by size, that the level does not fill: that first one says how high it stands, the others no more
    level = F.when(F.col("_lower") + F.col("total") * F.col("_wide") >= F.col("quota"), F.floor((F.col("quota") - F.col("_lower")) / F.col("_wide")))
    each = each.withColumn("level", F.max(level).over(pool))
    left = F.col("quota") - F.sum(F.least("total", "level")).over(pool)
    more = (F.col("total") > F.col("level")).cast("long")
    each = each.withColumn("_left", left).withColumn("_more", more).withColumn("_rank", F.sum("_more").over(pool.orderBy("stratum")))
    each = each.withColumn("take", F.least("total", "level") + F.when((F.col("_more") == 1) & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    last = F.max("take").over(pool)
    each = each.withColumn("last", last - 1).withColumn("last_stratum", F.max(F.when(F.col("take") == F.col("last") + 1, F.col("stratum"))).over(pool))
    return sums.select(*strata, "block", before.alias("_before")), each.select(*strata, "take", "last", "last_stratum", "whole")


def _turns(table: DataFrame) -> DataFrame:
    """table with turn, chosen and seen (offered before its pool stopped) under the refusals in why."""
    blocks, strata = _shares(table)
    w = W.partitionBy("pool", "stratum", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    out = table.withColumn("_in", F.coalesce(F.sum(F.col("why").isNull().cast("long")).over(w), F.lit(0)))
    out = out.join(blocks, ["pool", "stratum", "block"]).join(strata, ["pool", "stratum"]).withColumn("turn", F.col("_in") + F.col("_before"))
    chosen = F.col("why").isNull() & (F.col("turn") < F.col("take"))
    offered = F.col("whole") | (F.col("turn") < F.col("last")) | ((F.col("turn") == F.col("last")) & (F.col("stratum") <= F.col("last_stratum")))
    return out.withColumn("chosen", chosen).withColumn("seen", F.col("chosen") | (F.col("why").isNotNull() & offered)).drop("_in", "_before", "take", "last", "last_stratum", "whole")


def _judged(turns: DataFrame, per_group: int | None) -> DataFrame:
    """turns with what each record is refused for (now), going by the choice in turns."""
    at = F.struct("pool", "turn", "stratum")
    owners = turns.where("chosen").select(F.explode("keys").alias("_key"), at.alias("_at")).where("_key is not null").groupBy("_key").agg(F.min("_at").alias("_owned"))
    held = turns.where("own is null").select("id", F.explode("keys").alias("_key"), at.alias("_at")).join(owners, "_key").where("_owned < _at").select("id").distinct()
    out = turns.join(held.withColumn("_held", F.lit(True)), "id", "left")
    now = F.coalesce(F.col("own"), F.when(F.col("_held"), F.lit("duplicate_state")))
    out = out.withColumn("now", now).drop("_held")
    if per_group is None:
        return out
    kept = capped(out.where("now is null and `group` is not null").select("id", "pool", "group", "turn", "stratum", "place"), ["pool", "group"], per_group, ["turn", "stratum", "place"])
    out = out.join(kept.select("id", F.lit(True).alias("_kept")), "id", "left")
    over = F.col("now").isNull() & F.col("group").isNotNull() & F.col("_kept").isNull()
    return out.withColumn("now", F.when(over, F.lit("group_limit")).otherwise(F.col("now"))).drop("_kept")


def _fronts(table: DataFrame) -> DataFrame:
    """table (pool, quota, stratum, place) with size (of its stratum), nth (its stratum, from 0), strata (of its pool), wide (strata of the first front) and level: how often its pool's front is doubled until it has the record."""
    strata = written(numbered(table.groupBy("pool", "stratum").agg(F.count("*").alias("size")), ["pool"], ["stratum"], "nth"))
    strata = strata.join(strata.groupBy("pool").agg(F.count("*").alias("strata")), "pool")
    out = table.join(strata, ["pool", "stratum"])
    quota = F.least("quota", F.lit(1 << 40))
    out = out.withColumn("wide", 2 * quota + SPARE).withColumn("_deep", (2 * F.ceil(quota / F.col("strata")) + SPARE).cast("long"))
    doubled = lambda n, first: F.expr(f"CASE WHEN {n} < {first} THEN 0 ELSE length(bin({n} div {first})) END")
    return out.withColumn("level", F.greatest(doubled("nth", "wide"), doubled("place", "_deep"))).drop("_deep")


def _short(judged: DataFrame) -> DataFrame:
    """pool and the next level of the pools whose choice asks a stratum for a record that their front does not have."""
    chosen = F.col("chosen").cast("long")
    each = judged.groupBy("pool", "nth").agg(*[F.max(c).alias(c) for c in ("quota", "strata", "size", "front")], F.max("wide").alias("wide"), F.count("*").alias("n"), F.sum(F.col("seen").cast("long")).alias("seen"), F.sum(chosen).alias("chosen"), F.max(F.when(F.col("chosen"), F.col("turn"))).alias("turn"))
    asks = F.when((F.col("n") < F.col("size")) & (F.col("seen") == F.col("n")), F.struct(F.col("chosen").alias("turn"), "nth"))
    each = each.select("pool", "quota", "strata", "front", "wide", "chosen", "n", "size", F.when(F.col("turn").isNotNull(), F.struct("turn", "nth")).alias("stop"), asks.alias("asks"))
    pools = each.groupBy("pool").agg(*[F.max(c).alias(c) for c in ("quota", "strata", "front", "wide")], F.sum("chosen").alias("chosen"), F.max("stop").alias("stop"), F.min("asks").alias("asks"), F.bool_or(F.col("n") < F.col("size")).alias("cut"))
    wide = F.expr("wide * shiftleft(1L, front)")  # the first stratum outside
    beyond = F.when(wide < F.col("strata"), F.struct(F.lit(0).cast("long").alias("turn"), wide.alias("nth")))
    first = F.least("asks", beyond)
    unfilled = (F.col("chosen") < F.col("quota")) & (F.col("cut") | beyond.isNotNull())
    return pools.where(unfilled | (first < F.col("stop"))).select("pool", (F.col("front") + 1).alias("_next"))


def choose(rows: DataFrame, order: Sequence[str], per_group: int | None = None, final: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, pool, stratum, turn, status of every record that was offered: 'chosen', or what it was refused for.

    rows: id (one row an id), pool (pools choose in its order), quota (of its pool; null: no end), stratum, keys (an array; what may be held once), group (at most per_group of one in a pool; null: no limit), own (null, or a reason
    that refuses the record whatever else is chosen), and the columns of order, by which a stratum offers its records (ties by id). Null pool or stratum count as empty and are the first.

    final: chosen records (id, pool, stratum, turn) to the ids (id) among them that do not pass in their final form; those are passed over ('final_record_rejected') and the choice is made again, pool by pool, until all pass.
    It is called once for each time the choice is made, so what it reads should be narrow and written. No rows give no rows.

    All rows are ordered and written once; rounds judge the fronts, whose size hangs on the quotas. Pools without a quota, or with fewer records than it, are judged whole.
    """
    rows = rows.withColumn("pool", F.coalesce("pool", F.lit(-1).cast(rows.schema["pool"].dataType))).withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit("")))
    rows = rows.select("id", "pool", F.coalesce(F.col("quota").cast("long"), F.lit((1 << 62) - 1)).alias("quota"), "stratum", F.col("keys").cast("array<string>").alias("keys"), "group", F.col("own").cast("string").alias("own"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(order)])
    by = [f"_by{k}" for k in range(len(order))]
    table = numbered(rows, ["pool", "stratum"], [*by, "id"]).drop(*by)
    every = written(_fronts(table).withColumn("block", F.floor(F.col("place") / BLOCK)).withColumn("why", F.col("own")))
    table = every.where("level = 0").withColumn("front", F.lit(0))
    while True:
        judged = written(_judged(_turns(table), per_group))
        later = judged.drop("why", "turn", "chosen", "seen").withColumnRenamed("now", "why")
        if judged.where("seen and (why is null) <> (now is null)").limit(1).count():
            table = later
            continue
        short = written(_short(judged))
        at = short.agg(F.min("pool")).first()[0]
        # a pool's final forms are looked at when it and those before it have all they ask for; later pools may choose otherwise once this one has
        first = None
        if final is not None:
            settled = judged.where("chosen") if at is None else judged.where(F.col("chosen") & (F.col("pool") < F.lit(at)))
            settled = settled.select("id", "pool", "stratum", "turn")
            failed = written(settled.join(final(settled).select("id").distinct(), "id", "left_semi").select("id", "pool"))
            first = failed.agg(F.min("pool")).first()[0]
        if first is None and at is None:
            return judged.where("seen").select("id", "pool", "stratum", F.col("turn").cast("long").alias("turn"), F.when(F.col("chosen"), "chosen").otherwise(F.col("now")).alias("status"))
        if first is not None:
            out = failed.where(F.col("pool") == F.lit(first)).select("id", F.lit("final_record_rejected").alias("_failed"))
            later = later.join(out, "id", "left").withColumn("own", F.coalesce("own", "_failed")).withColumn("why", F.coalesce("why", "_failed")).drop("_failed")
        if at is not None:
            more = every.join(short, "pool").where("level = _next").withColumn("front", F.col("_next")).drop("_next")
            later = later.join(short, "pool", "left").withColumn("front", F.coalesce("_next", "front")).drop("_next").unionByName(more)
        table = later


def refusals(offered: DataFrame, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """keys, status, n: how many were chosen, and how many refused for what."""
    return offered.groupBy(*keys, "status").agg(F.count("*").alias("n"))
