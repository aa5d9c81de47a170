"""Routing between a direct and a thinking answer, options put to a question, labels read off free text, padded lengths, flips under additions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bit_length(n: Column) -> Column:
    """Binary digits of n without its sign; 0 for 0."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(F.abs(n))))


def power_of_two(n: Column) -> Column:
    """The least power of two that is n or more; 2 for 0."""
    return F.pow(F.lit(2.0), bit_length(n - 1)).cast("long")


def padded_length(n: Column, steps: int = 8, floor: int = 16) -> Column:
    """n rounded up to one of ``steps`` steps a power of two, each of ``floor`` at least."""
    step = F.greatest(F.lit(floor).cast("long"), F.floor(power_of_two(n) / steps).cast("long"))
    return (F.ceil(n / step) * step).cast("long")


def padded_count(n: Column) -> Column:
    return padded_length(n, 4, 1)


def policies(rows: DataFrame, taus: Sequence[float]) -> DataFrame:
    """rows (direct_correct, thinking_correct, confidence, direct_tokens, thinking_tokens) under each policy: who thinks, what it costs, how often it is right.

    always_direct, always_thinking, oracle (thinks where only that is right) and one tau a threshold (thinks where confidence is less). One aggregate over one scan.
    """
    direct, thinks = F.col("direct_correct"), F.col("thinking_correct")
    named = {"always_direct": F.lit(False), "always_thinking": F.lit(True), "oracle": ~direct & thinks} | {f"tau_{t}": F.col("confidence") < t for t in taus}
    sums = []
    for k, up in enumerate(named.values()):
        sums += [F.sum(up.cast("long")).alias(f"u{k}"), F.sum(F.when(up, thinks).otherwise(direct).cast("long")).alias(f"c{k}"), F.sum(F.col("direct_tokens") + F.when(up, F.col("thinking_tokens")).otherwise(0)).alias(f"t{k}")]
    each = F.array(*[F.struct(F.lit(name).alias("policy"), F.col(f"u{k}").alias("up"), F.col(f"c{k}").alias("right"), F.col(f"t{k}").alias("total_tokens")) for k, name in enumerate(named)])
    one = rows.agg(F.count("*").alias("n"), *sums).where("n > 0").select("n", F.inline(each))
    return one.select("policy", "n", (F.col("right") / F.col("n")).alias("accuracy"), (F.col("total_tokens") / F.col("n")).alias("mean_tokens"), (F.col("up") / F.col("n")).alias("pct_escalated"), "total_tokens")


def drawn_options(moves: DataFrame, seed: str, tie: float = 0.01, limit: int = 10) -> DataFrame:
    """moves (grp, key, value): of each group the best key (of equal ones the least) and up to limit - 1 others that are worse by tie at least.

    Which others, and the order of all, follow sha256 of seed and key. Groups without another are left out. One shuffle, by group.
    """
    by = W.partitionBy("grp")
    hashed = lambda part: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(part), F.col("key")), 256)
    best = F.min_by("key", F.struct(-F.col("value"), F.col("key"))).over(by)
    kept = moves.withColumn("best", best).withColumn("top", F.max("value").over(by))
    kept = kept.where((F.col("key") == F.col("best")) | (F.col("value") <= F.col("top") - tie))
    kept = kept.withColumn("rank", F.row_number().over(by.orderBy((F.col("key") != F.col("best")).cast("int"), hashed("pick"), "key"))).where(F.col("rank") <= limit)
    order = F.array_sort(F.collect_list(F.struct(hashed("order").alias("h"), "key")))
    return kept.groupBy("grp", "best").agg(order.alias("o")).where("size(o) > 1").select("grp", "best", F.transform("o", lambda x: x["key"]).alias("options"))


def extracted_label(text: Column, keys: Sequence[str], synonyms: Mapping[str, Sequence[str]] = {}) -> Column:
    """The one key of which a form stands in text, whatever the case: as it is, with spaces or hyphens for underscores, or a synonym. Null for none or several."""
    low = F.lower(text)

    def stands(key: str) -> Column:
        forms = sorted({f.lower() for f in (key, key.replace("_", " "), key.replace("_", "-"), *synonyms.get(key, ())) if f})
        return F.coalesce(F.exists(F.array(*map(F.lit, forms)), lambda f: F.contains(low, f)), F.lit(False))

    found = F.array_compact(F.array(*[F.when(stands(k), F.lit(k)) for k in keys]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def flips(rows: DataFrame, by: str) -> DataFrame:
    """rows (by, clean, argmax, gold as numbers): how often an addition moves the answer, and to what. Answers are compared as whole numbers, halves to even; clean_wrong as they are."""
    whole = lambda c: F.bround(F.col(c), 0)
    flip, wrong = whole("argmax") != whole("clean"), whole("argmax") != whole("gold")
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), share(flip).alias("flip"), share(wrong).alias("wrong"), F.sum((flip & wrong).cast("long")).alias("flip_to_wrong"), F.sum((flip & ~wrong).cast("long")).alias("flip_to_right"), share(F.col("clean") != F.col("gold")).alias("clean_wrong"))


def leaked(rows: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The ids of rows (id, item_ref) of which the id or the item_ref is one of evaluated (id, item_ref)."""
    ids = rows.join(evaluated.select("id"), "id", "left_semi").select("id")
    refs = rows.join(evaluated.select("item_ref").where("item_ref is not null"), "item_ref", "left_semi").select("id")
    return ids.union(refs).distinct()
