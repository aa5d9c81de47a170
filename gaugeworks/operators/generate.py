"""Augmentation of choice records, driven by hashes of their ids: the same record always gives the same variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1): the first 40 bits of an MD5 of seed and columns, so other engines draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])), 1, 10), 16, 10).cast("long") / float(1 << 40)


def permuted(keys: Column, seed: int, id_: Column) -> Column:
    """keys in the order of their MD5 with seed and id."""
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string"), k)).alias("o"), k.alias("k")))), lambda s: s["k"])


def augmented(records: DataFrame, seed: int = 0, p_none: float = 0.1, p_none_distract: float = 0.12, p_distract: float = 0.15, distractor: str = "something else") -> DataFrame:
    """id, keys, label, variant: options permuted, and by one draw either the gold option gives way to 'none' (only with over two options), or
    'none' is added as a distractor, or another distractor is. Records with a soft target are only permuted."""
    u, keys = uniform(seed, "id"), F.col("keys")
    gold = F.get(keys, F.col("label"))
    plain = F.col("target").isNull() if "target" in records.columns else F.lit(True)
    kind = F.when(~plain, "permuted").when((u < p_none) & (F.size(keys) > 2), "none").when((u >= p_none) & (u < p_none + p_none_distract), "none_distractor").when((u >= p_none + p_none_distract) & (u < p_none + p_none_distract + p_distract), "distractor").otherwise("permuted")
    r = records.withColumn("gold", gold).withColumn("variant", kind)
    options = F.when(F.col("variant") == "none", F.concat(F.filter(keys, lambda k: k != F.col("gold")), F.array(F.lit("none")))).when(F.col("variant") == "none_distractor", F.concat(keys, F.array(F.lit("none")))).when(F.col("variant") == "distractor", F.concat(keys, F.array(F.lit(distractor)))).otherwise(keys)
    r = r.withColumn("keys", permuted(options, seed + 1, F.col("id"))).withColumn("gold", F.when(F.col("variant") == "none", "none").otherwise(F.col("gold")))
    return r.select("id", "keys", (F.array_position("keys", F.col("gold")) - 1).cast("int").alias("label"), "variant")


def none_pairs(records: DataFrame, seed: int = 0) -> DataFrame:
    """Two siblings of each record in one option order: with the gold option (label on it), and without (label on 'none')."""
    gold = F.get("keys", F.col("label"))
    all_ = permuted(F.concat("keys", F.array(F.lit("none"))), seed, F.col("id"))
    r = records.withColumn("gold", gold).withColumn("all", all_)
    case = lambda s, keys, label: F.struct(F.lit(s).alias("sibling"), keys.alias("keys"), (F.array_position(keys, label) - 1).cast("int").alias("label"))
    less = F.filter("all", lambda k: k != F.col("gold"))
    return r.select(F.col("id").alias("pair_id"), F.explode(F.array(case("a", F.col("all"), F.col("gold")), case("b", less, F.lit("none")))).alias("c")).select("pair_id", "c.*")


def targets(records: DataFrame) -> DataFrame:
    """records with target: the given weights over keys, normalised, else one-hot; no mass raises."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    hot = F.transform("keys", lambda _, k: F.when(k == F.col("label"), 1.0).otherwise(0.0))
    good = F.when(total > 0, total).otherwise(F.raise_error(F.concat(F.lit("no mass: "), F.col("id"))).cast("double"))
    return records.withColumn("target", F.when(F.col("weights").isNull(), hot).otherwise(F.transform("weights", lambda x: x / good)))


def perturbed(records: DataFrame, additions: dict[str, str]) -> DataFrame:
    """id, addition, state: each record once as it is and once with each addition after its state."""
    each = F.explode(F.array(F.struct(F.lit("none").alias("addition"), F.lit("").alias("text")), *[F.struct(F.lit(k).alias("addition"), F.lit("\n" + v).alias("text")) for k, v in additions.items()]))
    return records.select("id", "state", each.alias("a")).select("id", "a.addition", F.concat("state", "a.text").alias("state"))


def buried(records: DataFrame, pool: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """id, n, state: each record among texts of its source's pool, in hash order, while they fit the budget of characters; its place is by hash.

    A text that fits is taken, one that does not is passed over. Where a text is taken, all before it of its length were, so of each length only the
    first budget / length texts of a source can be and only they are joined to its records: about budget times its logarithm at most, whatever the
    pool's size (empty texts, which always fit, are all taken). A record whose source has no pool stands alone.
    """
    from pyspark.sql import Window as W

    hashed = pool.withColumn("_h", F.xxhash64(F.lit(seed), "text")).withColumn("_n", F.length("text"))
    some = hashed.withColumn("_k", F.row_number().over(W.partitionBy("source", "_n").orderBy("_h", "text"))).where(F.col("_k").cast("long") * F.col("_n") <= budget)
    arrays = some.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("_h", "text"))).alias("p"))
    r = records.join(arrays, "source", "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<_h:bigint,text:string>>")))
    fits = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("t")), lambda a, x: F.when(a["used"] + F.length(x["text"]) + F.length("state") <= budget, F.struct((a["used"] + F.length(x["text"])).alias("used"), F.concat(a["t"], F.array(x["text"])).alias("t"))).otherwise(a), lambda a: a["t"])
    r = r.withColumn("t", fits(F.col("p"))).withColumn("n", F.size("t"))
    at = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("n") + 1).cast("int")
    return r.select("id", "n", F.array_join(F.concat(F.slice("t", F.lit(1), at), F.array("state"), F.slice("t", at + 1, F.col("n"))), "\n\n").alias("state"))
