"""Suite construction: hashing order in place of random draws, grouped splits, quotas, balance, votes, invariants."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hash_order(seed: int | str, *columns: Column | str) -> Column:
    """A fixed pseudo-random order: sha256 of 'seed:key'."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *columns), 256)


def hash_split(seed: int | str, key: Column | str, names: Sequence[str]) -> Column:
    """A split by the hash alone: the last eight hexadecimal digits modulo the number of names."""
    n = F.conv(F.right(hash_order(seed, key), F.lit(8)), 16, 10).cast("long") % len(names)
    return F.get(F.array(*map(F.lit, names)), n.cast("int"))


def select_unique(records: DataFrame, seen: DataFrame, count: int, order: Column, text_hash: str = "h", strict: bool = True) -> DataFrame:
    """The first count records by order, less those whose text is in seen (h), one for each text; fewer than count raises if strict."""
    fresh = records.join(seen.select(text_hash).distinct(), text_hash, "left_anti").withColumn("_o", order)
    first = fresh.withColumn("_k", F.row_number().over(W.partitionBy(text_hash).orderBy("_o"))).where("_k = 1")
    out = first.orderBy("_o").limit(count)
    if strict and (n := out.count()) < count:
        raise ValueError(f"{n} records, {count} needed")
    return out.drop("_o", "_k")


def capped(rows: DataFrame, keys: Sequence[str], cap: int, order: Sequence[Column | str]) -> DataFrame:
    """At most cap rows for each key, in order. A group-limit: Spark drops the rest before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def round_robin(rows: DataFrame, key: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """n rows: the first of each class in the order of classes, then the second of each, and so on; ``turn`` and ``place``."""
    ranked = capped(rows, [key], n, order).withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.orderBy("turn", key).limit(n)


def balanced_pairs(rows: DataFrame, stratum: str, label: str, pairs: int, order: Sequence[Column | str]) -> DataFrame:
    """pairs * 2 rows: the k-th true and the k-th false row of a stratum go together or not at all, round over the strata."""
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy(stratum, label).orderBy(*order))).where(F.col("k") <= pairs)
    t, f = (ranked.where(F.col(label) == v).select(stratum, "k", F.col("id").alias(n)) for v, n in ((True, "id_true"), (False, "id_false")))
    return t.join(f, [stratum, "k"]).orderBy("k", stratum).limit(pairs)


def quotas(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """key, quota: in proportion to size; floors, then one more to the largest remainders (ties by key)."""
    share = F.col(size) * total / F.sum(size).over(W.partitionBy())  # a row a class
    out = sizes.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    short = F.lit(total) - F.sum("_floor").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), key))
    return out.select(key, (F.col("_floor") + F.when(rank <= short, 1).otherwise(0)).cast("long").alias("quota"))


def first_groups(rows: DataFrame, family: str, group: str, first: Column, k: int) -> DataFrame:
    """rows with ``split``: the first k groups of each family (by the least of first) are calibration, the others train."""
    groups = rows.groupBy(family, group).agg(F.min(first).alias("_first"))
    groups = groups.withColumn("split", F.when(F.row_number().over(W.partitionBy(family).orderBy("_first", group)) <= k, "calibration").otherwise("train"))
    return rows.join(groups.drop("_first"), [family, group])


def fill_by_share(weights: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """group, split: in hash order each group goes where least is filled for its share (ties in the order of shares); a share of 0 gets none.

    The rule is sequential: one task streams the groups (not rows) in hash order and holds a number for each split.
    """
    names = [s for s, x in shares.items() if x > 0]
    if not names:
        raise ValueError("no split has a share")
    kind = weights.schema["group"].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.zeros(len(names))
        share = np.array([shares[s] for s in names])
        for batch in batches:
            to = []
            for w in batch.column("weight").to_pylist():
                k = int((level / share).argmin())
                level[k] += w
                to.append(names[k])
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(to, pa.string())], ["group", "split"])

    ordered = weights.select("group", F.col("weight").cast("double").alias("weight")).repartition(1).sortWithinPartitions(hash_order(seed, "group"))
    return ordered.mapInArrow(fill, f"group {kind}, split string")


def unanimous(votes: DataFrame, judges: int = 3) -> DataFrame:
    """item, label, how: 'agreed' where all judges voted alike, else 'split' (null label); a missing vote is no agreement."""
    each = votes.where("label is not null").groupBy("item").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    items = votes.select("item").distinct()
    agreed = (F.col("n") == judges) & (F.col("a") == F.col("b"))
    return items.join(each, "item", "left").select("item", F.when(agreed, F.col("a")).alias("label"), F.when(agreed, "agreed").otherwise("split").alias("how"))


def adjudicated(split: DataFrame, verdicts: DataFrame) -> DataFrame:
    """item, label: kept where two adjudicators gave one verdict (not drop) and one label; the last verdict of each counts."""
    last = verdicts.groupBy("item", "judge").agg(F.max_by(F.struct("verdict", "label"), "line").alias("v"))
    both = last.groupBy("item").agg(F.count("*").alias("n"), F.count_distinct("v").alias("kinds"), F.first("v").alias("v"))
    return split.join(both.where("n = 2 and kinds = 1 and v.verdict <> 'drop'"), "item").select("item", F.col("v.label").alias("label"))


def merged_duplicates(rows: DataFrame, text_hash: str, label: str, order: str) -> DataFrame:
    """One row for each text: the first by order; texts with more than one label go."""
    return rows.groupBy(text_hash).agg(F.count_distinct(label).alias("_n"), F.min(order).alias(order), F.min_by(label, order).alias(label), F.count("*").alias("copies")).where("_n = 1").drop("_n")


def split_problems(rows: DataFrame, group: str = "group", split: str = "split", id_: str = "id", text_hash: str = "h") -> DataFrame:
    """problem, n: groups in more than one split, ids and texts that occur more than once."""
    over = lambda name, key, what: rows.groupBy(key).agg(what.alias("c")).where("c > 1").agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    return over("group in several splits", group, F.count_distinct(split)).union(over("id twice", id_, F.count("*"))).union(over("text twice", text_hash, F.count("*")))


def contrast_cases(records: DataFrame, seed: int = 0) -> DataFrame:
    """Three variants of each choice record: none_present (the gold option gives way to 'none'), none_absent ('none' added) and permuted (hash order)."""
    keys, label = F.col("keys"), F.col("label")
    gold = F.get(keys, label)
    permuted = F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id"), k), 256).alias("o"), k.alias("k")))), lambda s: s["k"])
    case = lambda name, k, y: F.struct(F.lit(name).alias("variant"), k.alias("keys"), y.cast("int").alias("label"))
    cases = F.array(case("none_present", F.concat(F.filter(keys, lambda k: k != gold), F.array(F.lit("none"))), F.size(keys) - 1), case("none_absent", F.concat(keys, F.array(F.lit("none"))), label), case("permuted", permuted, F.array_position(permuted, gold) - 1))
    return records.select("id", F.explode(cases).alias("c")).select(F.concat("id", F.lit("/"), "c.variant").alias("id"), F.col("id").alias("parent_id"), "c.variant", "c.keys", "c.label")
