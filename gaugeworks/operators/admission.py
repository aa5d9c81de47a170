"""Admission to a suite: prepared source rows, spot checks of a frozen split, softened targets, the shift of odds under an option that does not matter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import probability as P
from gaugeworks.functions import text as T


def prepared(rows: DataFrame, names: Mapping[str, str], buckets: Sequence[tuple[str, int, int]]) -> DataFrame:
    """rows (text, name) with text trimmed, key (names of name), bucket (the first of (name, low, high) with low <= length < high) and the text's digest, where it has a bucket.

    Rows without text or of an unknown name are left out. A projection and a filter.
    """
    key = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = rows.withColumn("text", F.btrim(F.col("text"), F.lit(" \t\n\r\x0b\x0c"))).withColumn("key", F.try_element_at(key, F.col("name"))).where("text <> '' and key is not null")
    n = F.char_length("text")
    rows = rows.withColumn("bucket", F.coalesce(*[F.when((n >= low) & (n < high), F.lit(name)) for name, low, high in buckets]))
    return rows.withColumn("text_sha256", F.when(F.col("bucket").isNotNull(), T.digest(F.col("text"))))


def spot_sample(rows: DataFrame, seed: str, size: int = 50) -> DataFrame:
    """size rows (id, question, label) in order of sha256 of seed, id and question: a top-k, so no task sorts the table."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "id", "question"), 256), "id", "question").limit(size)


def spot_gate(sample: DataFrame, reviews: DataFrame, least: int) -> dict[str, int]:
    """Reviews (id, question, label, verdict) must be of the sample's rows, all of them, with its labels, and accept at least ``least``; else an error."""
    both = sample.withColumn("_s", F.lit(1)).join(reviews.withColumnRenamed("label", "_seen").withColumn("_r", F.lit(1)), ["id", "question"], "full")
    off = ~(F.col("label").eqNullSafe(F.col("_seen")) & F.col("_s").isNotNull() & F.col("_r").isNotNull())
    n, wrong, agreed = both.agg(F.count("*"), F.coalesce(F.sum(off.cast("int")), F.lit(0)), F.coalesce(F.sum((F.col("verdict") == "accept").cast("int")), F.lit(0))).first()
    if wrong:
        raise ValueError(f"{wrong} reviews or questions do not match the sample")
    if agreed < least:
        raise ValueError(f"{agreed} of {n} accepted, {least} needed")
    return {"agreed": agreed, "questions": n}


def softened(records: DataFrame, teacher: DataFrame, threshold: float = 0.6, weight: float = 0.5, ambiguous: bool = True) -> DataFrame:
    """records (id, question) of the teacher's chosen questions with target: weight of the teacher's p (label, p), the rest on the label.

    Chosen are all, or those where the teacher's first greatest option is not the label and is at least threshold likely.
    """
    if not (0.5 <= threshold < 1 and 0 < weight < 1):
        raise ValueError("threshold must be in [0.5, 1) and weight in (0, 1)")
    if ambiguous:
        teacher = teacher.where((P.first_argmax(F.col("p")) != F.col("label")) & (F.array_max("p") >= threshold))
    target = F.transform("p", lambda x, i: x * weight + F.when(i == F.col("label"), F.lit(1 - weight)).otherwise(0.0))
    return records.join(teacher.select("id", "question", target.alias("target")), ["id", "question"])


def odds_shift(rows: DataFrame) -> DataFrame:
    """rows (p, p_more: the same options and more behind them): how far the log odds of the two likeliest options of p move. One row; nulls but n for no rows."""
    order = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    rows = rows.select("p", "p_more", F.get(order, F.lit(0))["i"].alias("a"), F.get(order, F.lit(1))["i"].alias("b"))
    odds = lambda p: F.ln(F.greatest(F.get(p, F.col("a")), F.lit(1e-6)) / F.greatest(F.get(p, F.col("b")), F.lit(1e-6)))
    shift = rows.select((odds("p_more") - odds("p")).alias("s"))
    return shift.agg(F.count("*").alias("n"), F.avg(F.abs("s")).alias("mean_abs_shift"), F.avg("s").alias("mean_shift"), F.percentile(F.abs("s"), F.lit(0.9)).alias("p90_abs_shift"))
