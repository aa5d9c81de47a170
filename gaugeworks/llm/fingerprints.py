"""Document fingerprints (8): consistent weighted sampling, with DataFrame functions only.

A document's weighted terms are its words (runs of characters that are not white space) and their counts. The occurrences (x, 0) to (x, w - 1) of a word x of count w are
parted by hash over 64 bins, so a word stands in each bin with a weight, the number of its occurrences there, and a frequent word is spread over the bins in proportion to its count.
Each bin draws one of its weighted terms by gamma variables: for a term x of weight w, hashes of bin and x alone give r and c of a gamma distribution with shape 2 and b uniform;
t = floor(ln w / r + b), the rank is ln a = ln c - r (t - b) - r, and the (x, t) of least rank is the bin's consistent sample.

Two documents draw the same sample in a bin with a chance equal to the generalised Jaccard similarity (sum of least over sum of greatest weights) of what they have in it. As the
lesser of two counts keeps its occurrences in each bin, what a bin has is a random part of all occurrences of both, therefore the share of equal samples among the bins that either document fills
is an estimate of the documents' similarity without bias (but for 16-bit hashes, 1 in 65536), whatever the counts. A fingerprint is a text of six hexadecimal digits for each filled bin:
the bin and 16 bits of the sample's hash.

Everything is a projection (arrays and higher-order functions) but for one shuffle of the texts, which brings neighbours together: documents are ranged by quantiles of
doc_id into groups of about ``in_group`` rows (at most MOST_GROUPS groups, so their bounds are small), a window looks one row ahead within a group, and the first row
of each group is also put at the end of the one above it, the very first at the very end.

The order is doc_id descending, null last, rows of one doc_id by a hash of their text. A null text is an empty one; texts without words have
an empty fingerprint; two empty fingerprints have likeness 1, an empty and another 0. Rows that repeat are documents of their own.
The only document is its own next one. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.llm.shared import SPACE

IN_GROUP, MOST_GROUPS = 1500, 10_000
_24 = float(1 << 24)


def _hashes(text: Column) -> Column:
    """Ascending hashes of all words."""
    return F.sort_array(F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _starts(values: Column) -> Column:
    """The places (from 1) in ascending values where a run of equal ones begins."""
    return F.filter(F.transform(values, lambda x, i: F.when((i == 0) | (x != F.get(values, i - 1)), i + 1)), lambda i: i.isNotNull())


def _run(values: Column, starts: Column, s: Column, k: Column) -> Column:
    """The length of the run at s, the k-th of starts."""
    return F.coalesce(F.get(starts, k + 1), F.size(values) + 1) - s


def _parted(words: Column, starts: Column) -> Column:
    """Ascending keys of all occurrences: 6 bits for the bin, which word and number of the occurrence give, then 58 bits of the word's hash."""
    key = lambda x, i: F.shiftleft(F.xxhash64(x, i), 58).bitwiseOR(F.shiftrightunsigned(x, 6))
    return F.sort_array(F.flatten(F.transform(starts, lambda s, k: F.transform(F.slice(words, s, _run(words, starts, s, k)), key))))


def _drawn(keys: Column, starts: Column) -> Column:
    """For each distinct key a number that orders by bin, then rank: bin, 32 bits of the rank, 16 bits of the sample. Each transform names what the next one uses more than once."""
    uniform = lambda h, shift: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 24) - 1)) + 0.5) / F.lit(_24)
    gamma = lambda h: -F.ln(uniform(h, 40) * uniform(h, 16))
    b = lambda v: (v["p"].bitwiseAND(F.lit(0xFFFF)) * 256 + v["q"].bitwiseAND(F.lit(0xFF)) + 0.5) / F.lit(_24)
    x = lambda s: F.get(keys, s - 1)
    named = F.transform(starts, lambda s, k: F.struct(x(s).alias("x"), F.xxhash64(x(s), F.lit(1)).alias("p"), F.xxhash64(x(s), F.lit(2)).alias("q"), F.ln(_run(keys, starts, s, k).cast("double")).alias("w")))
    drawn = F.transform(named, lambda v: F.struct(v["x"].alias("x"), v["w"].alias("w"), gamma(v["p"]).alias("r"), F.ln(gamma(v["q"])).alias("c"), b(v).alias("b")))
    timed = F.transform(drawn, lambda v: F.struct(v["x"].alias("x"), v["r"].alias("r"), v["c"].alias("c"), v["b"].alias("b"), F.floor(v["w"] / v["r"] + v["b"]).alias("t")))
    rank = lambda v: F.least(F.greatest(v["c"] - v["r"] * (v["t"] - v["b"] + 1), F.lit(-63.0)), F.lit(63.0)) + 64
    return F.sort_array(F.transform(timed, lambda v: F.shiftrightunsigned(v["x"], 58) * F.lit(1 << 48) + F.floor(rank(v) * F.lit(float(1 << 25))) * F.lit(1 << 16) + F.xxhash64(v["x"], v["t"]).bitwiseAND(F.lit(0xFFFF))))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column name: an ascending array of bin * 2**16 + sample. Each step is a projection of its own, so nothing is computed twice."""
    df = df.withColumn("_words", _hashes(F.col(text)))
    df = df.withColumn("_starts", _starts(F.col("_words")))
    df = df.withColumn("_keys", _parted(F.col("_words"), F.col("_starts"))).drop("_words", "_starts")
    df = df.withColumn("_starts", _starts(F.col("_keys")))
    df = df.withColumn("_drawn", _drawn(F.col("_keys"), F.col("_starts"))).drop("_keys", "_starts")
    got = F.col("_drawn")
    bin_of = lambda v: F.shiftright(v, 48)
    first = F.filter(got, lambda v, i: (i == 0) | (bin_of(v) != bin_of(F.get(got, i - 1))))
    return df.withColumn(name, F.transform(first, lambda v: bin_of(v) * (1 << 16) + v.bitwiseAND(F.lit(0xFFFF)))).drop("_drawn")


def as_text(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda v: F.lpad(F.hex(v), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples among bins that a or b fills; 1 where both are empty."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, 16))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _group_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds below doc_id (-1 for null), found in two steps over about the square root of all bounds each."""
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*map(F.lit, bounds[::step])).cast("array<bigint>")
    at = F.size(F.filter(coarse, lambda s: s < doc_id))
    fine = F.slice(F.array(*map(F.lit, bounds)).cast("array<bigint>"), F.greatest(at - 1, F.lit(0)) * step + 1, F.lit(step))
    number = F.greatest(at - 1, F.lit(0)) * step + F.size(F.filter(fine, lambda s: s < doc_id))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(number)


def with_next(rows: DataFrame, columns: list[str], in_group: int = IN_GROUP, add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """add(rows) (doc_id bigint, _tie, columns...) with next_<column> of the next row in descending doc_id, the first one's for the last.

    add, which gives more columns, is only applied to rows that are sent on.
    """
    n = rows.select(F.count("*")).first()[0]
    groups = min(MOST_GROUPS, max(1, n // in_group))
    bounds: list[int] = []
    if groups > 1:
        shares = [k / groups for k in range(1, groups)]
        bounds = sorted(set(rows.select(F.percentile_approx("doc_id", shares, min(100_000, 20 * groups))).first()[0] or []))
    rows = rows.withColumn("_group", _group_of(F.col("doc_id"), bounds) if bounds else F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0)))
    tops = {r[0]: r[1] for r in rows.groupBy("_group").agg(F.max("doc_id")).collect()}  # at most MOST_GROUPS + 1 rows
    order = sorted(tops, reverse=True)
    ghosts = [(tops[below], above, 0) for above, below in zip(order, order[1:])] + ([(tops[order[0]], order[-1], 1)] if order else [])
    table = rows.sparkSession.createDataFrame(ghosts, "_top long, _into int, _wrap int")
    # the rows of a group's top doc_id stand at the end of the group above it, or (the very first) of the last one
    extra = rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("_top"))).select(*[c for c in rows.columns if c != "_group"], F.col("_into").alias("_group"), F.col("_wrap"), F.lit(True).alias("_ghost"))
    both = add(rows.withColumn("_wrap", F.lit(0)).withColumn("_ghost", F.lit(False))).unionByName(add(extra))
    near = W.partitionBy("_group").orderBy("_wrap", F.col("doc_id").desc_nulls_last(), "_tie")
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(near))
    return both.where("not _ghost").drop("_group", "_wrap", "_ghost")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = with_next(rows, ["text", "print"], add=lambda df: with_fingerprint(df, "text", "print"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = with_fingerprint(rows, "edited", "edited_print")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
