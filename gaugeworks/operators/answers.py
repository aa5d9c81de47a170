"""Typed questions and their answers: keys and labels, probabilities by key, served answers, correctness, chance, agreement of two reads.

A question is of type noul (no or yes), choice (one of its criteria) or score (a level from 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import probability as P


def question_keys(type_: Column, criteria: Column) -> Column:
    """Criteria of a choice in their order; false, true; levels as text. Null for another type."""
    levels = F.transform(F.sequence(F.lit(0), F.size(criteria) - 1), lambda i: i.cast("string"))
    return F.when(type_ == "choice", criteria).when(type_ == "noul", F.array(F.lit("false"), F.lit("true"))).when(type_ == "score", levels)


def label_index(keys: Column, label: Column) -> Column:
    """The place of label among keys, from 0; null where it is not one."""
    at = F.array_position(keys, label)
    return F.when(at > 0, at - 1).cast("int")


def rounded(p: Column) -> Column:
    """Four decimals of the double as it is, not as it is printed: 0.00015 lies below the half and 0.00025 above it; only a true half, as 0.03125, goes to the even digit.

    p * 10000 is compared with the half without loss: p is split into 26 leading bits and the rest, whose products with 10000 are exact.
    """

    def of(x: Column) -> Column:
        return P.let(x * 134217729.0, lambda c: P.let(c - (c - x), lambda high: P.let(F.floor(x * 10000), lambda k: decided(k, (high * 10000 - (k + 0.5)) + (x - high) * 10000))))

    def decided(k: Column, over: Column) -> Column:
        up = (over > 0) | ((over == 0) & (k % 2 != 0))
        return (k + up.cast("int")) / 10000.0

    return F.when(F.isnan(p), p).when(F.abs(p) < 1e9, of(p.cast("double"))).otherwise(p)


def answered(rows: DataFrame) -> DataFrame:
    """rows (type, keys, p) with what is served: choice, noul or score by type, confidence (none for noul), rounded probabilities in order of keys."""
    type_, p = F.col("type"), F.col("p")
    confidence = F.when(type_ == "choice", P.choice_confidence(p)).when(type_ == "score", P.score_confidence(p))
    return rows.withColumns({
        "choice": F.when(type_ == "choice", F.get("keys", P.first_argmax(p))), "noul": F.when(type_ == "noul", rounded(F.get(p, F.lit(1)))),
        "score": F.when(type_ == "score", rounded(P.expected_level(p))), "confidence": rounded(confidence), "probabilities": F.when(type_ != "noul", F.transform(p, rounded)),
    })


def to_probs(answers: DataFrame) -> DataFrame:
    """answers (type, keys, noul, probabilities) with p over keys: of noul its number's complement and the number, else as served."""
    p = F.when(F.col("type") == "noul", F.array(1.0 - F.col("noul"), F.col("noul"))).otherwise(F.col("probabilities"))
    return answers.withColumn("p", p)


def correct(label: Column) -> Column:
    """Of an answered row: the chosen key is the label; noul of a half or more is true; the score rounds (half to even) to the level."""
    noul = (F.col("noul") >= 0.5) == (label == "true")
    return F.when(F.col("type") == "choice", F.col("choice") == label).when(F.col("type") == "noul", noul).otherwise(F.bround("score", 0).cast("long") == label.cast("long"))


def chance(questions: DataFrame, record: str = "id", size: str = "k") -> DataFrame:
    """A row a record: its questions, the mean score of random answers to them, and the chance that random answers are all right."""
    return questions.groupBy(record).agg(F.count("*").alias("n"), F.avg(1.0 / F.col(size)).alias("accuracy"), F.product(1.0 / F.col(size)).alias("case_exact"))


def parity(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two reads of the same questions (id, question, p; new also bucket, part, efficient), by bucket and by bucket/part: greatest and mean
    of the largest change of a probability, changed first choices, rows of the efficient kernels."""
    both = new.join(old.select("id", "question", F.col("p").alias("old")), ["id", "question"])
    dp = F.array_max(F.zip_with("p", "old", lambda a, b: F.abs(a - b)))
    flip = (P.first_argmax(F.col("p")) != P.first_argmax(F.col("old"))).cast("int")
    each = both.select(F.explode(F.array("bucket", F.concat_ws("/", "bucket", "part"))).alias("key"), dp.alias("dp"), flip.alias("flip"), "efficient")
    return each.groupBy("key").agg(F.count("*").alias("questions"), F.round(F.max("dp"), 4).alias("max_dp"), F.round(F.avg("dp"), 5).alias("mean_dp"), F.sum("flip").alias("argmax_flips"), F.count_if("efficient").alias("efficient_rows"))


def by_source(traces: DataFrame, points: DataFrame) -> DataFrame:
    """Traces (id, source, n_thinking_tokens, correct: null where nothing can be checked, unparsed) and their points (id): a row a source.

    The rate of correct ones is null for a source without one that could be checked; a null source is unknown, null tokens count as 0."""
    own = points.groupBy("id").agg(F.count("*").alias("points"))
    t = traces.join(own, "id", "left").withColumn("points", F.coalesce("points", F.lit(0)))
    graded = F.col("correct").isNotNull()
    return t.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("correct_rate"), F.avg(F.coalesce("n_thinking_tokens", F.lit(0))).alias("mean_thinking_tokens"),
        F.avg((F.col("points") > 0).cast("int")).alias("coverage"), F.avg("points").alias("points_per_trace"), F.count_if("unparsed").alias("n_unparsed"), (F.count_if(graded) + F.count_if("unparsed")).alias("n_graded"),
    )
