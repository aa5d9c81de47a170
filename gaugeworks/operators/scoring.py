"""Scoring a suite: labelled requests and a predictor's answers become rows a question, with structure checks; digests of requests and states; a run that can be taken up again.

Requests: id, group_id, source, variant, state (JSON text), questions array<struct<qid, type, criteria array<string>, label, src>>, and where there are any parent_id, pair_id, sibling, control_id.
Answers of a prediction: array<struct<qid, keys array<string>, p array<double>, logits array<double>>> (logits may be null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import probability as P
from gaugeworks.operators import answers as A
from gaugeworks.operators import metrics
from gaugeworks.operators.packing import cut_off

ANSWERS = "array<struct<qid: string, keys: array<string>, p: array<double>, logits: array<double>>>"
QUESTIONS = "array<struct<qid: string, type: string, criteria: array<string>, label: string, src: string>>"
EXTRA = ("parent_id", "pair_id", "sibling", "control_id")


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object in order and no blanks; null where it is none. (The binary form of a JSON value keeps an object's fields in order.)"""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical JSON, so the order of keys does not count; of text that is no JSON, of that text as a JSON string."""
    return F.sha2(F.coalesce(canonical_json(text), F.concat(F.lit('"'), text, F.lit('"'))), 256)


def semantic_hash(state: Column) -> Column:
    """digest() of a state; of an object with policy and case, of its policy and the sentences of its case in order, so that a case told in another order counts as the same."""
    v = F.try_parse_json(state)
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    sentences = F.array_sort(F.transform(F.split(text("case"), r"\. "), lambda s: F.regexp_replace(s, r"\.+$", "")))
    told = F.to_json(F.struct(text("policy").alias("policy"), sentences.alias("sentences")))
    return F.when(text("policy").isNotNull() & text("case").isNotNull(), digest(told)).otherwise(digest(state))


def request_digest(requests: DataFrame) -> Column:
    """SHA-256 of what a predictor sees of a request: its state and its questions without labels."""
    seen = F.transform("questions", lambda q: F.struct(q["qid"].alias("qid"), q["type"].alias("type"), q["criteria"].alias("criteria")))
    return F.sha2(F.concat(F.coalesce(canonical_json(F.col("state")), F.col("state"), F.lit("")), F.to_json(seen)), 256)


def prediction_rows(predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of requests with their answers (a column ``answers``, ANSWERS, and ``error``, why the predictor could not, or null).

    A record is rejected whole, by the first of: its error; answers to other questions than asked, or to one twice; then, question by question in order, options other than asked, a probability that is no number from 0 to 1, a sum
    too far from 1, logits that are no finite number for every option. Rows: id, grp, question, source, task, type, variant, keys, label, parent and EXTRA, p (by the request's order of options, divided by its sum), raw_sum,
    zero_count, logits. A label that is no option leaves a null label.
    """
    has = set(predicted.columns)
    asked, got = F.transform("questions", lambda q: q["qid"]), F.transform("answers", lambda a: a["qid"])
    same = F.coalesce((F.size("answers") == F.size("questions")) & (F.size(F.array_except(asked, got)) == 0) & (F.size(F.array_distinct(got)) == F.size("answers")), F.lit(False))
    ids = F.when(F.col("error").isNotNull(), F.col("error")).when(~same, F.lit("answer ids differ from request ids"))
    df = predicted.withColumn("_ids", ids)
    each = df.select(*[c for c in predicted.columns if c not in ("questions", "answers", "error")], "_ids", "answers", F.posexplode_outer("questions").alias("_at", "q"))
    answer = F.get(F.filter("answers", lambda a: a["qid"] == F.col("q.qid")), F.lit(0))
    each = each.withColumn("keys", A.question_keys(F.col("q.type"), F.col("q.criteria"))).withColumn("_a", F.when(F.col("_ids").isNull(), answer)).drop("answers")
    place = lambda k: F.array_position(F.col("_a.keys"), k)
    ordered = lambda values: F.transform("keys", lambda k: F.when(place(k) > 0, F.get(values, (place(k) - 1).cast("int"))))
    each = each.withColumn("_p", ordered(F.col("_a.p"))).withColumn("logits", F.when(F.col("_a.logits").isNotNull(), ordered(F.col("_a.logits"))))
    each = each.withColumn("raw_sum", P.total(F.col("_p")))
    k = F.size("keys")
    options = (F.size("_a.keys") == k) & (F.size(F.array_except(F.col("keys"), F.col("_a.keys"))) == 0) & (F.size("_a.p") == k)
    inside = F.forall("_p", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    whole = (F.col("raw_sum") > 0) & (F.abs(F.col("raw_sum") - 1) <= F.greatest(F.lit(1e-5), 0.005 * k + 1e-8))
    finite = F.col("_a.logits").isNull() | ((F.size("_a.logits") == k) & F.forall("logits", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    fault = (
        F.when(F.col("_ids").isNotNull(), F.col("_ids")).when(~F.coalesce(options, F.lit(False)), "probability keys do not match requested options").when(~F.coalesce(inside, F.lit(False)), "non-finite or out-of-range probabilities")
        .when(~whole, "invalid probability sum").when(~F.coalesce(finite, F.lit(False)), "logit keys or values do not match the requested options")
    )
    # a record's questions stand in one row again, so its first fault is its own; a record is short
    spot = A.label_index(F.col("keys"), F.col("q.label"))
    label = F.when(F.col("q.type") == "choice", spot).otherwise(F.coalesce(spot, F.col("q.label").try_cast("int")))
    meta = [F.col("id"), F.col("group_id").alias("grp"), F.col("source"), F.col("variant"), *[(F.col(c) if c in has else F.lit(None).cast("string")).alias(c) for c in EXTRA]]
    row = F.struct("_at", fault.alias("fault"), F.col("q.qid").alias("question"), F.col("q.src").alias("task"), F.col("q.type").alias("type"), "keys", label.alias("label"), F.transform("_p", lambda x: x / F.col("raw_sum")).alias("p"), "raw_sum", F.size(F.filter("_p", lambda x: x == 0)).alias("zero_count"), "logits")
    key = [c for c in ("request_sha256",) if c in has]
    record = each.select(*meta, *key, row.alias("row")).groupBy("id", "grp", "source", "variant", *EXTRA, *key).agg(F.array_sort(F.collect_list("row"), lambda a, b: a["_at"] - b["_at"]).alias("rows"))
    record = record.withColumn("error", F.get(F.filter(F.transform("rows", lambda r: r["fault"]), lambda x: x.isNotNull()), F.lit(0)))
    parent = F.coalesce("parent_id", F.when(F.col("variant") == "clean", F.col("id").cast("string")).otherwise(F.col("grp").cast("string")))
    rows = record.where("error is null").withColumn("parent", parent).select("id", "grp", "source", "variant", "parent", *EXTRA[1:], *key, F.explode("rows").alias("r")).select("*", "r.*").drop("r", "_at", "fault").where("question is not null")
    return rows, record.where("error is not null").select("id", *key, "error")


def training_problems(requests: DataFrame, allowed: Sequence[str] = (), forbidden: Sequence[str] = (), families: Sequence[str] = (), held_structures: Sequence[str] = ()) -> DataFrame:
    """id, problem of training records: a source that is forbidden or not among the allowed ones (where there are any), a compositional record of a family not trained on (families, and those that begin with rand:) or of a held-out structure."""
    wrong = F.col("source").isin(*forbidden) | (~F.col("source").isin(*allowed) if allowed else F.lit(False))
    held = (F.col("source") == "compositional") & (F.col("structure").isin(*held_structures) | ~(F.col("family").isin(*families) | F.startswith("family", F.lit("rand:"))))
    problem = F.when(wrong, F.concat(F.lit("eval-only or undeclared training source: "), "source")).when(F.coalesce(held, F.lit(False)), "held-out compositional structure in training")
    return requests.select("id", problem.alias("problem")).where("problem is not null")


LINE = f"request_sha256 string, id string, answers {ANSWERS}, error string, latency_ms double"


def evaluate(requests: DataFrame, predict: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], folder: str, waves: int = 16) -> int:
    """Scores every request that the folder has no answer to, and returns how many there were.

    predict maps batches of requests (request_sha256 and all columns) to LINE. Requests are dealt over waves by their id; a wave's lines are committed together by the scored_lines sink, so a run that is killed has lost no more than its
    wave, and the next run, which finds the digests of what was committed, scores only the rest. Requests that are alike are scored once in a wave; of their lines, one is read.
    """
    from gaugeworks.sources.scored import ScoredLines

    spark = requests.sparkSession
    spark.dataSource.register(ScoredLines)
    lines = lambda: spark.read.format("scored_lines").load(folder)
    done = cut_off(lines().select("request_sha256"))
    before = done.count()
    # lines are strict JSON: what is no finite number is null in them, and is rejected like one
    finite = lambda xs: F.transform(xs, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    plain = lambda a: F.struct(a["qid"].alias("qid"), a["keys"].alias("keys"), finite(a["p"]).alias("p"), finite(a["logits"]).alias("logits"))
    for wave in range(waves):
        # dealt by id, so that a wave digests its own requests only; what earlier runs committed is left out
        part = requests.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).withColumn("request_sha256", request_digest(requests))
        part = part.join(done, "request_sha256", "left_anti").dropDuplicates(["request_sha256"])
        told = part.mapInPandas(predict, LINE).withColumn("answers", F.transform("answers", plain))
        told.write.format("scored_lines").mode("append").save(folder)
    return lines().count() - before


def evaluated(requests: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejected, report) of requests with the answers in the folder: rows scored, records rejected and why, and the metric block of each task, clean rows only."""
    lines = _lines(requests.sparkSession, folder).select("request_sha256", "answers", "error").dropDuplicates(["request_sha256"])
    keyed = requests.withColumn("request_sha256", request_digest(requests)).join(lines, "request_sha256")
    rows, rejected = prediction_rows(keyed)
    rows = cut_off(metrics.scored(rows, logits="logits"))  # the report's aggregates read them several times
    return rows, rejected, metrics.metric_block(metrics.knowable(rows), ["task"])


def coverage(requests: DataFrame, rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """requested_records, requested_questions, evaluated_records, evaluated_questions, rejected_records: one row."""
    asked = requests.agg(F.count("*").alias("requested_records"), F.coalesce(F.sum(F.size("questions")), F.lit(0)).alias("requested_questions"))
    got = rows.agg(F.count_distinct("id").alias("evaluated_records"), F.count("*").alias("evaluated_questions"))
    return asked.crossJoin(got).crossJoin(rejected.agg(F.count("*").alias("rejected_records")))  # one row each


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    from gaugeworks.sources.scored import ScoredLines

    spark.dataSource.register(ScoredLines)
    return spark.read.format("scored_lines").load(folder)
