"""Queries over typed questions and answers, made from orders: one question an order, a record a customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import probability as P
from gaugeworks.functions import text as T
from gaugeworks.operators import answers as A
from gaugeworks.operators import reports
from gaugeworks.plans.registry import query


def questions(spark, sf, turn: int = 31):
    """id, record, type, k, criteria, keys, p, label (as text) of every order."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("record"))
    type_ = F.get(F.array(*map(F.lit, ("choice", "noul", "score"))), (F.col("id") % 3).cast("int"))
    k = F.when(F.col("type") == "choice", 2 + F.col("record") % 5).when(F.col("type") == "noul", 2).otherwise(3 + F.col("record") % 4).cast("int")
    o = o.withColumn("type", type_).withColumn("k", k).withColumn("criteria", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("k"), i.cast("string"))))
    weights = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: ((F.col("id") * turn + i * 17 + F.col("record") * (1 + i)) % 97 + 1).cast("double"))
    p = P.let(weights, lambda w: P.let(P.total(w), lambda s: F.transform(w, lambda x: x / s)))
    o = o.withColumn("keys", A.question_keys(F.col("type"), F.col("criteria"))).withColumn("p", p)
    return o.withColumn("label", F.get("keys", (F.col("record") % F.col("k")).cast("int")))


def sql(turn: int = 31, name: str = "q") -> str:
    return f"""{name}k AS (SELECT o_orderkey AS id, o_custkey AS record, ['choice', 'noul', 'score'][1 + o_orderkey % 3] AS type, CASE o_orderkey % 3 WHEN 0 THEN 2 + o_custkey % 5 WHEN 1 THEN 2 ELSE 3 + o_custkey % 4 END AS k FROM orders),
{name}w AS (SELECT *, list_transform(range(k), lambda i: CAST((id * {turn} + i * 17 + record * (1 + i)) % 97 + 1 AS DOUBLE)) AS w, list_transform(range(k), lambda i: CASE type WHEN 'choice' THEN 'k' || i WHEN 'noul' THEN ['false', 'true'][i + 1] ELSE CAST(i AS VARCHAR) END) AS keys FROM {name}k),
{name} AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS p, record % k AS spot, keys[1 + record % k] AS label, list_position(w, list_max(w)) - 1 AS pred FROM {name}w)"""


@query("p02_keys_and_labels", f"WITH {sql()} SELECT id, array_to_string(keys, '|') AS keys, CAST(spot AS INTEGER) AS label FROM q")
def keys_and_labels(spark, sf):
    return questions(spark, sf).select("id", F.array_join("keys", "|").alias("keys"), A.label_index(F.col("keys"), F.col("label")).alias("label"))


SERVED = f"""{sql()}, s AS (SELECT *, list_sum(list_transform(p, lambda x, i: x * (i - 1))) AS level, (list_max(p) / list_sum(p) - 1.0 / k) / (1 - 1.0 / k) AS cc,
greatest(0, 1 - list_sum(list_transform(p, lambda x, i: x / list_sum(p) * abs(i - 1 - pred))) / list_avg(list_transform(range(k), lambda i: abs(i - (k - 1) / 2.0)))) AS sc FROM q),
a AS (SELECT id, record, type, k, keys, label, spot, p, CASE type WHEN 'choice' THEN keys[1 + pred] END AS choice, CASE type WHEN 'noul' THEN CAST(printf('%.4f', p[2]) AS DOUBLE) END AS noul, CASE type WHEN 'score' THEN CAST(printf('%.4f', level) AS DOUBLE) END AS score, CASE type WHEN 'choice' THEN CAST(printf('%.4f', cc) AS DOUBLE) WHEN 'score' THEN CAST(printf('%.4f', sc) AS DOUBLE) END AS confidence FROM s)"""


@query("l06_served_answers", f"WITH {SERVED} SELECT id, type, choice, noul, score, confidence, CASE WHEN type <> 'noul' THEN round(list_sum(list_transform(p, lambda x: CAST(printf('%.4f', x) AS DOUBLE))), 4) END AS mass FROM a")
def served_answers(spark, sf):
    return A.answered(questions(spark, sf)).select("id", "type", "choice", "noul", "score", "confidence", F.round(P.total(F.col("probabilities")), 4).alias("mass"))


@query("p13_probabilities_by_key", f"WITH {SERVED}, e AS (SELECT id, unnest(keys) AS key, unnest(CASE type WHEN 'noul' THEN [1 - noul, noul] ELSE list_transform(p, lambda x: CAST(printf('%.4f', x) AS DOUBLE)) END) AS p FROM a) SELECT id, key, round(p, 4) AS p FROM e")
def probabilities_by_key(spark, sf):
    got = A.to_probs(A.answered(questions(spark, sf)).drop("p"))
    return got.select("id", F.explode(F.arrays_zip("keys", "p")).alias("x")).select("id", F.col("x.keys").alias("key"), F.round("x.p", 4).alias("p"))


@query("l32_typed_correctness", f"WITH {SERVED} SELECT id, CASE type WHEN 'choice' THEN choice = label WHEN 'noul' THEN (noul >= 0.5) = (spot = 1) ELSE round_even(score, 0) = spot END AS ok FROM a")
def typed_correctness(spark, sf):
    return A.answered(questions(spark, sf)).select("id", A.correct(F.col("label")).alias("ok"))


@query("a38_chance", f"WITH {sql()} SELECT record, count(*) AS n, round(avg(1.0::DOUBLE / k), 6) AS accuracy, round(ln(product(1.0::DOUBLE / k)), 4) AS log_case_exact FROM q GROUP BY record")
def chance(spark, sf):
    return A.chance(questions(spark, sf), "record").select("record", "n", F.round("accuracy", 6).alias("accuracy"), F.round(F.ln("case_exact"), 4).alias("log_case_exact"))


@query("j13_parity", f"WITH {sql()}, {sql(32, 'r')}, d AS (SELECT 'k' || q.k AS bucket, q.type AS part, list_max(list_transform(list_zip(q.p, r.p), lambda x: abs(x[1] - x[2]))) AS dp, CAST(q.pred <> r.pred AS INT) AS flip, r.id % 4 = 0 AS eff FROM q JOIN r ON q.id = r.id), e AS (SELECT bucket AS key, * FROM d UNION ALL SELECT bucket || '/' || part, * FROM d) SELECT key, count(*) AS questions, round(max(dp), 4) AS max_dp, round(avg(dp), 5) AS mean_dp, CAST(sum(flip) AS BIGINT) AS argmax_flips, count(*) FILTER (eff) AS efficient_rows FROM e GROUP BY key")
def parity(spark, sf):
    old, new = (questions(spark, sf, turn).withColumn("question", F.lit("q")) for turn in (31, 32))
    return A.parity(old, new.withColumn("bucket", F.concat(F.lit("k"), F.col("k").cast("string"))).withColumn("part", F.col("type")).withColumn("efficient", F.col("id") % 4 == 0))


@query("a40_by_source", "WITH t AS (SELECT d.doc_id, coalesce(source, 'unknown') AS source, n_chars, CASE WHEN d.doc_id % 3 <> 0 THEN quality END AS ok, d.doc_id % 6 = 0 AS un, coalesce(n, 0) AS n FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) ON conv_id = d.doc_id) SELECT source, count(*) AS n, round(avg(ok), 6) AS correct_rate, round(avg(coalesce(n_chars, 0)), 4) AS mean_thinking_tokens, round(avg(CAST(n > 0 AS INT)), 6) AS coverage, round(avg(n), 6) AS points_per_trace, count(*) FILTER (un) AS n_unparsed, count(ok) + count(*) FILTER (un) AS n_graded FROM t GROUP BY source")
def by_source(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    traces = d.select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("n_thinking_tokens"), F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 1).alias("correct"), (F.col("doc_id") % 6 == 0).alias("unparsed"))
    got = A.by_source(traces, spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("id")))
    return got.withColumns({c: F.round(c, 6) for c in ("correct_rate", "coverage", "points_per_trace")} | {"mean_thinking_tokens": F.round("mean_thinking_tokens", 4)})


@query("p09_line_safe", "SELECT doc_id, NOT regexp_matches(t, '[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS safe FROM (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN chr(8232) WHEN 1 THEN chr(133) WHEN 2 THEN chr(11) WHEN 3 THEN chr(10) ELSE '' END AS t FROM documents)")
def line_safe(spark, sf):
    end = F.get(F.array(*map(F.lit, (" ", "\x85", "\x0b", "\n", "", "", ""))), (F.col("doc_id") % 7).cast("int"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.line_safe(F.concat("text", end)).alias("safe"))


@query("l08_date_facts", "SELECT l_orderkey, l_linenumber, CASE WHEN a <> b THEN a || ' to ' || b || ': ' || abs(date_diff('day', a, b)) || ' days' ELSE '' END AS facts FROM (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def date_facts(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    told = F.concat(F.lit("Ordered on "), F.col("o_orderdate").cast("date").cast("string"), F.lit(", sent on "), F.col("l_shipdate").cast("date").cast("string"), F.lit(" (2020-13-45)."))
    return l.select("l_orderkey", "l_linenumber", T.date_facts(told).alias("facts"))


@query("l37_checked_claims", "WITH f AS (SELECT 'order/' || o_orderkey AS path, o_totalprice AS value FROM orders UNION ALL SELECT 'order/' || o_orderkey, 0 FROM orders WHERE o_orderkey % 11 = 0), one AS (SELECT path, count(*) AS n, max(value) AS value FROM f GROUP BY path) SELECT o_orderkey AS claim, coalesce(n = 1 AND abs(value - CAST(printed AS DOUBLE)) <= 0.5 * pow(10.0, -1) + 1e-12, false) AS ok FROM (SELECT o_orderkey, 'order/' || CASE WHEN o_orderkey % 13 = 0 THEN 'none' ELSE CAST(o_orderkey AS VARCHAR) END AS path, CAST(floor(o_totalprice) AS BIGINT) || '.' || o_custkey % 10 AS printed FROM orders) LEFT JOIN one USING (path)")
def checked_claims(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    facts = o.select(F.concat(F.lit("order/"), key).alias("path"), F.col("o_totalprice").alias("value")).union(o.where("o_orderkey % 11 = 0").select(F.concat(F.lit("order/"), key), F.lit(0.0)))
    claims = o.select(F.col("o_orderkey").alias("claim"), F.concat(F.lit("order/"), F.when(F.col("o_orderkey") % 13 == 0, "none").otherwise(key)).alias("path"), F.concat_ws(".", F.floor("o_totalprice").cast("string"), (F.col("o_custkey") % 10).cast("string")).alias("printed"))
    return reports.checked_claims(claims, facts)
