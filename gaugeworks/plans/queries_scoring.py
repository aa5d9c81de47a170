"""Queries that score a suite made of documents: a predictor by arithmetic, some of whose answers are faulty; digests of states made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import scoring
from gaugeworks.plans.registry import query
from gaugeworks.sources.files import work_folder
from gaugeworks.sources.fixtures import LANGS, predict


def requests(spark, sf):
    """Every document as a request: its language (a choice), whether it is long (noul), its number of lines up to 4 (a score)."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("lang in ('de', 'en', 'es', 'fr')")
    text = F.coalesce("text", F.lit(""))
    q = lambda qid, kind, criteria, label: F.struct(F.lit(qid).alias("qid"), F.lit(kind).alias("type"), criteria.alias("criteria"), label.alias("label"), F.lit(f"task_{qid}").alias("src"))
    none = F.lit(None).cast("array<string>")
    lines = F.least(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(4))
    levels = F.array(*[F.lit(str(k)) for k in range(5)])
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("g"), F.floor(F.col("doc_id") / 4).cast("string")).alias("group_id"), "source", F.lit("clean").alias("variant"), F.to_json(F.struct("doc_id", text.alias("text"))).alias("state"),
        F.array(q("lang", "choice", F.array(*map(F.lit, LANGS)), F.col("lang")), q("long", "noul", none, F.when(F.length(text) > 500, "true").otherwise("false")), q("lines", "score", levels, lines.cast("string"))).alias("questions"),
    )


def scored(spark, sf):
    asked, folder = requests(spark, sf), work_folder(spark)
    scoring.evaluate(asked, predict, folder, waves=4)
    return asked, *scoring.evaluated(asked, folder)


#: The predictor and the checks in SQL: a row a question with its weights by the request's order of options.
SUITE = """d AS (SELECT doc_id AS n, source, lang, coalesce(text, '') AS t FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')),
e AS (SELECT *, CASE WHEN n % 31 = 0 THEN 'context overflow' WHEN n % 17 = 0 THEN 'answer ids differ from request ids' WHEN n % 19 = 0 THEN 'probability keys do not match requested options' WHEN n % 23 = 0 THEN 'invalid probability sum' WHEN n % 29 = 0 THEN 'non-finite or out-of-range probabilities' END AS error FROM d),
q AS (SELECT n, source, error, 'lang' AS question, list_transform([0, 1, 2, 3], lambda k: CAST((n * 7 + k * 3) % 11 + 1 AS DOUBLE)) AS w, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS label FROM e
 UNION ALL SELECT n, source, error, 'long', list_transform([1, 0], lambda k: CAST((n * 7 + k * 3 + 1) % 11 + 1 AS DOUBLE)), CAST(length(t) > 500 AS INT) FROM e
 UNION ALL SELECT n, source, error, 'lines', list_transform(range(5), lambda k: CAST((n * 7 + k * 3 + 2) % 11 + 1 AS DOUBLE)), least(4, length(t) - length(replace(t, chr(10), ''))) FROM e),
r AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS p FROM q WHERE error IS NULL)"""


@query("p04_prediction_rows", f"WITH {SUITE} SELECT CAST(n AS VARCHAR) AS id, question, CAST(label AS INTEGER) AS label, array_to_string(list_transform(p, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ' ') AS p FROM r")
def prediction_rows(spark, sf):
    """The rows of all documents whose answers pass the checks, as read back from what was committed."""
    _, rows, _, _ = scored(spark, sf)
    return rows.select("id", "question", "label", F.array_join(F.transform("p", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), " ").alias("p"))


@query("k08_rejected", f"WITH {SUITE} SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY error")
def rejected(spark, sf):
    _, _, gone, _ = scored(spark, sf)
    return gone.groupBy("error").agg(F.count("*").alias("n"))


@query("k04_report", f"WITH {SUITE}, s AS (SELECT *, list_max(p) AS conf, list_position(p, list_max(p)) - 1 = label AS ok FROM r) SELECT 'task_' || question AS task, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS acc, round(avg(conf), 6) AS mean_conf, round(avg(-ln(p[label + 1])), 6) AS nll, round(avg(list_sum(list_transform(p, lambda x, k: CASE WHEN k = label + 1 THEN (x - 1) * (x - 1) ELSE x * x END))), 6) AS brier FROM s GROUP BY question")
def report(spark, sf):
    """The report of the run: the block of every task."""
    _, _, _, block = scored(spark, sf)
    return block.select("task", "n", *[F.round(c, 6).alias(c) for c in ("acc", "mean_conf", "nll", "brier")])


@query("k04_coverage", f"WITH {SUITE} SELECT count(*) AS requested_records, 3 * count(*) AS requested_questions, count(*) FILTER (error IS NULL) AS evaluated_records, 3 * count(*) FILTER (error IS NULL) AS evaluated_questions, count(*) FILTER (error IS NOT NULL) AS rejected_records FROM e")
def coverage(spark, sf):
    asked, rows, gone, _ = scored(spark, sf)
    return scoring.coverage(asked, rows, gone)


_OLD = "'Order ' || o_orderkey, 'status ' || o_orderstatus, 'by ' || o_custkey"


@query("d03_semantic_hash", f"SELECT sha256('{{\"policy\":\"' || trim(o_orderpriority) || '\",\"sentences\":[\"' || array_to_string(list_sort([{_OLD}]), '\",\"') || '\"]}}') AS hash, count(*) AS n FROM orders GROUP BY ALL")
def semantic_hash(spark, sf):
    """Orders told as cases, with keys and sentences in an order that the order's number turns: told either way they count as one."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    parts = [F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("status "), "o_orderstatus"), F.concat(F.lit("by "), F.col("o_custkey").cast("string"))]
    told = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(". ", *parts)).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(". ", *parts[::-1])).otherwise(F.concat(F.concat_ws(". ", parts[1], parts[0], parts[2]), F.lit(".")))
    policy = F.trim("o_orderpriority")
    state = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(policy.alias("policy"), told.alias("case")))).otherwise(F.to_json(F.struct(told.alias("case"), policy.alias("policy"))))
    return o.select(scoring.semantic_hash(state).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))


@query("p07_training_problems", "SELECT CAST(doc_id AS VARCHAR) AS id, 'eval-only or undeclared training source: ' || source AS problem FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT CAST(doc_id AS VARCHAR), 'held-out compositional structure in training' FROM documents WHERE source = 'src3' AND (doc_id % 5 = 1 OR doc_id % 7 = 0)")
def training_problems(spark, sf):
    """Two sources are not for training; a third stands for compositional records, some of a family or structure held out."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    own = F.when(F.col("source") == "src3", "compositional").otherwise(F.col("source"))
    family = F.when(F.col("doc_id") % 5 == 1, "held").when(F.col("doc_id") % 5 == 2, "rand:3").otherwise("flat")
    records = d.select(F.col("doc_id").cast("string").alias("id"), own.alias("source"), family.alias("family"), F.when(F.col("doc_id") % 7 == 0, "k7").otherwise("k").alias("structure"))
    return scoring.training_problems(records, forbidden=("src1", "src2"), families=("flat",), held_structures=("k7",))
