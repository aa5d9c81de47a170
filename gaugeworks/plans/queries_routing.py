"""Queries over routing policies, drawn options, labels in free text, padded lengths and flips."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import routing as R
from gaugeworks.plans.registry import query
from gaugeworks.sources import fixtures

_BITS = "length(ltrim(bin(abs(n - 1)), '0'))"


@query("o13_padded_lengths", f"""WITH d AS (SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n FROM documents), e AS (SELECT *, CAST(1 AS BIGINT) << {_BITS} AS two FROM d),
s AS (SELECT *, greatest(16, two // 8) AS a, greatest(1, two // 4) AS b FROM e)
SELECT doc_id, two, CAST((n + a - 1) // a * a AS BIGINT) AS padded, CAST((n + b - 1) // b * b AS BIGINT) AS padded_count FROM s""")
def padded_lengths(spark, sf):
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", n.alias("n")).select("doc_id", R.power_of_two(F.col("n")).alias("two"), R.padded_length(F.col("n")).alias("padded"), R.padded_count(F.col("n")).alias("padded_count"))


TAUS = (0.3, 0.5, 0.7)
_UP = {"always_direct": "false", "always_thinking": "true", "oracle": "NOT ok AND ok_b"} | {f"tau_{t}": f"conf < {t}" for t in TAUS}


@query("u05_policies", f"WITH {fixtures.SQL}, r AS (SELECT *, length % 50 AS few, length % 900 AS many FROM preds), x AS (" + " UNION ALL ".join(f"SELECT '{name}' AS policy, ({up}) AS up, ok, ok_b, few, many FROM r" for name, up in _UP.items()) + """)
SELECT policy, count(*) AS n, avg(CASE WHEN CASE WHEN up THEN ok_b ELSE ok END THEN 1.0 ELSE 0.0 END) AS accuracy, CAST(sum(few + CASE WHEN up THEN many ELSE 0 END) AS DOUBLE) / count(*) AS mean_tokens, avg(CASE WHEN up THEN 1.0 ELSE 0.0 END) AS pct_escalated, CAST(sum(few + CASE WHEN up THEN many ELSE 0 END) AS BIGINT) AS total_tokens FROM x GROUP BY policy""")
def routing_policies(spark, sf):
    t = fixtures.prediction_rows(spark, sf)
    top = lambda p: F.array_position(p, F.array_max(p)) - 1
    return R.policies(t.select((top("p") == F.col("label")).alias("direct_correct"), (top("p_b") == F.col("label")).alias("thinking_correct"), F.array_max("p").alias("confidence"), (F.col("length") % 50).alias("direct_tokens"), (F.col("length") % 900).alias("thinking_tokens")), TAUS)


@query("o11_drawn_options", """WITH m AS (SELECT o_custkey AS grp, CAST(o_orderkey AS VARCHAR) AS key, (o_orderkey * 7919 % 100) / 100.0::DOUBLE AS value FROM orders),
t AS (SELECT *, max(value) OVER (PARTITION BY grp) AS top, first_value(key) OVER (PARTITION BY grp ORDER BY value DESC, key) AS best FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY key <> best, sha256('5|pick|' || key), key) AS spot FROM t WHERE key = best OR value <= top - 0.01::DOUBLE)
SELECT grp, best, string_agg(key, '|' ORDER BY sha256('5|order|' || key), key) AS options FROM k WHERE spot <= 10 GROUP BY grp, best HAVING count(*) > 1""")
def options_drawn(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").cast("string").alias("key"), (F.col("o_orderkey") * 7919 % 100 / F.lit(100.0)).alias("value"))
    return R.drawn_options(o, "5").withColumn("options", F.array_join("options", "|"))


LABELS, SYNONYMS = ("data_set", "the", "query_plan", "de"), {"query_plan": ("plan",)}


@query("l17_extracted_labels", """WITH f AS (SELECT doc_id, lower(text) AS t FROM documents), m AS (SELECT doc_id, list_filter([CASE WHEN contains(t, 'data_set') OR contains(t, 'data set') OR contains(t, 'data-set') THEN 'data_set' END, CASE WHEN contains(t, 'the') THEN 'the' END,
CASE WHEN contains(t, 'query_plan') OR contains(t, 'query plan') OR contains(t, 'query-plan') OR contains(t, 'plan') THEN 'query_plan' END, CASE WHEN contains(t, 'de') THEN 'de' END], lambda x: x IS NOT NULL) AS found FROM f)
SELECT doc_id, CASE WHEN len(found) = 1 THEN found[1] END AS label FROM m""")
def labels_extracted(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", R.extracted_label(F.col("text"), LABELS, SYNONYMS).alias("label"))


@query("a43_flip_rates", f"""WITH {fixtures.SQL}, r AS (SELECT task AS addition, CAST(pred AS DOUBLE) AS clean, CAST(pred_b AS DOUBLE) + (vec_id % 4) * 0.25::DOUBLE AS argmax, CAST(label AS DOUBLE) AS gold FROM preds),
w AS (SELECT *, round_even(argmax, 0) <> round_even(clean, 0) AS flip, round_even(argmax, 0) <> round_even(gold, 0) AS wrong FROM r)
SELECT addition, count(*) AS n, avg(flip::INT) AS flip, avg(wrong::INT) AS wrong, count(*) FILTER (flip AND wrong) AS flip_to_wrong, count(*) FILTER (flip AND NOT wrong) AS flip_to_right, avg((clean <> gold)::INT) AS clean_wrong FROM w GROUP BY addition""")
def flip_rates(spark, sf):
    top = lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("double")
    t = fixtures.prediction_rows(spark, sf).select(F.col("task").alias("addition"), top("p").alias("clean"), (top("p_b") + F.col("vec_id") % 4 * 0.25).alias("argmax"), F.col("label").cast("double").alias("gold"))
    return R.flips(t, "addition")


@query("d17_leaked_ids", "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) OR o_custkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def leaked_ids(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("item_ref"))
    return R.leaked(rows, spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 49").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("item_ref")))
