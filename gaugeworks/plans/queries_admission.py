"""Queries over admission to a suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import admission as A
from gaugeworks.plans.registry import query
from gaugeworks.sources import fixtures

NAMES, BUCKETS = {"en": "english", "de": "german", "fr": "french"}, (("short", 200, 1200), ("medium", 1200, 4000), ("long", 4000, 28000))


@query("p10_prepared", r"""WITH t AS (SELECT doc_id, trim(text, E' \t\n\r\x0b\x0c') AS t, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' END AS key FROM documents)
SELECT doc_id, key, length(t) AS n, CASE WHEN length(t) >= 200 AND length(t) < 1200 THEN 'short' WHEN length(t) >= 1200 AND length(t) < 4000 THEN 'medium' WHEN length(t) >= 4000 AND length(t) < 28000 THEN 'long' END AS bucket FROM t WHERE t <> '' AND key IS NOT NULL""")
def prepared_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("lang").alias("name"))
    return A.prepared(rows, NAMES, BUCKETS).select("doc_id", "key", F.char_length("text").alias("n"), "bucket")


@query("d16_spot_sample", "SELECT o_orderkey AS id, o_orderstatus AS question, o_custkey AS label FROM orders ORDER BY sha256('spot|' || o_orderkey || '|' || o_orderstatus), 1, 2 LIMIT 50")
def spot_sample(spark, sf):
    return A.spot_sample(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("question"), F.col("o_custkey").alias("label")), "spot")


@query("j15_softened_targets", f"WITH {fixtures.SQL} SELECT e.vec_id AS id, round(0.5 * p[1] + CASE WHEN p.label = 0 THEN 0.5 ELSE 0 END, 9) AS first, round(list_sum(list_transform(p.p, lambda x, i: i * (0.5 * x + CASE WHEN i = p.label + 1 THEN 0.5 ELSE 0 END))), 9) AS level FROM embeddings e JOIN preds p ON p.vec_id = e.vec_id WHERE pred <> p.label AND conf >= 0.6".replace("0.5 * p[1]", "0.5 * p.p[1]"))
def softened_targets(spark, sf):
    teacher = fixtures.prediction_rows(spark, sf)
    records = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.lit("q").alias("question"), F.col("vec_id"))
    level = F.aggregate(F.transform("target", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return A.softened(records, teacher).select(F.col("vec_id").alias("id"), F.round(F.get("target", F.lit(0)), 9).alias("first"), F.round(level, 9).alias("level"))


@query("a42_odds_shift", f"""WITH {fixtures.SQL}, o AS (SELECT p, p_b, list_sort(list_transform(p, lambda x, i: {{'x': -x, 'i': i}})) AS o FROM preds),
s AS (SELECT ln(greatest(p_b[o[1].i], 1e-6) / greatest(p_b[o[2].i], 1e-6)) - ln(greatest(p[o[1].i], 1e-6) / greatest(p[o[2].i], 1e-6)) AS s FROM o)
SELECT count(*) AS n, avg(abs(s)) AS mean_abs_shift, avg(s) AS mean_shift, quantile_cont(abs(s), 0.9) AS p90_abs_shift FROM s""")
def odds_shift(spark, sf):
    return A.odds_shift(fixtures.prediction_rows(spark, sf).select("p", F.col("p_b").alias("p_more")))
