"""Queries of trial ledgers, gates, reports, permutations, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import reports
from gaugeworks.plans.queries_metrics import WITH, both, rounded, scored
from gaugeworks.plans.registry import query
from gaugeworks.sources.fixtures import prediction_rows


def option_names():
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: k.cast("string"))


@query("a23_release_candidates", "WITH t AS (SELECT o_custkey AS recipe, o_orderkey % 4 AS seed, o_totalprice > 20000 AS g1, o_orderstatus <> 'P' AS g2 FROM orders) SELECT recipe, count(DISTINCT seed) AS seeds, bool_and(g1 AND g2) AND count(DISTINCT seed) >= 2 AS candidate FROM t GROUP BY recipe")
def release_candidates(spark, sf):
    """Over every order. A recipe is a customer: with 200 recipes, each has so many orders that one fails a gate in all of them."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = o.select(F.col("o_custkey").alias("recipe"), (F.col("o_orderkey") % 4).alias("seed"), (F.col("o_totalprice") > 20000).alias("g1"), (F.col("o_orderstatus") != "P").alias("g2"))
    return reports.release_candidates(t, ["g1", "g2"])


@query("a24_against_baseline", "SELECT o_orderkey, round(o_totalprice - first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS gain FROM orders")
def against_baseline(spark, sf):
    return reports.against_baseline(spark.read.parquet(f"{sf}/orders.parquet"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_orderkey", F.round("gain", 2).alias("gain"))


@query("a25_gate", f"{WITH} SELECT bool_and(acc - acc_b >= -0.05) AS passed, round(min(acc - acc_b), 6) AS worst FROM (SELECT task, avg(CAST(ok AS INT)) AS acc, avg(CAST(ok_b AS INT)) AS acc_b FROM preds GROUP BY task)")
def gate(spark, sf):
    b = both(spark, sf)
    acc = lambda c: b.groupBy("task").agg(F.avg(F.col(c).cast("int")).alias("acc"))
    return rounded(reports.gate(acc("ok"), acc("ok_b")))


@query("a31_rates_by_kind", "WITH x AS (SELECT o_orderstatus AS kind, o_orderpriority AS type, o_totalprice > 100000 AS big, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 2 = 0 END AS even FROM orders) SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' ELSE 'type' END AS by, CASE WHEN grouping(kind) = 0 THEN kind ELSE type END AS name, count(*) AS n, round(avg(CAST(big AS INT)), 6) AS big, round(avg(CAST(even AS INT)), 6) AS even FROM x GROUP BY GROUPING SETS ((kind), (type))")
def rates_by_kind(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumnsRenamed({"o_orderstatus": "kind", "o_orderpriority": "type"})
    return rounded(reports.rates(o, ["kind", "type"], {"big": F.col("o_totalprice") > 100000, "even": F.when(F.col("kind") != "P", F.col("o_custkey") % 2 == 0)}))


@query("a41_permutation_spread", f"{WITH} SELECT id, round(list_max(list_transform(list_zip(p, p_b), lambda x: abs(x[1] - x[2]))), 6) AS spread, pred <> pred_b AS flips FROM preds")
def permutation_spread(spark, sf):
    r = prediction_rows(spark, sf)
    return rounded(reports.permutation_spread(r.select("id", "p").union(r.select("id", F.col("p_b"))), ["id"]))


@query("o15_matched_controls", f"{WITH}, c AS (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY vec_id) AS k FROM preds WHERE conf >= 0.5 AND NOT ok), d AS (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY vec_id) AS k FROM preds WHERE conf >= 0.5 AND ok) SELECT c.task, c.id AS case_id, d.id AS control_id FROM c JOIN d USING (task, k)")
def matched_controls(spark, sf):
    sure = F.col("conf") >= 0.5
    return reports.matched_controls(scored(spark, sf), ["task"], sure & ~F.col("ok"), sure & F.col("ok"), F.col("vec_id"))


TAUS = [k / 10 for k in range(2, 10)]
SPLITS = f"""n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS slot, count(*) OVER (PARTITION BY source) // 2 AS half, length % 100 + 1 AS cost FROM preds),
k AS (SELECT *, row_number() OVER (PARTITION BY source, seed ORDER BY ((seed * 1000003 + slot * 7919 + 17) * 48271) % 2147483647 * 16807 % 2147483647) <= half AS dev FROM n, (SELECT unnest(generate_series(0, 199)) AS seed)),
t AS (SELECT seed, dev, tau, avg(CASE WHEN conf < tau THEN 0 ELSE CAST(ok AS INT) - CAST(ok_b AS INT) END) AS gain, 1 - sum(CASE WHEN conf < tau THEN cost ELSE 0 END) / sum(cost) AS saving FROM k, (SELECT unnest({TAUS}::DOUBLE[]) AS tau) GROUP BY ALL),
c AS (SELECT seed, arg_max(tau, struct_pack(s := saving, t := -tau)) AS tau FROM t WHERE dev AND gain >= -0.05 GROUP BY seed),
s AS (SELECT seed, tau, 0.0::DOUBLE - gain AS loss, saving FROM c JOIN t USING (seed, tau) WHERE NOT dev)"""


def splits_of(spark, sf):
    rows = both(spark, sf).select("id", "source", "conf", "ok", F.col("ok_b").alias("slow_ok"), (F.col("length") % 100 + 1).alias("slow_cost"))
    return reports.repeated_splits(rows, 200, TAUS, 0.05)


@query("a27_repeated_splits", f"{WITH}, {SPLITS} SELECT CAST(seed AS INTEGER) AS seed, tau, round(loss, 6) AS loss, round(saving, 6) AS saving FROM s")
def repeated_splits(spark, sf):
    return rounded(splits_of(spark, sf))


@query("a27_split_summary", f"{WITH}, {SPLITS} SELECT count(*) AS splits, round(avg(loss), 6) AS mean_loss, round(list_sort(list(loss))[1 + least(CAST(floor(0.9 * count(*)) AS BIGINT), count(*) - 1)], 6) AS p90_loss, round(avg(saving), 6) AS mean_saving, round(avg(CAST(loss <= 0.1 AND saving >= 0.2 AS INT)), 6) AS meeting FROM s")
def split_summary(spark, sf):
    return rounded(reports.split_summary(splits_of(spark, sf), 0.1, 0.2))


@query("a46_cost_bound", "SELECT o_orderkey AS job, round(CASE o_orderkey % 5 WHEN 0 THEN 3.95 WHEN 1 THEN 4.54 WHEN 2 THEN 6.25 WHEN 3 THEN 0.59 END * (o_custkey * 10) / 3600 * 3 * (1 + o_orderkey % 2), 6) AS usd FROM orders")
def cost_bound(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    gpu = F.get(F.array(*map(F.lit, ("H100", "H200", "B200", "T4", "other"))), (F.col("o_orderkey") % 5).cast("int"))
    jobs = o.select(F.col("o_orderkey").alias("job"), gpu.alias("gpu"), (F.col("o_custkey") * 10).alias("seconds"), F.lit(3).alias("trials"), (F.col("o_orderkey") % 2).alias("retries"))
    return rounded(reports.cost_bound(jobs).select("job", "usd"))


@query("l36_parsed_jobs", "SELECT o_orderkey AS job, 'r@' || o_custkey AS run, 'suite' || (o_orderkey % 3) AS suite, o_orderstatus AS name, CASE WHEN o_orderkey % 2 = 0 THEN '--fast' END AS flags FROM orders")
def parsed_jobs(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.concat(F.lit("r@"), F.col("o_custkey").cast("string"), F.lit("@suite"), (F.col("o_orderkey") % 3).cast("string"), F.lit("@"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "@--fast").otherwise(""))
    return o.select(F.col("o_orderkey").alias("job"), reports.parsed_jobs(text).alias("j")).select("job", "j.*")


@query("g10_soft_targets", f"{WITH} SELECT id, round(0.7 * p[label + 1] + 0.3, 7) AS at_label, list_max(p) = p[pred + 1] AND pred <> label AND conf >= 0.4 AS ambiguous FROM preds")
def soft_targets(spark, sf):
    rows = scored(spark, sf)
    t = reports.soft_targets(F.col("p"), F.col("label"), 0.7)
    return rows.select("id", F.round(F.get(t, F.col("label")), 7).alias("at_label"), ((F.col("pred") != F.col("label")) & (F.col("conf") >= 0.4)).alias("ambiguous"))


@query("u02_rotation_average", f"{WITH}, z AS (SELECT id, list_transform(list_zip(p, p_b), lambda x: (ln(greatest(x[1], 1e-12)) + ln(greatest(x[2], 1e-12))) / 2) AS z FROM preds), e AS (SELECT id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z) SELECT id, round(list_max(e) / list_sum(e), 6) AS conf, CAST(list_position(e, list_max(e)) - 1 AS VARCHAR) AS said FROM e")
def rotation_average(spark, sf):
    """Two turns of each question, the second answered with its options rotated by one."""
    r = prediction_rows(spark, sf).withColumn("keys", option_names())
    one = r.select("id", "question", F.lit(0).alias("turn"), "keys", "p")
    turned = reports.rotations(r.select("id", "question", "keys", "label"), 2).where("turn = 1").join(r.select("id", "p_b"), "id")
    two = turned.select("id", "question", "turn", "keys", F.transform("keys", lambda k: F.get("p_b", k.cast("int"))).alias("p"))
    got = reports.rotation_average(one.union(two))
    return got.select("id", F.round(F.array_max("p"), 6).alias("conf"), F.get("keys", (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("said"))


@query("d07_disjoint_sets", "SELECT (SELECT count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)) AS shared, (SELECT count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT text FROM documents WHERE doc_id % 2 = 1)) AS own, (SELECT count(*) FROM documents WHERE text LIKE '%license%' OR text LIKE '%License%') AS banned")
def disjoint_sets(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = d.where("doc_id % 2 = 0").select("text"), d.where("doc_id % 2 = 1").select("text")
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(a.intersect(b), "shared").crossJoin(count(a.subtract(b), "own")).crossJoin(count(d.where("text like '%license%' or text like '%License%'"), "banned"))


@query("j14_strict_compare", f"{WITH} SELECT count(*) AS n, count(*) FILTER (pred = pred_b) AS same, round(max(abs(conf - conf_b)), 6) AS worst, round(avg(abs(conf - conf_b)), 6) AS mean FROM preds")
def strict_compare(spark, sf):
    d = F.abs(F.col("conf") - F.col("conf_b"))
    return rounded(both(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("pred_b")).alias("same"), F.max(d).alias("worst"), F.avg(d).alias("mean")))


@query("a34_conditional_rates", f"{WITH} SELECT source, count(*) FILTER (conf >= 0.5) AS n, round(avg(CASE WHEN conf >= 0.5 THEN CAST(ok AS INT) END), 6) AS rate FROM preds GROUP BY source")
def conditional_rates(spark, sf):
    sure = F.col("conf") >= 0.5
    return rounded(scored(spark, sf).groupBy("source").agg(F.count_if(sure).alias("n"), F.avg(F.when(sure, F.col("ok").cast("int"))).alias("rate")))


@query("p15_training_rows", "SELECT source, count(*) AS n FROM (SELECT source, unnest(generate_series(1, CASE WHEN source IN ('src0', 'src1') THEN 3 ELSE 1 END)) FROM documents WHERE n_chars <= 8000) GROUP BY source")
def training_rows(spark, sf):
    """Admission by length; rows of synthetic sources three times."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars <= 8000")
    times = F.when(F.col("source").isin("src0", "src1"), 3).otherwise(1)
    return d.select("source", F.explode(F.array_repeat(F.lit(1), times))).groupBy("source").agg(F.count("*").alias("n"))
