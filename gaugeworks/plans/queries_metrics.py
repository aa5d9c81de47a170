"""Queries over prediction rows: metrics, calibration, paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.functions import probability as P
from gaugeworks.operators import calibrate, metrics, paired
from gaugeworks.plans.registry import query
from gaugeworks.sources.fixtures import SQL as PREDS
from gaugeworks.sources.fixtures import prediction_rows


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.scored(metrics.knowable(prediction_rows(spark, sf)))


def both(spark: SparkSession, sf: str) -> DataFrame:
    """System A beside system B, by a strict join on (id, question)."""
    a = scored(spark, sf)
    b = metrics.scored(prediction_rows(spark, sf).withColumn("p", F.col("p_b"))).select("id", "question", F.col("conf").alias("conf_b"), F.col("pred").alias("pred_b"), F.col("ok").alias("ok_b"), F.col("nll").alias("nll_b"))
    return a.join(b, ["id", "question"])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def ece_sql(keys: str = "", source: str = "preds") -> str:
    k = f"{keys}, " if keys else ""
    return f"(SELECT {k}sum(c * gap) / sum(c) AS ece FROM (SELECT {k}bin, count(*) AS c, abs(avg(CAST(ok AS INT)) - avg(conf)) AS gap FROM (SELECT *, CASE WHEN conf >= 0.9 THEN 9 WHEN conf >= 0.8 THEN 8 WHEN conf >= 0.7000000000000001 THEN 7 WHEN conf >= 0.6000000000000001 THEN 6 WHEN conf >= 0.5 THEN 5 WHEN conf >= 0.4 THEN 4 WHEN conf >= 0.30000000000000004 THEN 3 WHEN conf >= 0.2 THEN 2 WHEN conf >= 0.1 THEN 1 ELSE 0 END AS bin FROM {source}) GROUP BY {k}bin){f' GROUP BY {keys}' if keys else ''})"


CURVE = "curve AS (SELECT task, conf AS threshold, sum(c) OVER w AS accepted, sum(e) OVER w AS errors, sum(c) OVER (PARTITION BY task) AS n FROM (SELECT task, conf, count(*) AS c, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS e FROM preds GROUP BY task, conf) WINDOW w AS (PARTITION BY task ORDER BY conf DESC ROWS UNBOUNDED PRECEDING))"
WITH = f"WITH {PREDS}"
BLOCK = """count(*) AS n, round(avg(nll), 6) AS nll, round(avg(CAST(ok AS INT)), 6) AS acc, round(avg(brier), 6) AS brier, round(avg(conf), 6) AS mean_conf, round(avg(CASE WHEN conf >= 0.9 AND NOT ok THEN 1.0 ELSE 0 END), 6) AS confident_error_rate,
 round(avg(CASE WHEN conf >= 0.9 THEN 1.0 ELSE 0 END), 6) AS coverage_at_0_9, round(avg(CASE WHEN conf >= 0.9 THEN CAST(ok AS INT) END), 6) AS accuracy_at_0_9, round(avg(CASE WHEN conf >= 0.9 THEN 1 - CAST(ok AS INT) END), 6) AS error_rate_at_0_9, round(avg(conf) - avg(CAST(ok AS INT)), 6) AS confidence_bias"""
RISKS = "cov AS (SELECT task, round(coalesce(max(CASE WHEN errors <= 0.05 * accepted THEN accepted END), 0) / max(n), 6) AS coverage_at_5, round(coalesce(max(CASE WHEN errors <= 0.01 * accepted THEN accepted END), 0) / max(n), 6) AS coverage_at_1 FROM curve GROUP BY task), aurc AS (SELECT task, round(sum((accepted - before) * errors / accepted) / max(n), 6) AS aurc FROM (SELECT *, lag(accepted, 1, 0) OVER (PARTITION BY task ORDER BY threshold DESC) AS before FROM curve) GROUP BY task)"


@query("a05_metrics_by_task", f"{WITH}, {CURVE}, {RISKS}, m AS (SELECT task, {BLOCK} FROM preds GROUP BY task) SELECT m.*, round(e.ece, 6) AS ece, coverage_at_5, coverage_at_1, aurc FROM m JOIN {ece_sql('task')} e USING (task) JOIN cov USING (task) JOIN aurc USING (task)")
def metrics_by_task(spark, sf):
    return rounded(metrics.metric_block(scored(spark, sf), ["task"]))


@query("a01_metrics", f"{WITH.replace('task, variant', 'task, variant')}, {CURVE.replace('SELECT task, conf, count', 'SELECT 1 AS task, conf, count').replace('GROUP BY task, conf', 'GROUP BY conf')}, {RISKS} SELECT {BLOCK}, any_value(round((SELECT ece FROM {ece_sql()}), 6)) AS ece, any_value(coverage_at_5) AS coverage_at_5, any_value(coverage_at_1) AS coverage_at_1, any_value(aurc) AS aurc FROM preds, cov, aurc")
def metrics_overall(spark, sf):
    return rounded(metrics.metric_block(scored(spark, sf)))


@query("a02_ece_by_source", f"{WITH} SELECT source, round(ece, 6) AS ece FROM {ece_sql('source')}")
def ece_by_source(spark, sf):
    return rounded(metrics.expected_calibration_error(scored(spark, sf), ["source"]))


@query("w1_risk_curve", f"{WITH}, {CURVE} SELECT task, round(threshold, 6) AS threshold, CAST(accepted AS BIGINT) AS accepted, CAST(errors AS BIGINT) AS errors, CAST(n AS BIGINT) AS n, round(accepted / n, 6) AS coverage, round(errors / accepted, 6) AS risk FROM curve")
def risk_curve(spark, sf):
    return rounded(metrics.risk_curve(scored(spark, sf), ["task"]))


@query("a06_coverage_at_error", f"{WITH}, {CURVE} SELECT task, round(coalesce(max(CASE WHEN errors <= 0.3 * accepted THEN accepted END), 0) / max(n), 6) AS coverage_at_30, round(coalesce(max(CASE WHEN errors <= 0.9 * accepted THEN accepted END), 0) / max(n), 6) AS coverage_at_90 FROM curve GROUP BY task")
def coverage_at_error(spark, sf):
    return rounded(metrics.coverage_at_error(scored(spark, sf), (0.3, 0.9), ["task"]))


@query("a07_area_under_risk", f"{WITH}, {CURVE}, {RISKS} SELECT task, aurc FROM aurc")
def area_under_risk(spark, sf):
    return rounded(metrics.area_under_risk(scored(spark, sf), ["task"]))


THRESHOLD = "t AS (SELECT task, min(CASE WHEN errors <= 0.9 * accepted AND accepted >= 5 THEN threshold END) AS threshold FROM curve GROUP BY task)"


@query("a08_select_threshold", f"{WITH}, {CURVE}, {THRESHOLD}, x AS (SELECT task, coalesce(conf >= threshold, false) AS yes, ok FROM preds JOIN t USING (task)) SELECT task, any_value(threshold) AS threshold, CAST(sum(CAST(yes AS INT)) AS BIGINT) AS accepted, CAST(sum(CASE WHEN yes AND NOT ok THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(avg(CAST(yes AS INT)), 6) AS coverage, round(CASE WHEN sum(CAST(yes AS INT)) > 0 THEN sum(CASE WHEN yes AND NOT ok THEN 1 ELSE 0 END) / sum(CAST(yes AS INT)) END, 6) AS risk FROM x JOIN t USING (task) GROUP BY task")
def select_threshold(spark, sf):
    rows = scored(spark, sf)
    chosen = metrics.select_threshold(rows, 0.9, 5, ["task"])
    return rounded(metrics.evaluate_threshold(rows.join(chosen, "task"), F.col("threshold"), ["task"]).join(chosen, "task"))


@query("a01_top_bins", f"{WITH} SELECT threshold, CAST(sum(CAST(conf >= threshold AS INT)) AS BIGINT) AS n, CAST(sum(CAST(conf >= threshold AND NOT ok AS INT)) AS BIGINT) AS errors FROM preds, (SELECT unnest([0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS threshold) GROUP BY threshold")
def top_bins(spark, sf):
    return metrics.top_bins(scored(spark, sf))


@query("w8_selective", f"{WITH}, {CURVE} SELECT task, CAST(n_50 AS BIGINT) AS n_50, round(acc_50, 6) AS acc_50, CAST(n_80 AS BIGINT) AS n_80, round(acc_80, 6) AS acc_80 FROM (SELECT task, min(CASE WHEN accepted >= ceil(n * 0.5) THEN accepted END) AS n_50, 1 - arg_min(CASE WHEN accepted >= ceil(n * 0.5) THEN errors / accepted END, CASE WHEN accepted >= ceil(n * 0.5) THEN accepted END) AS acc_50, min(CASE WHEN accepted >= ceil(n * 0.8) THEN accepted END) AS n_80, 1 - arg_min(CASE WHEN accepted >= ceil(n * 0.8) THEN errors / accepted END, CASE WHEN accepted >= ceil(n * 0.8) THEN accepted END) AS acc_80 FROM curve GROUP BY task)")
def selective(spark, sf):
    return rounded(metrics.selective(scored(spark, sf), keys=["task"]))


LENGTH_SQL = ", ".join(f"('{name}', {lo}, {'NULL' if hi is None else hi})" for name, lo, hi in metrics.length_buckets())


@query("a10_calibration_by_length", f"{WITH}, b(bucket, lo, hi) AS (VALUES {LENGTH_SQL}), x AS (SELECT * FROM b JOIN preds ON length >= lo AND (hi IS NULL OR length < hi)) SELECT b.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n, round(acc, 6) AS acc, round(mean_conf, 6) AS mean_conf, round(brier, 6) AS brier, round(wrong, 6) AS confident_error_rate, round(ece, 6) AS ece FROM b LEFT JOIN (SELECT bucket, count(*) AS n, avg(CAST(ok AS INT)) AS acc, avg(conf) AS mean_conf, avg(brier) AS brier, avg(CAST(conf >= 0.9 AND NOT ok AS INT)) AS wrong FROM x GROUP BY bucket) m USING (bucket) LEFT JOIN {ece_sql('bucket', 'x')} e USING (bucket)")
def calibration_by_length(spark, sf):
    return rounded(metrics.by_length(scored(spark, sf)))


def losses_sql(grid: list[float], keys: str) -> str:
    g = ", ".join(f"({k}, {t!r}::DOUBLE)" for k, t in enumerate(grid))
    return f"grid(i, temperature) AS (VALUES {g}), l AS (SELECT {keys}, i, temperature, ln(list_sum(list_transform(logits, lambda x: exp((x - m) / temperature)))) - (logits[label + 1] - m) / temperature AS loss FROM (SELECT *, list_max(logits) AS m FROM preds) q, grid)"


GRID = calibrate.grid(81)


@query("a11_fit_temperature", f"{WITH}, {losses_sql(GRID, 'task')}, x AS (SELECT i, temperature, round(avg(m), 10) AS nll FROM (SELECT task, i, temperature, sum(loss) / count(*) AS m FROM l GROUP BY ALL) GROUP BY ALL) SELECT round(temperature, 6) AS temperature, round(nll, 6) AS nll FROM x ORDER BY x.nll, i LIMIT 1")
def fit_temperature(spark, sf):
    return rounded(calibrate.fit_temperature(scored(spark, sf)))


FOLDS = "g AS (SELECT source, grp, row_number() OVER (PARTITION BY source ORDER BY grp) - 1 AS k FROM (SELECT DISTINCT source, grp FROM preds)), c AS (SELECT source, count(*) AS c FROM g GROUP BY source), st AS (SELECT source, coalesce(sum(c) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c), folds AS (SELECT source, grp, CAST((k + start) % 5 AS BIGINT) AS fold FROM g JOIN st USING (source))"


@query("a12_folds", f"{WITH}, {FOLDS} SELECT fold, source, count(*) AS n FROM preds JOIN folds USING (source, grp) GROUP BY fold, source")
def folds(spark, sf):
    return calibrate.grouped_folds(scored(spark, sf)).groupBy("fold", "source").agg(F.count("*").alias("n"))


@query("a13_out_of_fold_temperature", f"{WITH}, {FOLDS}, {losses_sql(GRID, 'source, grp')}, s AS (SELECT fold, i, temperature, sum(loss) AS s, count(*) AS c FROM l JOIN folds USING (source, grp) GROUP BY ALL), o AS (SELECT fold, i, temperature, round((sum(s) OVER w - s) / (sum(c) OVER w - c), 10) AS mean FROM s WINDOW w AS (PARTITION BY i)) SELECT fold, round(temperature, 6) AS temperature FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mean, i) AS k FROM o) WHERE k = 1")
def out_of_fold(spark, sf):
    return rounded(calibrate.out_of_fold_temperatures(scored(spark, sf)))


@query("l03_tempered", f"{WITH}, x AS (SELECT id, label, list_transform(logits, lambda x: exp((x - list_max(logits)) / 2.0)) AS e, ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / 2.0)))) - (logits[label + 1] - list_max(logits)) / 2.0 AS nll2 FROM preds) SELECT id, round(list_max(e) / list_sum(e), 6) AS conf2, round(e[label + 1] / list_sum(e), 6) AS p_label2, round(nll2, 6) AS nll2 FROM x")
def tempered(spark, sf):
    rows = prediction_rows(spark, sf).withColumn("nll2", P.nll_at(F.col("p"), F.col("label"), F.col("logits"), 2.0))
    return rounded(calibrate.served(rows, 2.0).select("id", F.array_max("p").alias("conf2"), F.get("p", F.col("label")).alias("p_label2"), "nll2"))


@query("l04_raw_of_served", f"{WITH} SELECT id, list_max(p) AS conf, 1.0::DOUBLE AS inference_temperature FROM preds")
def raw_of_served(spark, sf):
    """Raw of served is the row as it was: served at 2, restored, and held against the probabilities of the raw logits."""
    rows = calibrate.served(prediction_rows(spark, sf), 2.0)
    return calibrate.raw(rows).select("id", F.round(F.array_max("p"), 6).alias("conf"), "inference_temperature")


@query("a15_mcnemar", f"{WITH}, d AS (SELECT task, count(*) FILTER (ok AND NOT ok_b) AS b, count(*) FILTER (NOT ok AND ok_b) AS c FROM preds GROUP BY task) SELECT task, b, c, round(CASE WHEN b = c THEN 1.0 ELSE least(1, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END, 9) AS p FROM d")
def mcnemar(spark, sf):
    return rounded(paired.mcnemar(both(spark, sf), "ok", "ok_b", ["task"]), 9)


@query("a15_discordant", f"{WITH} SELECT task, count(*) FILTER (ok AND NOT ok_b) AS b, count(*) FILTER (NOT ok AND ok_b) AS c FROM preds GROUP BY task")
def discordant(spark, sf):
    return paired.mcnemar(both(spark, sf), "ok", "ok_b", ["task"]).select("task", "b", "c")


RANK = "r AS (SELECT source, ok, rank() OVER (PARTITION BY source ORDER BY conf) + (count(*) OVER (PARTITION BY source, conf) - 1) / 2.0 AS rank FROM preds)"


@query("a16_auroc", f"{WITH}, {RANK}, s AS (SELECT source, sum(CASE WHEN ok THEN rank ELSE 0 END) AS r, sum(CAST(ok AS INT)) AS p, count(*) AS n FROM r GROUP BY source) SELECT source, round(CASE WHEN p = 0 OR p = n THEN 0.5 ELSE (r - p * (p + 1) / 2.0) / (p * (n - p)) END, 6) AS auroc FROM s")
def auroc(spark, sf):
    return rounded(metrics.area_under_roc(scored(spark, sf), "conf", "ok", ["source"]))


@query("w2_average_ranks", f"{WITH} SELECT length % 40 AS score, count(*) AS n, round(avg(rank), 6) AS rank FROM (SELECT length, rank() OVER (ORDER BY length % 40) + (count(*) OVER (PARTITION BY length % 40) - 1) / 2.0 AS rank FROM preds) GROUP BY ALL")
def average_ranks(spark, sf):
    blocks = prediction_rows(spark, sf).groupBy((F.col("length") % 40).alias("score")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a score
    return rounded(blocks.withColumn("rank", before + (F.col("n") + 1) / 2.0))


@query("a21_nll_floors", f"{WITH} SELECT floor, round(avg(m), 6) AS nll FROM (SELECT floor, task, avg(-ln(greatest(p[label + 1], floor))) AS m FROM preds, (SELECT unnest([1e-3, 1e-6, 1e-9]) AS floor) GROUP BY floor, task) GROUP BY floor")
def nll_floors(spark, sf):
    each = scored(spark, sf).withColumn("floor", F.explode(F.array(*map(F.lit, (1e-3, 1e-6, 1e-9)))))
    return each.groupBy("floor", "task").agg(F.avg(-F.ln(F.greatest(F.get("p", F.col("label")), F.col("floor")))).alias("m")).groupBy("floor").agg(F.round(F.avg("m"), 6).alias("nll"))


@query("a22_describe", f"{WITH} SELECT task, count(*) AS n, max(ties) AS largest_tie, CAST(sum(list_count(list_filter(p, lambda x: x = 0))) AS BIGINT) AS zeros FROM (SELECT *, list_filter(p, lambda x: x = 0) AS z, count(*) OVER (PARTITION BY task, round(conf, 2)) AS ties FROM preds) GROUP BY task".replace("list_count(list_filter(p, lambda x: x = 0))", "len(z)"))
def describe(spark, sf):
    rows = scored(spark, sf)
    # the nearest hundredth of the double as it is: round("conf", 2) would go by its decimal text, in which 0.285 is a half
    ties = rows.groupBy("task", F.round(F.col("conf") * 100)).count().groupBy("task").agg(F.max("count").alias("largest_tie"))
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.sum(F.size(F.filter("p", lambda x: x == 0))).alias("zeros")).join(ties, "task")


@query("a26_escalation", f"{WITH} SELECT round(tau, 6) AS tau, round(avg(CAST(CASE WHEN conf < tau THEN ok_b ELSE ok END AS INT)), 6) AS accuracy, round(avg(1 + CASE WHEN conf < tau THEN length % 100 ELSE 0 END), 6) AS cost FROM preds, (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS tau) GROUP BY tau")
def escalation(spark, sf):
    rows = both(spark, sf).withColumn("slow_ok", F.col("ok_b")).withColumn("cost", F.lit(1)).withColumn("slow_cost", F.col("length") % 100)
    return rounded(metrics.escalation(rows, spark.createDataFrame([(k / 10,) for k in range(2, 10)], "tau double")))


@query("a28_position_bias", f"{WITH} SELECT source, round(avg(pred / 9.0), 6) AS position, round(avg(CAST(ok AS INT)), 6) AS accuracy, round(avg(CAST(pred = pred_b AS INT)), 6) AS agreement FROM preds GROUP BY source")
def position_bias(spark, sf):
    return rounded(both(spark, sf).groupBy("source").agg(F.avg(F.col("pred") / F.greatest(F.size("p") - 1, F.lit(1))).alias("position"), F.avg(F.col("ok").cast("int")).alias("accuracy"), F.avg((F.col("pred") == F.col("pred_b")).cast("int")).alias("agreement")))


@query("a29_selective_accuracy", f"{WITH}, x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY conf DESC, vec_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM preds) SELECT source, " + ", ".join(f"round(avg(CASE WHEN k <= greatest(1, round_even(n * {s}, 0)) THEN CAST(ok AS INT) END), 6) AS acc_{round(100 * s)}" for s in (1.0, 0.8, 0.6)) + " FROM x GROUP BY source")
def selective_accuracy(spark, sf):
    return rounded(metrics.top_share_accuracy(scored(spark, sf), (1.0, 0.8, 0.6), -F.col("conf"), ["vec_id"], ["source"]))


@query("a37_nearest_rank", f"{WITH}, x AS (SELECT task, length, row_number() OVER (PARTITION BY task ORDER BY length) AS k, count(*) OVER (PARTITION BY task) AS n FROM preds) SELECT task, " + ", ".join(f"max(CASE WHEN k = least(n, CAST(floor(n * {s}) AS BIGINT) + 1) THEN length END) AS q{round(100 * s)}" for s in (0.05, 0.5, 0.95)) + " FROM x GROUP BY task")
def nearest_rank(spark, sf):
    return metrics.nearest_rank(prediction_rows(spark, sf), "length", (0.05, 0.5, 0.95), ["task"])


@query("j01_paired_deltas", f"{WITH} SELECT task, count(*) AS n, round(avg(nll - nll_b), 6) AS nll, round(avg(CAST(ok AS INT)) - avg(CAST(ok_b AS INT)), 6) AS acc FROM preds GROUP BY task")
def paired_deltas(spark, sf):
    return rounded(both(spark, sf).groupBy("task").agg(F.count("*").alias("n"), F.avg(F.col("nll") - F.col("nll_b")).alias("nll"), (F.avg(F.col("ok").cast("int")) - F.avg(F.col("ok_b").cast("int"))).alias("acc")))


@query("j01_join_problems", f"{WITH}, a AS (SELECT id, label, task FROM preds WHERE vec_id % 7 <> 0 UNION ALL SELECT id, label, task FROM preds WHERE vec_id % 50 = 1), b AS (SELECT id, CASE WHEN vec_id % 11 = 0 THEN label + 1 ELSE label END AS label, task FROM preds WHERE vec_id % 5 <> 0), j AS (SELECT a.id AS ai, b.id AS bi, a.label AS al, b.label AS bl FROM a FULL JOIN b ON a.id = b.id) SELECT * FROM (SELECT 'only in a' AS problem, count(*) AS n FROM j WHERE bi IS NULL UNION ALL SELECT 'only in b', count(*) FROM j WHERE ai IS NULL UNION ALL SELECT 'differs: label', count(*) FROM j WHERE al <> bl UNION ALL SELECT 'twice in a', count(*) FROM (SELECT id FROM a GROUP BY id HAVING count(*) > 1)) WHERE n > 0")
def join_problems(spark, sf):
    rows = prediction_rows(spark, sf).select("id", "vec_id", "label", "task")
    a = rows.where("vec_id % 7 <> 0").union(rows.where("vec_id % 50 = 1"))
    b = rows.where("vec_id % 5 <> 0").withColumn("label", F.when(F.col("vec_id") % 11 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return paired.join_problems(a, b, ["id"], ["label", "task"])


DRAWS = "cl AS (SELECT source, grp, row_number() OVER (PARTITION BY source ORDER BY grp) - 1 AS slot, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, grp FROM preds)), dr AS (SELECT b, source, ((((b * 1000003 + slot * 7919 + 17) * 48271) % 2147483647) * 16807) % 2147483647 % n AS slot FROM cl, (SELECT unnest(generate_series(0, 999)) AS b)), tm AS (SELECT b, source, slot, count(*) AS times FROM dr GROUP BY ALL), w AS (SELECT b, tm.source, grp, times FROM tm JOIN cl USING (source, slot)), sm AS (SELECT source, grp, task, sum(nll - nll_b) AS s, count(*) AS c FROM preds GROUP BY ALL)"


@query("b01_paired_bootstrap", f"{WITH}, {DRAWS}, e AS (SELECT b, sum(s * times) / sum(c * times) AS m FROM w JOIN sm USING (source, grp) GROUP BY b) SELECT (SELECT round(sum(s) / sum(c), 6) FROM sm) AS delta, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM e")
def paired_bootstrap(spark, sf):
    return rounded(paired.bootstrap_delta(both(spark, sf).withColumn("d", F.col("nll") - F.col("nll_b")), "d"))


@query("b01_paired_bootstrap_macro", f"{WITH}, {DRAWS}, e AS (SELECT b, avg(m) AS m FROM (SELECT b, task, sum(s * times) / sum(c * times) AS m FROM w JOIN sm USING (source, grp) GROUP BY b, task) GROUP BY b) SELECT (SELECT round(avg(m), 6) FROM (SELECT sum(s) / sum(c) AS m FROM sm GROUP BY task)) AS delta, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM e")
def paired_bootstrap_macro(spark, sf):
    return rounded(paired.bootstrap_delta(both(spark, sf).withColumn("d", F.col("nll") - F.col("nll_b")), "d", macro=True))


@query("b04_index_interval", f"{WITH}, o AS (SELECT CAST(ok AS DOUBLE) AS v, row_number() OVER (ORDER BY id) - 1 AS slot, count(*) OVER () AS n FROM preds), d AS (SELECT b, ((((b * 1000003 + slot * 7919 + 17) * 48271) % 2147483647) * 16807) % 2147483647 % n AS slot FROM o, (SELECT unnest(generate_series(0, 1999)) AS b)), m AS (SELECT b, avg(v) AS m FROM d JOIN o USING (slot) GROUP BY b), s AS (SELECT list_sort(list(m)) AS l FROM m) SELECT (SELECT round(avg(v), 6) FROM o) AS mean, round(l[51], 6) AS lower, round(l[1951], 6) AS upper FROM s")
def index_interval(spark, sf):
    return rounded(paired.index_interval(scored(spark, sf), "ok"))


AREAS = {"x": ["s0", "s1"], "y": ["s2", "s3", "s4"]}


@query("b02_bootstrap_index", f"""{WITH}, u AS (SELECT source AS dataset, vec_id // 20 AS record, ok, ok_b FROM preds),
o AS (SELECT dataset, record, CASE WHEN dataset = 's3' THEN CAST(bool_and(ok) AS INT) ELSE sum(CAST(ok AS INT)) END AS a, CASE WHEN dataset = 's3' THEN CAST(bool_and(ok_b) AS INT) ELSE sum(CAST(ok_b AS INT)) END AS b,
 CASE WHEN dataset = 's3' THEN 1 ELSE count(*) END AS units, CASE WHEN dataset = 's3' THEN pow(0.1::DOUBLE, count(*)) ELSE 0.1::DOUBLE * count(*) END AS chance FROM u GROUP BY dataset, record),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY record) - 1 AS slot, count(*) OVER (PARTITION BY dataset) AS k FROM o),
d AS (SELECT r AS rep, dataset, ((((r * 1000003 + slot * 7919 + 17) * 48271) % 2147483647) * 16807) % 2147483647 % k AS slot FROM n, (SELECT unnest(generate_series(0, 1999)) AS r)),
s AS (SELECT rep, dataset, sum(a) / sum(units) AS a, sum(b) / sum(units) AS b, sum(chance) / sum(units) AS c FROM d JOIN n USING (dataset, slot) GROUP BY ALL UNION ALL SELECT -1, dataset, sum(a) / sum(units), sum(b) / sum(units), sum(chance) / sum(units) FROM n GROUP BY dataset),
i AS (SELECT rep, sum(w * greatest(0, least(1, (a - c) / (1 - c)))) AS a, sum(w * greatest(0, least(1, (b - c) / (1 - c)))) AS b FROM (SELECT *, CASE WHEN dataset IN ('s0', 's1') THEN 100.0::DOUBLE / 2 / 2 ELSE 100.0::DOUBLE / 3 / 2 END AS w FROM s) GROUP BY rep)
SELECT 'a' AS system, round(max(a) FILTER (rep = -1), 6) AS score, round(quantile_cont(a, 0.025) FILTER (rep >= 0), 6) AS lower, round(quantile_cont(a, 0.975) FILTER (rep >= 0), 6) AS upper, NULL::DOUBLE AS difference, NULL::DOUBLE AS d_lower, NULL::DOUBLE AS d_upper FROM i
UNION ALL SELECT 'b', round(max(b) FILTER (rep = -1), 6), round(quantile_cont(b, 0.025) FILTER (rep >= 0), 6), round(quantile_cont(b, 0.975) FILTER (rep >= 0), 6), round(max(b - a) FILTER (rep = -1), 6), round(quantile_cont(b - a, 0.025) FILTER (rep >= 0), 6), round(quantile_cont(b - a, 0.975) FILTER (rep >= 0), 6) FROM i""")
def bootstrap_index(spark, sf):
    """Both systems on records of up to four questions of five datasets in two areas; s3 counts only whole records."""
    rows = both(spark, sf).withColumn("record", F.floor(F.col("vec_id") / 20))
    rows = rows.select("source", "record", F.explode(F.array(F.struct(F.lit("a").alias("system"), F.col("ok").alias("ok")), F.struct(F.lit("b").alias("system"), F.col("ok_b").alias("ok")))).alias("x")).select(F.col("source").alias("dataset"), "record", "x.*")
    whole = F.col("dataset") == "s3"
    each = rows.groupBy("dataset", "record", "system").agg(F.sum(F.col("ok").cast("int")).alias("right"), F.bool_and("ok").alias("all"), F.count("*").alias("n"))
    outcomes = each.select("dataset", "record", "system", F.when(whole, F.col("all").cast("double")).otherwise(F.col("right")).alias("correct"), F.when(whole, 1.0).otherwise(F.col("n")).alias("units"), F.when(whole, F.pow(F.lit(0.1), F.col("n"))).otherwise(0.1 * F.col("n")).alias("chance"))
    return rounded(paired.bootstrap_index(outcomes, AREAS))


@query("b05_pooled_temperature", f"""{WITH}, kept AS (SELECT * FROM preds WHERE NOT (vec_id % 2 = 0 AND source NOT IN ('s0', 's1')) AND vec_id % 10 <> 3),
{losses_sql(GRID, "id, source, grp").replace("FROM preds", "FROM kept")},
cl AS (SELECT source, grp, row_number() OVER (PARTITION BY source ORDER BY grp) - 1 AS slot, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, grp FROM kept)),
dr AS (SELECT b, source, ((((b * 1000003 + slot * 7919 + 17) * 48271) % 2147483647) * 16807) % 2147483647 % n AS slot FROM cl, (SELECT unnest(generate_series(0, 1999)) AS b)),
cs AS (SELECT source, slot, list(s ORDER BY i) AS s FROM (SELECT source, grp, i, sum(loss) AS s FROM l GROUP BY ALL) JOIN cl USING (source, grp) GROUP BY ALL),
sums AS (SELECT b, i, sum(s[i + 1]) AS s FROM dr JOIN cs USING (source, slot), (SELECT unnest(generate_series(0, {len(GRID) - 1})) AS i) GROUP BY b, i),
f AS (SELECT b, arg_min(temperature, struct_pack(s := round(s, 9), i := i)) AS t FROM sums JOIN grid USING (i) GROUP BY b),
p AS (SELECT arg_min(temperature, struct_pack(s := round(s, 9), i := i)) AS t FROM (SELECT i, sum(loss) AS s FROM l GROUP BY i) JOIN grid USING (i))
SELECT (SELECT count(*) FROM kept) AS questions, round((SELECT t FROM p), 6) AS temperature, round(quantile_cont(t, 0.05), 6) AS lower, round(quantile_cont(t, 0.95), 6) AS upper FROM f""")
def pooled_temperature(spark, sf):
    """Two reads pooled: even questions of two sources, odd ones of all, but for records of an excluded read."""
    rows = scored(spark, sf).withColumn("read", F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd"))
    return rounded(calibrate.temperature_interval(calibrate.pool(rows, {"even": ["s0", "s1"]}, rows.where("vec_id % 10 = 3"))))


@query("j05_averaged", f"{WITH} SELECT id, round((list_max(list_transform(list_zip(p, p_b), lambda x: (x[1] + x[2]) / 2))), 7) AS conf, list_position(list_transform(list_zip(p, p_b), lambda x: (x[1] + x[2]) / 2), list_max(list_transform(list_zip(p, p_b), lambda x: (x[1] + x[2]) / 2))) - 1 AS pred FROM preds")
def averaged(spark, sf):
    rows = prediction_rows(spark, sf)
    runs = rows.select("id", "question", "p").union(rows.select("id", "question", F.col("p_b")))
    return paired.averaged(runs).select("id", F.round(F.array_max("p"), 7).alias("conf"), P.first_argmax(F.col("p")).alias("pred"))


ROT = "rot AS (SELECT *, list_concat(p_b[4:10], p_b[1:3]) AS q FROM preds)"


@query("j03_permuted", f"{WITH} SELECT source, count(*) AS n, round(avg(list_max(list_transform(list_zip(p, p_b), lambda x: abs(x[1] - x[2])))), 6) AS drift, round(avg(CAST(pred <> pred_b AS INT)), 6) AS flips FROM preds GROUP BY source")
def permuted(spark, sf):
    """System B answers with its options rotated by three; it is put back in order by option name."""
    rows = prediction_rows(spark, sf).withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: k.cast("string")))
    turned = rows.select("id", "question", F.concat(F.slice("keys", 4, 7), F.slice("keys", 1, 3)).alias("keys"), F.concat(F.slice("p_b", 4, 7), F.slice("p_b", 1, 3)).alias("p"))
    got = paired.realigned(turned, rows, ["id", "question"]).join(rows.select("id", "source"), "id")
    drift = F.array_max(F.zip_with("p", "o_p", lambda a, b: F.abs(a - b)))
    return rounded(got.groupBy("source").agg(F.count("*").alias("n"), F.avg(drift).alias("drift"), F.avg((P.first_argmax(F.col("p")) != P.first_argmax(F.col("o_p"))).cast("int")).alias("flips")))


@query("a20_pair_flips", f"{WITH}, x AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS s, label, pred, ok FROM preds), y AS (SELECT a.label <> b.label AS relevant, a.pred <> b.pred AS flip, a.ok AND b.ok AS ok FROM x a JOIN x b ON a.pair = b.pair AND a.s = 0 AND b.s = 1) SELECT relevant, count(*) AS n, round(avg(CAST(flip AS INT)), 6) AS flip_rate, round(avg(CAST(ok AS INT)), 6) AS both_correct FROM y GROUP BY relevant")
def pair_flips(spark, sf):
    rows = scored(spark, sf).withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: k.cast("string")))
    return rounded(paired.pair_flips(rows.withColumn("pair_id", F.floor(F.col("vec_id") / 2).cast("string")).withColumn("sibling", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b"))))


@query("w4_top_disagreements", f"{WITH} SELECT id, round(conf + conf_b, 6) AS score FROM preds WHERE ok <> ok_b ORDER BY round(conf + conf_b, 6) DESC, id DESC LIMIT 10")
def top_disagreements(spark, sf):
    return both(spark, sf).where("ok <> ok_b").select("id", F.round(F.col("conf") + F.col("conf_b"), 6).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(10)


@query("l05_confidences", f"{WITH} SELECT id, round((conf / list_sum(p) - 0.1) / 0.9, 6) AS choice, round(greatest(0, 1 - list_sum(list_transform(p, lambda x, k: x / list_sum(p) * abs(k - 1 - pred))) / 2.5), 6) AS score FROM preds")
def confidences(spark, sf):
    return rounded(scored(spark, sf).select("id", P.choice_confidence(F.col("p")).alias("choice"), P.score_confidence(F.col("p")).alias("score")))


@query("l22_entropy_margin", f"{WITH} SELECT id, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS entropy, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin FROM preds")
def entropy_margin(spark, sf):
    return rounded(scored(spark, sf).select("id", P.entropy(F.col("p")).alias("entropy"), P.margin(F.col("p")).alias("margin")))


@query("a01_ordered_scores", f"{WITH}, c AS (SELECT *, list_transform(p, lambda x, k: list_sum(p[1:k]) - CASE WHEN label <= k - 1 THEN 1 ELSE 0 END) AS d FROM preds) SELECT task, round(avg(abs(list_sum(list_transform(p, lambda x, k: x * (k - 1))) - label)), 6) AS mae, round(avg(list_sum(list_transform(d[1:9], lambda x: x * x)) / 9), 6) AS rps FROM c GROUP BY task")
def ordered_scores(spark, sf):
    return rounded(scored(spark, sf).groupBy("task").agg(F.avg(P.level_error(F.col("p"), F.col("label"))).alias("mae"), F.avg(P.ranked_score(F.col("p"), F.col("label"))).alias("rps")))


@query("p03_distribution_check", f"{WITH} SELECT id, abs(list_sum(p) - 1) <= 0.05000001 AND list_max(p) <= 1 AS valid, round(list_sum(p), 4) AS total FROM preds")
def distribution_check(spark, sf):
    return prediction_rows(spark, sf).select("id", P.valid_distribution(F.col("p")).alias("valid"), F.round(P.total(F.col("p")), 4).alias("total"))


CHANCE = "x AS (SELECT 'd' || (vec_id % 6) AS dataset, 'area' || (vec_id % 2) AS area, ok, vec_id % 4 <> 3 AS answered, conf FROM preds), d AS (SELECT area, dataset, avg(CASE WHEN answered AND ok THEN 1.0 ELSE 0 END) AS score, avg(CAST(answered AS INT)) AS answered FROM x GROUP BY ALL), s AS (SELECT *, least(1, greatest(0, (score - 0.1) / 0.9)) AS skill FROM d)"


def breadth(spark, sf):
    rows = scored(spark, sf).withColumn("dataset", F.concat(F.lit("d"), F.col("vec_id") % 6)).withColumn("area", F.concat(F.lit("area"), F.col("vec_id") % 2))
    answers = rows.where("vec_id % 4 <> 3").select("id", "ok")
    each = rows.drop("ok").join(answers, "id", "left").groupBy("area", "dataset").agg(F.avg(F.coalesce(F.col("ok"), F.lit(False)).cast("int")).alias("score"), F.avg(F.col("ok").isNotNull().cast("int")).alias("answered"))
    return each.withColumn("skill", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") - 0.1) / 0.9)))


@query("a17_dataset_scores", f"{WITH}, {CHANCE} SELECT area, dataset, round(score, 6) AS score, round(answered, 6) AS answered, round(skill, 6) AS skill FROM s")
def dataset_scores(spark, sf):
    return rounded(breadth(spark, sf))


@query("a18_breadth_index", f"{WITH}, {CHANCE} SELECT round(100 * avg(a), 6) AS breadth FROM (SELECT area, avg(skill) AS a FROM s GROUP BY area)")
def breadth_index(spark, sf):
    return rounded(breadth(spark, sf).groupBy("area").agg(F.avg("skill").alias("a")).agg((100 * F.avg("a")).alias("breadth")))


@query("a19_objective", f"{WITH} SELECT round(-avg(m), 6) AS objective, count(*) AS tasks FROM (SELECT task, avg(nll) AS m FROM (SELECT nll, CASE source WHEN 's0' THEN 'unknowable_a' WHEN 's1' THEN 'unknowable_control_a' ELSE task END AS task FROM preds) WHERE task NOT LIKE 'unknowable\\_%' ESCAPE '\\' OR task LIKE 'unknowable\\_control%' ESCAPE '\\' GROUP BY task)")
def objective(spark, sf):
    rows = scored(spark, sf).withColumn("task", F.when(F.col("source") == "s0", "unknowable_a").when(F.col("source") == "s1", "unknowable_control_a").otherwise(F.col("task")))
    keep = ~F.col("task").startswith("unknowable_") | F.col("task").startswith("unknowable_control")
    return rounded(rows.where(keep).groupBy("task").agg(F.avg("nll").alias("m")).agg((-F.avg("m")).alias("objective"), F.count("*").alias("tasks")))


@query("a09_unknowable", f"{WITH}, u AS (SELECT vec_id, conf, vec_id + 1 AS control FROM preds WHERE vec_id % 5 = 0) SELECT round(avg(u.conf), 6) AS mean_conf, round(avg(CAST(u.conf >= 0.9 AS INT)), 6) AS share_sure, round(avg(c.conf), 6) AS control_conf, round(avg(c.conf - u.conf), 6) AS mean_drop, round(avg(CASE WHEN c.conf IS NOT NULL THEN CAST(u.conf < c.conf AS INT) END), 6) AS share_lower FROM u LEFT JOIN preds c ON c.vec_id = u.control")
def unknowable(spark, sf):
    rows = scored(spark, sf)
    u = rows.where("vec_id % 5 = 0").select("conf", (F.col("vec_id") + 1).alias("vec_id"))
    c = rows.select("vec_id", F.col("conf").alias("c"))
    j = u.join(c, "vec_id", "left")
    return rounded(j.agg(F.avg("conf").alias("mean_conf"), F.avg((F.col("conf") >= 0.9).cast("int")).alias("share_sure"), F.avg("c").alias("control_conf"), F.avg(F.col("c") - F.col("conf")).alias("mean_drop"), F.avg((F.col("conf") < F.col("c")).cast("int")).alias("share_lower")))


@query("a45_latency", f"{WITH}, x AS (SELECT task, length, row_number() OVER (PARTITION BY task ORDER BY length) AS k, count(*) OVER (PARTITION BY task) AS n FROM preds) SELECT task, round(median(length), 6) AS p50, max(CASE WHEN k = least(n, CAST(floor(n * 0.99) AS BIGINT) + 1) THEN length END) AS p99, max(length) AS worst FROM x GROUP BY task")
def latency(spark, sf):
    rows = prediction_rows(spark, sf)
    p50 = rows.groupBy("task").agg(F.round(F.percentile("length", 0.5), 6).alias("p50"), F.max("length").alias("worst"))
    return p50.join(metrics.nearest_rank(rows, "length", (0.99,), ["task"]).withColumnRenamed("q99", "p99"), "task")


@query("a35_grouping_sets", f"{WITH} SELECT coalesce(task, 'overall') AS type, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS acc, round(avg(CAST(ok_b AS INT)), 6) AS acc_b, round(avg(CASE WHEN conf >= 0.5 THEN CAST(ok AS INT) END), 6) AS committed FROM preds GROUP BY GROUPING SETS ((task), ())")
def grouping_sets(spark, sf):
    """Rows are means over rows, so one rollup gives each type and the whole."""
    ok = lambda c: F.avg(F.col(c).cast("int"))
    return rounded(both(spark, sf).rollup("task").agg(F.count("*").alias("n"), ok("ok").alias("acc"), ok("ok_b").alias("acc_b"), F.avg(F.when(F.col("conf") >= 0.5, F.col("ok").cast("int"))).alias("committed")).withColumn("type", F.coalesce("task", F.lit("overall"))).drop("task"))
