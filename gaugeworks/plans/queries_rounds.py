"""Queries of the read-out language over prediction rows: system B is the candidate, system A its parent; arms are B at several temperatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import probability as P
from gaugeworks.operators import metrics, paired
from gaugeworks.plans import rounds
from gaugeworks.plans.registry import query
from gaugeworks.sources.fixtures import SQL as PREDS
from gaugeworks.sources.fixtures import prediction_rows

WITH = f"WITH {PREDS}"
PANELS = {"all": {}, "kept": {"exclude_sources": ["s0"], "exclude": ["t2"]}, "some": {"sources": ["s1", "s3"]}}
#: The panels as SQL predicates.
PANEL_SQL = {"all": "true", "kept": "source <> 's0' AND task <> 't2'", "some": "source IN ('s1', 's3')"}
SPEC = {
    "panels": PANELS,
    "criteria": [{"left": "all.acc.candidate", "op": ">=", "right": "all.acc.parent", "plus": -0.5}, {"left": ["kept.mean_conf.candidate", "kept.mean_conf.parent"], "op": "<", "right": 0.9}, {"left": "some.n.candidate", "op": ">", "right": 0}],
    "rank": [{"by": ["all.brier.candidate", "kept.brier.candidate"], "order": "asc"}, {"by": "all.acc.candidate"}],
}
TEMPERATURES = (1.0, 1.5, 2.5)


def sides(spark, sf):
    """Scored rows of the candidate (B) and of the parent (A)."""
    rows = prediction_rows(spark, sf).withColumn("pair", F.col("id"))
    return metrics.scored(rows.withColumn("p", F.col("p_b"))), metrics.scored(rows)


def arms(spark, sf):
    """B served at each temperature, rounded as a stored file would be."""
    rows = prediction_rows(spark, sf)
    served = lambda t: metrics.scored(rows.withColumn("p", F.transform(P.softmax(F.col("logits_b"), t), lambda x: F.round(x, 6))))
    return {f"b-t{round(10 * t)}": served(t) for t in TEMPERATURES}


SIDES = """b0 AS (SELECT *, list_sum(list_transform(p_b, lambda x, k: CASE WHEN k = label + 1 THEN (x - 1) * (x - 1) ELSE x * x END)) AS brier_b FROM preds),
both_ AS (SELECT id, source, task, grp, length, 'candidate' AS side, conf_b AS conf, ok_b AS ok, nll_b AS nll, brier_b AS brier FROM b0 UNION ALL SELECT id, source, task, grp, length, 'parent', conf, ok, nll, brier FROM b0),
panels AS (""" + " UNION ALL ".join(f"SELECT '{name}' AS panel, * FROM both_ WHERE {where}" for name, where in PANEL_SQL.items()) + ")"
BLOCK = "block AS (SELECT panel, side, count(*)::DOUBLE AS n, avg(nll) AS nll, avg(CAST(ok AS INT)) AS acc, avg(brier) AS brier, avg(conf) AS mean_conf, avg(CAST(conf >= 0.9 AND NOT ok AS INT)) AS confident_error_rate, avg(CAST(conf >= 0.9 AS INT)) AS coverage_at_0_9, avg(conf) - avg(CAST(ok AS INT)) AS confidence_bias FROM panels GROUP BY ALL)"
#: The rest of the block (calibration and risk), and the intervals of the paired differences, from the fixed draws.
REST = f"""bins AS (SELECT panel, side, count(*) AS c, abs(avg(CAST(ok AS INT)) - avg(conf)) AS gap FROM panels GROUP BY panel, side, len(list_filter({list(P.EDGES[1:])}::DOUBLE[], lambda e: conf >= e))),
ece AS (SELECT panel, side, sum(c * gap) / sum(c) AS ece FROM bins GROUP BY ALL),
curve AS (SELECT panel, side, conf, c, sum(c) OVER w AS accepted, sum(e) OVER w AS errors FROM (SELECT panel, side, conf, count(*) AS c, count(*) FILTER (NOT ok) AS e FROM panels GROUP BY ALL) WINDOW w AS (PARTITION BY panel, side ORDER BY conf DESC)),
risk AS (SELECT panel, side, coalesce(max(accepted) FILTER (errors <= 0.05 * accepted), 0) / sum(c) AS coverage_at_5, coalesce(max(accepted) FILTER (errors <= 0.01 * accepted), 0) / sum(c) AS coverage_at_1, sum(c * errors / accepted) / sum(c) AS aurc FROM curve GROUP BY ALL),
whole AS (SELECT * FROM block JOIN ece USING (panel, side) JOIN risk USING (panel, side)),
pairs AS (SELECT panel, c.source, c.grp, c.nll - p.nll AS nll, CAST(c.ok AS INT) - CAST(p.ok AS INT) AS acc FROM panels c JOIN panels p USING (panel, id) WHERE c.side = 'candidate' AND p.side = 'parent'),
cs AS (SELECT panel, source, row_number() OVER (PARTITION BY panel, source ORDER BY grp) - 1 AS slot, count(*) OVER (PARTITION BY panel, source) AS k, * EXCLUDE (panel, source, grp) FROM (SELECT panel, source, grp, sum(nll) AS nll, sum(acc) AS acc, count(*) AS c FROM pairs GROUP BY ALL)),
dr AS (SELECT b, panel, source, ((((b * 1000003 + slot * 7919 + 17) * 48271) % 2147483647) * 16807) % 2147483647 % k AS slot FROM cs, (SELECT unnest(generate_series(0, {rounds.SAMPLES - 1})) AS b)),
reps AS (SELECT b, panel, sum(nll) / sum(c) AS nll, sum(acc) / sum(c) AS acc FROM dr JOIN cs USING (panel, source, slot) GROUP BY b, panel),
ends AS (SELECT panel, metric, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM (UNPIVOT reps ON nll, acc INTO NAME metric VALUE value) GROUP BY ALL)"""
LONG = f"long AS (UNPIVOT whole ON {', '.join(rounds.METRICS)} INTO NAME metric VALUE value)"


@query("q04_panel_values", f"{WITH}, {SIDES}, {BLOCK}, {REST}, {LONG} SELECT panel, metric, side, round(value, 6) AS value FROM long UNION ALL SELECT panel, metric, 'delta', round(max(value) FILTER (side = 'candidate') - max(value) FILTER (side = 'parent'), 6) FROM long GROUP BY panel, metric UNION ALL SELECT panel, metric, 'lower', round(lower, 6) FROM ends UNION ALL SELECT panel, metric, 'upper', round(upper, 6) FROM ends")
def panel_values(spark, sf):
    """All panels: every metric of both sides, their difference, and the intervals of the paired ones."""
    candidate, parent = sides(spark, sf)
    return rounds.compare(candidate, parent, SPEC).select("panel", "metric", "side", F.round("value", 6).alias("value"))


LENGTHS = " UNION ALL ".join(f"SELECT '{name}' AS bucket, * FROM both_ WHERE source <> 's4' AND length >= {lo}{f' AND length < {hi}' if hi else ''}" for name, lo, hi in metrics.length_buckets())


@query("q04_lengths_and_unknowable", f"""{WITH}, {SIDES}, lengths AS ({LENGTHS}),
bins AS (SELECT bucket, side, count(*) AS c, abs(avg(CAST(ok AS INT)) - avg(conf)) AS gap FROM lengths GROUP BY bucket, side, len(list_filter({list(P.EDGES[1:])}::DOUBLE[], lambda e: conf >= e))),
e AS (SELECT bucket, side, sum(c * gap) / sum(c) AS ece FROM bins GROUP BY ALL),
m AS (SELECT bucket, side, count(*)::DOUBLE AS n, avg(CAST(ok AS INT)) AS acc, avg(conf) AS mean_conf, avg(brier) AS brier, avg(CAST(conf >= 0.9 AND NOT ok AS INT)) AS confident_error_rate FROM lengths GROUP BY ALL),
long AS (UNPIVOT (SELECT * FROM m JOIN e USING (bucket, side)) ON n, acc, mean_conf, brier, confident_error_rate, ece INTO NAME metric VALUE value)
SELECT 'all.' || metric || '_' || bucket || '.' || side AS path, round(value, 6) AS value FROM long UNION ALL SELECT 'unknowable.' || side, round(avg(CAST(conf >= 0.9 AS INT)), 6) FROM both_ WHERE source = 's4' GROUP BY side""")
def lengths_and_unknowable(spark, sf):
    """The bucket and unknowable paths of a report; source s4 stands for unknowable questions."""
    unknown = lambda df: df.withColumn("source", F.when(F.col("source") == "s4", "unknowable").otherwise(F.col("source")))
    candidate, parent = map(unknown, sides(spark, sf))
    report = rounds.compare(candidate, parent, {"panels": {"all": {"by_length": True}}, "unknowable": True, "samples": rounds.SAMPLES})
    return report.where((F.col("panel") == "unknowable") | F.col("metric").isin(*rounds.LENGTH_NAMES)).where(F.col("side").isin("candidate", "parent")).select("path", F.round("value", 6).alias("value"))


@query("q05_criteria", f"{WITH}, {SIDES}, {BLOCK}, v AS (SELECT panel, max(acc) FILTER (side = 'candidate') AS ca, max(acc) FILTER (side = 'parent') AS pa, max(mean_conf) FILTER (side = 'candidate') AS cm, max(mean_conf) FILTER (side = 'parent') AS pm, max(n) FILTER (side = 'candidate') AS cn FROM block GROUP BY panel) SELECT 0 AS k, ca >= pa - 0.5 AS holds FROM v WHERE panel = 'all' UNION ALL SELECT 1, cm - pm < 0.9 FROM v WHERE panel = 'kept' UNION ALL SELECT 2, cn > 0 FROM v WHERE panel = 'some' UNION ALL SELECT 3, NULL")
def criteria(spark, sf):
    """The spec's criteria and one whose value is missing."""
    candidate, parent = sides(spark, sf)
    spec = SPEC | {"criteria": [*SPEC["criteria"], {"left": "gone.acc.delta", "op": ">", "right": 0}]}
    return rounds.criteria(rounds.reports({"b": candidate}, parent, spec), spec).select("k", "holds")


ARMS = "arm_rows AS (" + " UNION ALL ".join(f"SELECT 'b-t{round(10 * t)}' AS arm, source, task, label, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM (SELECT source, task, label, list_transform(logits_b, lambda x: exp((x - list_max(logits_b)) / {t})) AS e FROM preds)" for t in TEMPERATURES) + "), arm_scores AS (SELECT *, list_max(p) AS conf, list_position(p, list_max(p)) - 1 = label AS ok, list_sum(list_transform(p, lambda x, k: CASE WHEN k = label + 1 THEN (x - 1) * (x - 1) ELSE x * x END)) AS brier FROM arm_rows)"


@query("q08_read_out", f"{WITH}, {ARMS}, parent AS (SELECT avg(CAST(ok AS INT)) AS acc, avg(conf) FILTER ({PANEL_SQL['kept']}) AS kept FROM preds), a AS (SELECT arm, avg(CAST(ok AS INT)) AS acc, avg(brier) AS brier, avg(brier) FILTER ({PANEL_SQL['kept']}) AS brier_kept, avg(conf) FILTER ({PANEL_SQL['kept']}) AS conf_kept, count(*) FILTER ({PANEL_SQL['some']}) AS n FROM arm_scores GROUP BY arm), j AS (SELECT arm, a.acc >= parent.acc - 0.5 AND conf_kept - parent.kept < 0.9 AND n > 0 AS passed, brier + brier_kept AS rank_key, a.acc AS acc FROM a, parent) SELECT arm, passed, CASE WHEN passed THEN CAST(row_number() OVER (PARTITION BY passed ORDER BY rank_key, acc DESC, arm) AS INTEGER) END AS place FROM j")
def read_out(spark, sf):
    """Every arm's verdict, and the passing ones placed by a sum of two paths, then by accuracy."""
    _, parent = sides(spark, sf)
    return rounds.read_out(arms(spark, sf), parent, SPEC).select("arm", "passed", "place")


def specs(spark, sf):
    """A spec for each customer as JSON: c_custkey, spec. What is wrong with it follows from the key."""
    k = F.col("c_custkey")
    when = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    panel = F.concat(F.lit('{"sources": ["x"]'), when(3, F.lit(', "exclude_sources": ["x"]'), F.lit("")), when(5, F.lit(', "odd": 1'), F.lit("")), F.lit("}"))
    first = F.concat(F.lit('{"left": "'), when(2, F.lit("a"), F.lit("b")), F.lit('.acc.delta", "op": "'), when(7, F.lit("="), F.lit(">")), F.lit('", "right": 0}'))
    second = F.concat(F.lit('{"left": ["a.acc.parent", "a.ece.'), when(4, F.lit("lower"), F.lit("parent")), F.lit('"], "op": "<", "right": 0.5}'))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.concat(F.lit('{"panels": {"a": '), panel, F.lit('}, "criteria": ['), first, F.lit(", "), second, F.lit("]}")).alias("spec"))


@query("q02_spec_problems", "SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'panel a: unknown odd' END, CASE WHEN c_custkey % 3 = 0 THEN 'panel a: x both in and out' END, CASE WHEN c_custkey % 7 = 0 THEN 'criterion: unknown op =' END, CASE WHEN c_custkey % 2 <> 0 THEN 'b.acc.delta: no such panel' END, CASE WHEN c_custkey % 4 = 0 THEN 'a.ece.lower: no such side' END], lambda x: x IS NOT NULL)) AS problem FROM customer")
def spec_problems(spark, sf):
    return rounds.problems(specs(spark, sf), "spec").select("c_custkey", F.explode("problems").alias("problem"))


@query("q09_moves_with_temperature", "SELECT c_custkey, 'a.acc.parent,a.ece.' || CASE WHEN c_custkey % 4 = 0 THEN 'lower' ELSE 'parent' END AS criteria FROM customer")
def moves_with_temperature(spark, sf):
    """The criteria of each customer's spec that a temperature moves: the one on ece, not the one on accuracy."""
    return rounds.problems(specs(spark, sf), "spec").select("c_custkey", F.array_join("moving", ";").alias("criteria"))


@query("q13_validated_context", f"""{WITH}, b(lo, hi) AS (VALUES (0, 8192), (8192, 16384), (16384, 32768), (32768, 65536)),
pairs AS (SELECT lo, hi, source, grp, CAST(ok AS INT) - CAST(ok_b AS INT) AS d, length % 13 > 0 AS answered FROM b JOIN preds ON length >= lo AND length < hi),
cs AS (SELECT lo, source, row_number() OVER (PARTITION BY lo, source ORDER BY grp) - 1 AS slot, count(*) OVER (PARTITION BY lo, source) AS k, d, c FROM (SELECT lo, source, grp, sum(d) AS d, count(*) AS c FROM pairs GROUP BY ALL)),
dr AS (SELECT i AS b, lo, source, ((((i * 1000003 + slot * 7919 + 17) * 48271) % 2147483647) * 16807) % 2147483647 % k AS slot FROM cs, (SELECT unnest(generate_series(0, {rounds.SAMPLES - 1})) AS i)),
ends AS (SELECT lo, quantile_cont(m, 0.025) AS lower FROM (SELECT b, lo, sum(d) / sum(c) AS m FROM dr JOIN cs USING (lo, source, slot) GROUP BY b, lo) GROUP BY lo),
x AS (SELECT lo, any_value(hi) AS hi, avg(CAST(answered AS INT)) >= 0.9 AND count(*) >= 5 AS complete FROM pairs GROUP BY lo),
c AS (SELECT hi, bool_and(CASE WHEN hi <= 8192 THEN complete ELSE complete AND lower >= -0.4 END) OVER (ORDER BY x.lo) AS chain FROM x JOIN ends USING (lo))
SELECT CAST(greatest(8192, coalesce(max(hi) FILTER (chain), 8192)) AS BIGINT) AS context FROM c""")
def validated_context(spark, sf):
    """The longest unbroken chain of length buckets in which the interval of A less B stays above -0.4 and at least nine tenths of 5 rows or more are answered (all but every thirteenth length)."""
    candidate, parent = sides(spark, sf)
    pairs = parent.join(candidate.select("id", F.col("ok").alias("ok_b")), "id")
    name = F.coalesce(*[F.when((F.col("length") >= lo) & (F.col("length") < hi), F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))) for _, lo, hi in metrics.length_buckets()[:4]])
    pairs = pairs.withColumn("b", name).where("b is not null").select("*", "b.lo", "b.hi")
    ends = paired.bootstrap_ratios(pairs, {"acc": (F.col("ok").cast("int") - F.col("ok_b").cast("int"), F.lit(1))}, rounds.SAMPLES, ["lo", "hi"])
    complete = pairs.groupBy("lo").agg(((F.avg((F.col("length") % 13 > 0).cast("int")) >= 0.9) & (F.count("*") >= 5)).alias("complete"))
    return rounds.validated_context(ends.join(complete, "lo").select("lo", "hi", "lower", "complete"), -0.4)


@query("p05_scored_rows", f"{WITH} SELECT id, round(conf, 6) AS conf, CAST(pred AS INTEGER) AS pred, ok, round(nll, 6) AS nll, round(brier, 6) AS brier FROM preds")
def scored_rows(spark, sf):
    """Every row's confidence, prediction, correctness and losses."""
    rows = prediction_rows(spark, sf).withColumn("nll0", -F.ln(F.greatest(F.get("p", F.col("label")), F.lit(P.FLOOR))))
    return metrics.scored(rows).select("id", F.round("conf", 6).alias("conf"), "pred", "ok", F.round("nll0", 6).alias("nll"), F.round("brier", 6).alias("brier"))
