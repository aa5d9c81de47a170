"""The read-out language: panels of rows, metrics of a candidate and its parent, paired intervals, criteria, ranking.

A spec is a dict (or its JSON), with the words of the registered specs (fixed values)::

    panels    {name: {sources, exclude_sources, exclude_tasks, exclude: [ids, groups, sources or tasks], by_length: true for <metric>_<bucket>}}
    criteria  [{left, op, right[, plus]}]   left: a path or [a, b] for a - b; right: a number or a path; op: > >= < <=
    rank      [{by: a path or a list of paths that are summed, order: asc or desc}]
    samples   resamples of the paired interval
    unknowable   true for the share of confident answers to unknowable questions, the path unknowable.side
    unselectable [arms that are compared but never placed]
    confirm   {stage: {panels, criteria}}

A path is ``panel.metric.side`` with side candidate, parent, delta, lower or upper. analyse() lists all problems of a spec and never
raises; reports() plans all arms, panels and both sides as one table. Criteria and rank keys are tables of paths, joined with the values, so all arms are
judged by one plan; a missing value makes a criterion unknown (null).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.operators import metrics, paired
from gaugeworks.operators.packing import cut_off

METRICS = ("n", "nll", "acc", "ece", "brier", "mean_conf", "confident_error_rate", "coverage_at_0_9", "coverage_at_5", "coverage_at_1", "aurc", "confidence_bias")
PAIRED, SIDES = ("nll", "acc"), ("candidate", "parent", "delta", "lower", "upper")
OPS = (">", ">=", "<", "<=")
#: What a by_length panel gives for each bucket, as <metric>_<bucket>; resamples of the paired interval.
LENGTH_METRICS, SAMPLES = ("n", "acc", "mean_conf", "brier", "confident_error_rate", "ece"), 2000
LENGTH_NAMES = tuple(f"{m}_{b}" for m in LENGTH_METRICS for b, _, _ in metrics.length_buckets())


def load(text: str) -> dict:
    spec = json.loads(text)
    return {"panels": {}, "criteria": [], "rank": [], "samples": SAMPLES} | spec


def panel_filter(panel: Mapping) -> Column:
    """Column predicate of a panel; it reaches the scan."""
    keep = F.lit(True)
    if panel.get("sources"):
        keep &= F.col("source").isin(*panel["sources"])
    for column, name in (("source", "exclude_sources"), ("task", "exclude_tasks")):
        if panel.get(name):
            keep &= ~F.col(column).isin(*panel[name])
    if panel.get("exclude"):
        gone = [str(x) for x in panel["exclude"]]
        keep &= ~reduce(lambda a, b: a | b, [F.col(c).cast("string").isin(*gone) for c in ("id", "grp", "source", "task")])
    return keep


def path_problem(path, panels: Mapping) -> str | None:
    parts = str(path).split(".")
    if parts[0] == "unknowable" and len(parts) == 2:
        return None if parts[1] in SIDES[:3] else f"{path}: no such side"
    if len(parts) != 3:
        return f"{path}: not panel.metric.side"
    panel, metric, side = parts
    if panel not in panels:
        return f"{path}: no such panel"
    if metric not in METRICS and not (metric in LENGTH_NAMES and panels[panel].get("by_length")):
        return f"{path}: no such metric"
    if side not in SIDES or (side in ("lower", "upper") and metric not in PAIRED):
        return f"{path}: no such side"
    return None


def paths_of(criterion: Mapping) -> list:
    left = criterion.get("left")
    return [*(left if isinstance(left, list) else [left]), *([criterion["right"]] if isinstance(criterion.get("right"), str) else [])]


def analyse(spec: Mapping) -> list[str]:
    """All problems; none for a good spec."""
    out, panels = [], spec.get("panels") or {}
    if not panels:
        out.append("no panels")
    for name, panel in panels.items():
        unknown = set(panel) - {"sources", "exclude_sources", "exclude_tasks", "exclude", "by_length"}
        out += [f"panel {name}: unknown {x}" for x in sorted(unknown)]
        both = set(panel.get("sources") or ()) & set(panel.get("exclude_sources") or ())
        out += [f"panel {name}: {x} both in and out" for x in sorted(both)]
    for c in spec.get("criteria") or []:
        if c.get("op") not in OPS:
            out.append(f"criterion: unknown op {c.get('op')}")
        if isinstance(c.get("left"), list) and len(c["left"]) != 2:
            out.append("criterion: a difference has two paths")
        if not isinstance(c.get("right"), (int, float, str)) or isinstance(c.get("right"), bool):
            out.append("criterion: right must be a number or a path")
        out += [p for x in paths_of(c) if (p := path_problem(x, panels))]
    by = [x for r in spec.get("rank") or [] for key in [r.get("by", r.get("path"))] for x in (key if isinstance(key, list) else [key])]
    out += [p for x in by if (p := path_problem(x, panels))]
    return out


def moves_with_temperature(spec: Mapping) -> list[dict]:
    """Criteria that a temperature changes: all that use a metric of confidence or loss (accuracy and n don't)."""
    return [c for c in spec.get("criteria") or [] if any(str(p).split(".")[1:2] not in (["acc"], ["n"]) for p in paths_of(c))]


def problems(specs: DataFrame, text: str) -> DataFrame:
    """specs with problems (analyse() of the JSON in the column text; one that says so where it is no JSON object) and moving (the paths of the criteria that a temperature moves)."""

    def checked(raw: str | None) -> tuple[list[str], list[str]]:
        try:
            spec = load(raw or "")
        except (ValueError, TypeError):
            return ["no JSON object"], []
        return analyse(spec), [",".join(map(str, paths_of(c))) for c in moves_with_temperature(spec)]

    @F.pandas_udf("problems array<string>, moving array<string>")
    def each(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([checked(x) for x in raw], columns=["problems", "moving"])

    return specs.withColumn("_checked", each(text)).select(*specs.columns, "_checked.problems", "_checked.moving")


COLUMNS = ("id", "question", "source", "task", "grp", "variant", "conf", "ok", "nll", "brier")
PARENT = ""


def _long(block: DataFrame, keys: list[str], names: Sequence[str], suffix: Column | None = None) -> DataFrame:
    """keys, metric, value of a metric block, with a suffix to the metric's name."""
    name = lambda m: F.lit(m) if suffix is None else F.concat(F.lit(f"{m}_"), suffix)
    return block.select(*keys, F.explode(F.array(*[F.struct(name(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("x")).select(*keys, "x.metric", "x.value")


def reports(candidates: Mapping[str, DataFrame], parent: DataFrame, spec: Mapping) -> DataFrame:
    """arm, panel, metric, side, value, path of every arm against the parent.

    All arms and the parent are one table with a column that says who a row is of, so there is one metric block, one join of pairs and one set of draws for all. The result has as many rows as the spec has
    values; it is made once and then local.
    """
    names = F.array_compact(F.array(*[F.when(panel_filter(p), F.lit(n)) for n, p in spec["panels"].items()]))
    placed = lambda df: df.withColumn("panel", F.explode(names))
    columns = [*COLUMNS, *(["length"] if any(p.get("by_length") for p in spec["panels"].values()) else [])]
    rows = reduce(DataFrame.union, [df.select(*columns, F.lit(f"={arm}").alias("who")) for arm, df in candidates.items()])
    every = cut_off(rows.union(parent.select(*columns, F.lit(PARENT).alias("who"))))  # scored once: six aggregates and the pairs read it
    block = _long(metrics.metric_block(placed(metrics.knowable(every)), ["who", "panel"]), ["who", "panel"], METRICS)
    if lengthy := [n for n, p in spec["panels"].items() if p.get("by_length")]:
        inside = F.array_compact(F.array(*[F.when((F.col("length") >= lo) & (F.col("length") < hi if hi else F.lit(True)), F.lit(n)) for n, lo, hi in metrics.length_buckets()]))
        by = placed(metrics.knowable(every)).where(F.col("panel").isin(*lengthy)).withColumn("bucket", F.explode(inside))
        block = block.union(_long(metrics.metric_block(by, ["who", "panel", "bucket"]), ["who", "panel"], LENGTH_METRICS, F.col("bucket")))
    if spec.get("unknowable"):
        sure = every.where((F.col("variant") == "clean") & (F.col("source") == "unknowable")).groupBy("who").agg(F.avg((F.col("conf") >= 0.9).cast("double")).alias("value"))
        block = block.union(sure.select("who", F.lit("unknowable").alias("panel"), F.lit("share").alias("metric"), "value"))
    own = block.where(F.col("who") != PARENT).select(F.substring("who", 2, 1 << 20).alias("arm"), "panel", "metric", F.col("value").alias("c"))
    base = block.where(F.col("who") == PARENT).select("panel", "metric", F.col("value").alias("p"), F.explode(F.array(*map(F.lit, candidates))).alias("arm"))
    both = own.join(base, ["arm", "panel", "metric"], "full_outer")
    side = lambda name, c: F.struct(F.lit(name).alias("side"), c.alias("value"))
    out = both.select("arm", "panel", "metric", F.explode(F.array(side("candidate", F.col("c")), side("parent", F.col("p")), side("delta", F.col("c") - F.col("p")))).alias("x")).select("arm", "panel", "metric", "x.side", "x.value")

    b = every.where(F.col("who") == PARENT).select("id", "question", F.col("nll").alias("_nll"), F.col("ok").cast("double").alias("_acc"))
    pairs = placed(metrics.knowable(every.where(F.col("who") != PARENT)).join(b, ["id", "question"])).withColumn("arm", F.substring("who", 2, 1 << 20))
    ratios = {"nll": (F.col("nll") - F.col("_nll"), F.lit(1)), "acc": (F.col("ok").cast("double") - F.col("_acc"), F.lit(1))}
    ends = paired.bootstrap_ratios(pairs, ratios, int(spec.get("samples", SAMPLES)), ["arm", "panel"])
    ends = ends.select("arm", "panel", F.col("name").alias("metric"), F.explode(F.array(side("lower", F.col("lower")), side("upper", F.col("upper")))).alias("x")).select("arm", "panel", "metric", "x.side", "x.value")
    path = F.when((F.col("panel") == "unknowable") & (F.col("metric") == "share"), F.concat_ws(".", "panel", "side")).otherwise(F.concat_ws(".", "panel", "metric", "side"))
    found = out.union(ends).withColumn("path", path)
    return found.sparkSession.createDataFrame(found.collect(), found.schema)


def compare(candidate: DataFrame, parent: DataFrame, spec: Mapping) -> DataFrame:
    """panel, metric, side, value, path of one candidate. Rows are scored rows (COLUMNS)."""
    return reports({"candidate": candidate}, parent, spec).drop("arm")


def values(report: DataFrame) -> dict[str, float | None]:
    """The long table by path: panels * metrics * sides rows."""
    return {r["path"]: r["value"] for r in report.collect()}


def _terms(report: DataFrame, terms: list[tuple[int, int, str]]) -> DataFrame:
    """arm, k, at: for each k of terms (k, place, path) its paths' values by place, an array in order of place; null where one is missing."""
    arms = report.select("arm").distinct()
    t = arms.crossJoin(report.sparkSession.createDataFrame(terms, "k int, place int, path string"))  # arms * terms, both few
    each = t.join(report.select("arm", "path", "value"), ["arm", "path"], "left").groupBy("arm", "k")
    each = each.agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("at"), F.count_if(F.col("value").isNull()).alias("gone"))
    return each.select("arm", "k", F.when(F.col("gone") == 0, F.transform("at", lambda x: x["value"])).alias("at"))


def criteria(report: DataFrame, spec: Mapping) -> DataFrame:
    """arm, k, holds: the left side (one path, or the first less the second) op the right side (a number or a path, and what is added to it), as the numbers are; null where a value is missing."""
    rows = spec.get("criteria") or []
    terms, rules = [], []
    for k, c in enumerate(rows):
        sides = c["left"] if isinstance(c["left"], list) else [c["left"]]
        terms += [(k, j, x) for j, x in enumerate(sides)]
        number = None if isinstance(c["right"], str) else float(c["right"])
        if number is None:
            terms.append((k, 2, c["right"]))
        rules.append((k, c["op"], len(sides), number, float(c["plus"]) if "plus" in c else None))
    found = _terms(report, terms).join(report.sparkSession.createDataFrame(rules, "k int, op string, sides int, number double, plus double"), "k")
    at = F.col("at")
    left = F.when(F.col("sides") == 2, at[0] - at[1]).otherwise(at[0])
    right = F.coalesce("number", F.get(at, F.col("sides")))
    right = F.when(F.col("plus").isNotNull(), right + F.col("plus")).otherwise(right)
    x = F.col("op")
    return found.select("arm", "k", F.when(x == ">", left > right).when(x == ">=", left >= right).when(x == "<", left < right).when(x == "<=", left <= right).alias("holds"))


def judged(report: DataFrame, spec: Mapping) -> DataFrame:
    """arm, size, passed, criteria, place, keys of a report with arm, path and value.

    The size of an arm is its name up to the first ``-``. Of each size, the arms that pass and may be selected (spec ``unselectable`` lists those that may not) are placed by the rank keys, ties by name; a key sums its paths left to right.
    """
    arms = report.select("arm").distinct()
    if spec.get("criteria"):
        each = criteria(report, spec).groupBy("arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "holds"))), lambda s: s["holds"]).alias("criteria"), F.count_if(F.col("holds").isNull()).alias("gone"), F.bool_and("holds").alias("all"))
        out = each.select("arm", F.when(F.col("gone") == 0, F.col("all")).alias("passed"), "criteria")
    else:
        out = arms.select("arm", F.lit(None).cast("boolean").alias("passed"), F.array().cast("array<boolean>").alias("criteria"))
    keys = spec.get("rank") or []
    if keys:
        paths = [r.get("by", r.get("path")) for r in keys]
        terms = [(k, j, x) for k, by in enumerate(paths) for j, x in enumerate(by if isinstance(by, list) else [by])]
        total = F.aggregate(F.slice("at", F.lit(2), F.size("at") - 1), F.get("at", F.lit(0)), lambda a, x: a + x)
        sums = _terms(report, terms).select("arm", "k", F.when(F.col("at").isNotNull(), total).alias("total"))
        sums = sums.groupBy("arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "total"))), lambda s: s["total"]).alias("keys"))
    else:
        sums = arms.select("arm", F.array().cast("array<double>").alias("keys"))
    order = [F.get("keys", F.lit(k)).asc_nulls_last() if r.get("order", "desc") == "asc" else F.get("keys", F.lit(k)).desc_nulls_last() for k, r in enumerate(keys)]
    may = F.coalesce("passed", F.lit(False)) & ~F.col("arm").isin(*spec.get("unselectable", ()))
    out = out.join(sums, "arm").withColumn("size", F.substring_index("arm", "-", 1)).withColumn("_may", may)
    place = F.row_number().over(W.partitionBy("size", "_may").orderBy(*order, "arm"))  # a row an arm
    return out.select("arm", "size", "passed", "criteria", F.when(F.col("_may"), place).alias("place"), "keys")


def read_out(candidates: Mapping[str, DataFrame], parent: DataFrame, spec: Mapping) -> DataFrame:
    """judged() of the reports of all arms; a spec with problems is refused with all of them."""
    if problems := analyse(spec):
        raise ValueError("; ".join(problems))
    return judged(reports(candidates, parent, spec), spec)


def confirm(arm: str, candidate: DataFrame, parent: DataFrame, spec: Mapping, stage: str) -> DataFrame:
    """judged() of one arm by the panels and criteria of a confirmation stage (spec["confirm"][stage])."""
    return read_out({arm: candidate}, parent, {"panels": {}, "criteria": [], "rank": [], "samples": spec.get("samples", SAMPLES)} | dict(spec["confirm"][stage]))


def table(report: DataFrame) -> DataFrame:
    """arm, line: a printed line for each interval of a report, rates in points of a hundred."""
    pick = lambda name: F.max(F.when(F.col("side") == name, F.col("value"))).alias(name)
    wide = report.where(F.col("metric").isin(*PAIRED) & F.col("side").isin("delta", "lower", "upper")).groupBy("arm", "panel", "metric").agg(pick("delta"), pick("lower"), pick("upper"))
    shown = lambda c: F.when(F.col("metric") == "acc", F.format_string("%+.1f", 100 * F.col(c))).otherwise(F.format_string("%+.3f", F.col(c)))
    return wide.select("arm", F.concat(F.col("panel"), F.lit("."), F.col("metric"), F.lit(" "), shown("delta"), F.lit(" ["), shown("lower"), F.lit(", "), shown("upper"), F.lit("]")).alias("line"))


def validated_context(buckets: DataFrame, margin: float, base: int = 8192) -> DataFrame:
    """context: the upper end of the longest unbroken chain of buckets (lo, hi, lower, complete) above base that are complete with lower >= margin; base itself where the first is not, or where base's own bucket is incomplete.

    lower is the lower end of the bucket's interval against base's on the same questions; a bucket without one is not within the margin. Buckets that are not there break the chain nowhere: give them with nulls.
    """
    good = F.coalesce((F.col("lower") >= margin) & F.col("complete"), F.lit(False))
    good = F.when(F.col("hi") <= base, F.coalesce("complete", F.lit(False))).otherwise(good)
    chain = F.bool_and(good).over(W.orderBy("lo").rowsBetween(W.unboundedPreceding, 0))  # a row a bucket
    return buckets.withColumn("ok", chain).agg(F.greatest(F.coalesce(F.max(F.when(F.col("ok"), F.col("hi"))), F.lit(base)), F.lit(base)).cast("long").alias("context"))


def closure(parts: DataFrame, most: int = 50) -> DataFrame:
    """suite, component: everything that a suite holds, through components of components."""
    out = parts.select("suite", "component").distinct()
    for _ in range(most):  # suites are few, and nest a few deep
        more = out.join(parts.select(F.col("suite").alias("component"), F.col("component").alias("next")), "component").select("suite", F.col("next").alias("component")).join(out, ["suite", "component"], "left_anti").distinct()
        now = out.union(more)
        if not more.limit(1).count():
            return out
        out = now
    raise ValueError("components go round in a circle or too deep")
