"""Queries over events, conversations, orders: replay, leases, caps, turns, rules, dates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.functions import text as T
from gaugeworks.operators import logic, traces
from gaugeworks.plans.registry import query


def event_log(spark, sf):
    """events as the log of a recursive probe: a user's events in order; types and rounds from the event's number."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.select(F.col("user_id").cast("string").alias("id"), seq.cast("long").alias("seq"), "event_id")
    kind = F.when(F.col("event_id") % 97 == 0, "malformed").when(F.col("event_id") % 41 == 0, "final").when(F.col("seq") % 2 == 1, "ask").otherwise("resolved")
    round_ = F.floor((F.col("seq") + 1) / 2).cast("int") + F.when((F.col("event_id") % 13 == 0) & (F.col("seq") % 2 == 0), 1).otherwise(0)
    return e.select("id", "seq", kind.alias("type"), round_.alias("round"), (F.col("event_id") % 50).alias("n_tokens"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.get(F.array(*map(F.lit, "ABC")), (F.col("event_id") % 3).cast("int")).alias("chosen_key"))


LOG = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id FROM events),
l AS (SELECT id, seq, CASE WHEN event_id % 97 = 0 THEN 'malformed' WHEN event_id % 41 = 0 THEN 'final' WHEN seq % 2 = 1 THEN 'ask' ELSE 'resolved' END AS type, CAST((seq + 1) // 2 + CASE WHEN event_id % 13 = 0 AND seq % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS round, event_id % 50 AS n_tokens, 'v' || event_id AS value, ['A', 'B', 'C'][1 + event_id % 3] AS chosen_key FROM e),
stop AS (SELECT id, min(seq) AS stop FROM l WHERE type IN ('final', 'malformed') GROUP BY id),
live AS (SELECT l.*, sum(CAST(type = 'ask' AS INT)) OVER (PARTITION BY l.id ORDER BY seq) AS turn FROM l LEFT JOIN stop USING (id) WHERE stop IS NULL OR seq <= stop),
asks AS (SELECT id, turn, round AS asked FROM live WHERE type = 'ask'),
ans AS (SELECT live.id, live.turn, arg_min(value, seq) AS value, arg_min(chosen_key, seq) AS k, min(seq) AS seq FROM live JOIN asks ON live.id = asks.id AND live.turn = asks.turn WHERE type = 'resolved' AND round = asked GROUP BY ALL),
a2 AS (SELECT id, arg_max(value, turn) AS last, string_agg(k, '' ORDER BY turn) AS picks FROM ans GROUP BY id),
g AS (SELECT id, arg_max(type, seq) FILTER (type <> 'resolved') AS en, coalesce(arg_max(round, seq) FILTER (type <> 'resolved'), 0) AS round, CAST(count(*) FILTER (type <> 'resolved') AS INTEGER) AS calls, CAST(coalesce(sum(n_tokens) FILTER (type <> 'resolved'), 0) AS BIGINT) AS tokens, max(CASE WHEN type = 'final' THEN value END) AS final FROM live GROUP BY id),
s AS (SELECT g.*, regexp_extract_all(regexp_replace(last, '[$%,]', '', 'g'), '-?[0-9]+(?:\\.[0-9]+)?')[-1] AS number, coalesce(picks, '') AS picks, CASE WHEN en IN ('final', 'malformed') THEN en WHEN round >= 5 THEN 'exhausted' ELSE 'active' END AS status FROM g LEFT JOIN a2 USING (id))
SELECT id, status, round, calls, tokens, CASE status WHEN 'final' THEN final WHEN 'active' THEN NULL ELSE number END AS value, picks FROM s"""


@query("e01_replay_declared", LOG)
def replay_declared(spark, sf):
    return traces.replay_declared(event_log(spark, sf))


@query("a44_arm_summary", LOG.replace("SELECT id, status, round,", ", t AS (SELECT id, status, round,") + ") SELECT status, count(*) AS n, round(avg(calls), 6) AS calls, round(avg(tokens), 6) AS tokens, count(*) FILTER (replace(picks, 'A', '') <> '') AS divergent FROM t GROUP BY status")
def arm_summary(spark, sf):
    s = traces.replay_declared(event_log(spark, sf))
    return s.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("calls"), 6).alias("calls"), F.round(F.avg("tokens"), 6).alias("tokens"), F.count_if(F.replace("picks", F.lit("A"), F.lit("")) != "").alias("divergent"))


@query("e03_lease_states", "SELECT CASE WHEN beat IS NULL THEN 'none' WHEN done THEN 'ended' WHEN epoch(now) - epoch(beat) < 86400 THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n FROM (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS beat, user_id % 5 = 0 AS done FROM events GROUP BY user_id), (SELECT max(ts) AS now FROM events) GROUP BY ALL")
def lease_states(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    now = e.agg(F.max("ts")).first()[0]
    beats = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).cast("timestamp").alias("beat"))
    return beats.groupBy(traces.lease_state(F.col("beat"), F.col("user_id") % 5 == 0, F.lit(now).cast("timestamp"), 86400).alias("state")).agg(F.count("*").alias("n"))


@query("e07_spend_cap", "WITH r AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER w AS spent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)) SELECT o_custkey, count(*) AS n, round(max(spent), 2) AS spent FROM r WHERE spent <= 500000 GROUP BY o_custkey")
def spend_cap(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return traces.within_cap(o, 500000.0, ["o_custkey"], ["o_orderkey"], "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.max("spent"), 2).alias("spent"))


@query("w3_previous_turn", "WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_type, CASE WHEN before IS NULL THEN 'none' WHEN before = event_type THEN 'same' ELSE 'changed' END AS stratum, count(*) AS n FROM t GROUP BY ALL")
def previous_turn(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("o", F.struct("ts", "event_id"))
    return traces.previous_stratum(e, ["user_id"], "o", "event_type").groupBy("event_type", "stratum").agg(F.count("*").alias("n"))


@query("j06_left_points", "WITH t AS (SELECT conv_id, max(length(text)) AS n, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, length(text) AS m FROM conversations WHERE role = 'user' AND turn > 0) SELECT source, count(*) AS n, round(avg(coalesce(k, 0)), 6) AS points, round(avg(coalesce(s, 0) / greatest(n, 1)), 6) AS share FROM t LEFT JOIN (SELECT conv_id, count(*) AS k, sum(m) AS s FROM p GROUP BY conv_id) USING (conv_id) GROUP BY source")
def left_points(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    t = c.groupBy(F.col("conv_id").alias("id")).agg(F.greatest(F.max(F.length("text")), F.lit(1)).alias("n_thinking_tokens")).withColumn("source", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    p = c.where("role = 'user' and turn > 0").select(F.col("conv_id").alias("id"), F.length("text").alias("n_tokens"))
    got = traces.replaceable_share(p, t)
    return got.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_points"), 6).alias("points"), F.round(F.avg("share"), 6).alias("share"))


@query("j07_full_outer_counts", "WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id FROM labels) SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS matched, count(*) FILTER (b.doc_id IS NULL) AS only_a, count(*) FILTER (a.doc_id IS NULL) AS only_b FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def full_outer_counts(spark, sf):
    a = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 <> 0").select("doc_id", F.lit(True).alias("a"))
    b = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.lit(True).alias("b"))
    return a.join(b, "doc_id", "full_outer").agg(F.count_if(F.col("a") & F.col("b")).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


@query("j09_universe", "WITH n AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 10) SELECT 'joined' AS what, count(*) AS n FROM n JOIN c USING (id) JOIN b USING (id) UNION ALL SELECT 'not in c', count(*) FROM n WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT 'not in b', count(*) FROM n WHERE id NOT IN (SELECT id FROM b)")
def universe(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    n, c = o.where("id % 3 <> 0"), o.where("id % 5 <> 0")
    b = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 10").select(F.col("l_orderkey").alias("id")).distinct()
    tell = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return tell("joined", n.join(c, "id").join(b, "id")).union(tell("not in c", n.join(c, "id", "left_anti"))).union(tell("not in b", n.join(b, "id", "left_anti")))


@query("j17_resume", "SELECT count(*) AS n, sum(o_orderkey) AS ids FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P')")
def resume(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    done = o.where("id % 3 = 0").withColumn("status", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok"))
    return traces.resume(o.select("id"), done).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("j24_first_of_duplicates", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) AS z FROM lineitem) SELECT count(*) AS n, count(*) FILTER (round(f.l_quantity, 1) = round(g.l_quantity, 1)) AS same FROM x f JOIN x g ON f.l_orderkey = g.l_orderkey AND f.a = 1 AND g.z = 1")
def first_of_duplicates(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = l.groupBy("l_orderkey").agg(F.min_by("l_quantity", F.struct("l_linenumber", "l_extendedprice")).alias("f"), F.max_by("l_quantity", F.struct("l_linenumber", "l_extendedprice")).alias("g"))
    return got.agg(F.count("*").alias("n"), F.count_if(F.round("f", 1) == F.round("g", 1)).alias("same"))


RULE = ("if", ("and", "cheap", ("not", "late")), ("or", "bulk", "cheap"), ("unless", "bulk", "late"))


@query("l01_three_valued_rule", "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice < 30000 END AS cheap, l_quantity >= 25 AS bulk, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_shipdate > l_commitdate END AS late FROM (SELECT l.*, o_orderdate + INTERVAL 45 DAY AS l_commitdate FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)), y AS (SELECT cheap AND NOT late AS c, bulk OR cheap AS a, bulk AND NOT late AS b FROM x) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN c THEN a WHEN NOT c THEN b WHEN a IS NOT DISTINCT FROM b THEN a END AS verdict FROM y) GROUP BY verdict")
def three_valued_rule(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    atoms = {"cheap": F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice") < 30000), "bulk": logic.atom("ge", F.col("l_quantity"), 25), "late": F.when(F.col("l_linenumber") != 2, F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 45 day"))}
    return l.groupBy(logic.rule(RULE, atoms).alias("verdict")).agg(F.count("*").alias("n"))


@query("l24_business_days", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), w AS (SELECT day, (SELECT CAST(d AS DATE) FROM (SELECT unnest(generate_series(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY, CAST(day AS TIMESTAMP) + INTERVAL 18 DAY, INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '1995-12-25') ORDER BY d OFFSET 4 LIMIT 1) AS due FROM d) SELECT o_orderkey, due, CAST(date_diff('month', CAST(o_orderdate AS DATE), DATE '1998-08-15') - CASE WHEN 15 < day(o_orderdate) THEN 1 ELSE 0 END AS INTEGER) AS months FROM orders LEFT JOIN w ON w.day = CAST(o_orderdate AS DATE)")
def business_days(spark, sf):
    """Over every order; its SQL finds due dates of distinct days."""
    day = F.col("o_orderdate").cast("date")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", logic.business_day_after(day, 5, ["1995-12-25"]).alias("due"), logic.whole_months(day, F.lit("1998-08-15").cast("date")).cast("int").alias("months"))


@query("l25_exact_rates", "SELECT p_partkey, CAST(floor(x * 1000 + 0.5) AS BIGINT) AS mille, round(x * 0.9 / (x * 0.9 + (1 - x) * 0.05), 6) AS ppv FROM (SELECT p_partkey, (p_partkey % 997) / 997.0::DOUBLE AS x FROM part)")
def exact_rates(spark, sf):
    x = (F.col("p_partkey") % 997) / F.lit(997.0)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", logic.per_mille(x).alias("mille"), F.round(logic.posterior(x, F.lit(0.9), F.lit(0.05)), 6).alias("ppv"))


@query("l26_best_option", "WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS option, l_quantity >= 10 AS ok, l_extendedprice / l_quantity AS unit, l_quantity FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY ok DESC, round(unit), l_quantity DESC) AS r FROM x) SELECT l_orderkey, CASE WHEN NOT max(ok) THEN 'none_qualifies' WHEN count(*) = 1 THEN min(option) END AS best FROM r WHERE r = 1 GROUP BY l_orderkey")
def best_option(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("option", F.col("l_linenumber").cast("string"))
    return logic.best_option(x, ["l_orderkey"], F.col("l_quantity") >= 10, [F.round(F.col("l_extendedprice") / F.col("l_quantity")), F.desc("l_quantity")])


@query("l27_policy", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 300000 THEN 'too large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_custkey % 7 = 0 THEN 'blocked' END], lambda x: x IS NOT NULL), ',') AS reasons, CAST(greatest(0, least(floor((CAST(round(o_totalprice * 100) AS BIGINT) * 15 + 50) / 100), 2000000) - 2500) AS BIGINT) AS payout FROM orders")
def policy(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.select("o_orderkey", F.array_join(logic.reasons(**{"too large": F.col("o_totalprice") > 300000, "pending": F.col("o_orderstatus") == "P", "blocked": F.col("o_custkey") % 7 == 0}), ",").alias("reasons"), logic.payout(cents, F.lit(2500), F.lit(2000000), F.lit(15)).cast("long").alias("payout"))


#: Subjects for the commit classes: a head and an object by the document's number, then its first characters.
HEADS = ("Fix", "feat(core):", "Add", "docs:", "Remove", "update", "Tweak", "revert", "Test", "chore:", "Add more", "perf!:", "Document", "  'adds", "resolve(x)!:", "Bump the", "frobnicate", "7 fixes")
OBJECTS = ("unit tests", "the README", "parser", "a new spec", "missing docstrings", "coverage", "and", "")


def commit_sql() -> str:
    classes = " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN '{kind}'" for kind, words in T.COMMIT_WORDS.items())
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    return f"""WITH s AS (SELECT doc_id, lower(trim(([{quoted(HEADS)}])[1 + doc_id % {len(HEADS)}] || ' ' || ([{quoted(OBJECTS)}])[1 + doc_id // 7 % {len(OBJECTS)}] || ' ' || coalesce(left(text, 20), ''), ' ')) AS s FROM documents),
p AS (SELECT *, regexp_extract(s, '^([a-z]+)(\\([^)]*\\))?!?:', 1) AS head FROM s),
q AS (SELECT *, CASE WHEN head <> '' THEN head WHEN regexp_matches(s, '^["''`]?[a-z]') THEN regexp_extract_all(s, '[a-z]+')[1] END AS w, CASE WHEN head <> '' THEN regexp_extract_all(regexp_replace(s, '^([a-z]+)(\\([^)]*\\))?!?:\\s*', ''), '[a-z]+') ELSE regexp_extract_all(s, '[a-z]+')[2:] END AS rest FROM p),
r AS (SELECT *, CASE {classes} END AS cls, list_filter(rest, lambda x: x NOT IN ({quoted(T.OBJECT_SKIP)}))[1] AS obj FROM q)
SELECT doc_id, CASE WHEN cls IN ('feature', 'change') AND obj IN ({quoted(T.TEST_OBJECTS)}) THEN 'test' WHEN cls IN ('feature', 'change') AND obj IN ({quoted(T.DOC_OBJECTS)}) THEN 'docs' ELSE cls END AS kind FROM r"""


@query("l11_commit_types", commit_sql())
def commit_types(spark, sf):
    some = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    subject = F.concat_ws(" ", some(HEADS, F.col("doc_id")), some(OBJECTS, F.floor(F.col("doc_id") / 7)), F.coalesce(F.left("text", F.lit(20)), F.lit("")))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.commit_type(subject).alias("kind"))
