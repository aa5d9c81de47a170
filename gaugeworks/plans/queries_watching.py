"""Queries over logs of trials made of events, and over orders as items whose lines arrive day by day."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.operators import watching
from gaugeworks.plans.registry import query

MOST, ALLOWED = 3, 3


def trial_log(spark, sf):
    """A user's events as the polls of seven trials: trial, seq, kind; the first event of a trial is a call."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = F.col("event_id")
    seq = F.row_number().over(W.partitionBy("trial").orderBy("ts", "event_id"))
    e = e.select(F.concat_ws("-", F.col("user_id").cast("string"), (n % 7).cast("string")).alias("trial"), "event_id", "ts").withColumn("seq", seq.cast("long"))
    kinds = ((7, "network"), (5, "network"), (31, "done"), (29, "timeout"), (23, "refused"), (19, "error"), (17, "call"), (13, "pending"), (3, "network"))
    kind = F.when((F.col("seq") == 1) & (n % 11 != 0), "call")
    for k, name in kinds:
        kind = kind.when((n + F.col("seq")) % k == 0, name)
    return e.select("trial", "seq", kind.otherwise("running").alias("kind"))


LOG = "log AS (SELECT trial, seq, CASE WHEN seq = 1 AND event_id % 11 <> 0 THEN 'call' " + " ".join(f"WHEN (event_id + seq) % {k} = 0 THEN '{name}'" for k, name in ((7, "network"), (5, "network"), (31, "done"), (29, "timeout"), (23, "refused"), (19, "error"), (17, "call"), (13, "pending"), (3, "network"))) + " ELSE 'running' END AS kind FROM (SELECT user_id || '-' || (event_id % 7) AS trial, event_id, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY ts, event_id) AS seq FROM events))"
#: The rules once more, as a fold over each trial's list of events.
FOLD = f"""fold AS (SELECT trial, list_reduce(list({{'calls': 0, 'transient': 0, 'ended': '', 'told': '', 'kind': kind}} ORDER BY seq), lambda s, x: CASE
 WHEN s.ended = 'done' THEN s
 WHEN x.kind = 'call' THEN {{'calls': s.calls + 1, 'transient': 0, 'ended': '', 'told': s.told, 'kind': ''}}
 WHEN s.calls = 0 THEN s
 WHEN s.ended = 'waiting' AND x.kind = 'network' AND s.transient + 1 >= {MOST} THEN {{'calls': s.calls, 'transient': s.transient + 1, 'ended': 'failed', 'told': s.told || ' give_up ' || s.calls, 'kind': ''}}
 WHEN s.ended = 'waiting' AND x.kind = 'network' THEN {{'calls': s.calls, 'transient': s.transient + 1, 'ended': s.ended, 'told': s.told, 'kind': ''}}
 WHEN s.ended <> '' THEN s
 WHEN x.kind = 'done' THEN {{'calls': s.calls, 'transient': 0, 'ended': 'done', 'told': s.told || ' launch ' || s.calls, 'kind': ''}}
 WHEN x.kind IN ('timeout', 'refused', 'pending') AND s.calls < {ALLOWED} THEN {{'calls': s.calls, 'transient': 0, 'ended': 'waiting', 'told': s.told || ' continue ' || (s.calls + 1), 'kind': ''}}
 WHEN x.kind IN ('timeout', 'refused', 'pending', 'error') THEN {{'calls': s.calls, 'transient': 0, 'ended': 'failed', 'told': s.told || ' give_up ' || s.calls, 'kind': ''}}
 WHEN x.kind = 'network' AND s.transient + 1 >= {MOST} THEN {{'calls': s.calls, 'transient': s.transient + 1, 'ended': 'failed', 'told': s.told || ' give_up ' || s.calls, 'kind': ''}}
 WHEN x.kind = 'network' THEN {{'calls': s.calls, 'transient': s.transient + 1, 'ended': '', 'told': s.told, 'kind': ''}}
 ELSE {{'calls': s.calls, 'transient': 0, 'ended': '', 'told': s.told, 'kind': ''}} END,
 {{'calls': 0, 'transient': 0, 'ended': '', 'told': '', 'kind': ''}}) AS s FROM log GROUP BY trial)"""


@query("e02_watch", f"WITH {LOG}, {FOLD} SELECT trial, CASE WHEN s.ended = '' THEN 'running' ELSE s.ended END AS status, s.calls AS attempts, s.transient AS transient FROM fold WHERE s.calls > 0")
def watch(spark, sf):
    """Where every trial of the log stands."""
    return watching.settled(trial_log(spark, sf), MOST, ALLOWED)


def told(attempts):
    """trial, told: all decisions of a trial in order, as `` action number``; a waiting attempt that failed in the end told of its continuation before."""
    first = F.when((F.col("action") == "give_up") & (F.col("waited")), F.concat(F.lit(" continue "), (F.col("attempt") + 1).cast("string"))).otherwise("")
    said = F.when(F.col("action").isNotNull(), F.concat(first, F.lit(" "), F.col("action"), F.lit(" "), F.col("number").cast("string"))).otherwise("")
    return attempts.groupBy("trial").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt", said.alias("said")))), lambda x: x["said"]), "").alias("told"))


@query("e02_watch_decisions", f"WITH {LOG}, {FOLD} SELECT trial, s.told AS told FROM fold WHERE s.calls > 0")
def decisions(spark, sf):
    """What was decided for every trial, in order."""
    return told(watching.attempts(trial_log(spark, sf), MOST, ALLOWED))


NOW = "2024-02-01 00:00:00"
GRACE = 5 * 86400


@query(
    "e02_effects_due",
    f"""WITH c AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS trial, 'launch' AS action, CAST(event_id % 20 AS INTEGER) AS number FROM events),
i AS (SELECT CAST(user_id AS VARCHAR) AS trial, CAST(event_id % 20 AS INTEGER) AS number, epoch(ts) AS sec, event_type AS t, event_id FROM events),
x AS (SELECT c.trial, c.action, c.number, count(*) FILTER (t = 'click') AS tries, max(sec) FILTER (t = 'click') AS began, max(sec) FILTER (t = 'view') AS ended, count(*) FILTER (t = 'view' AND event_id % 3 = 0) AS ok,
 count(*) FILTER (t = 'view' AND event_id % 3 = 1) AS unmapped, count(*) FILTER (t = 'signup' AND event_id % 4 = 0) AS landed FROM c JOIN i USING (trial, number) GROUP BY ALL)
SELECT trial, action, number, CASE WHEN landed > 0 THEN 'landed' WHEN ok > 0 THEN 'done' WHEN unmapped > 0 THEN 'unmapped' WHEN began > coalesce(ended, 0) AND epoch(TIMESTAMP '{NOW}') - began < {GRACE} THEN 'in_flight' ELSE 'due' END AS state, tries FROM x""",
)
def effects_due(spark, sf):
    """Clicks are intents, views outcomes, signups what landed: the state of the effect of each (user, number)."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.select(F.col("user_id").cast("string").alias("trial"), F.lit("launch").alias("action"), (F.col("event_id") % 20).cast("int").alias("number"), F.col("ts").cast("timestamp").cast("double").alias("at"), "event_type", "event_id")
    result = F.get(F.array(F.lit("ok"), F.lit("unmapped"), F.lit("failed")), (F.col("event_id") % 3).cast("int"))
    of = lambda t: e.where(F.col("event_type") == t)
    return watching.effects(e, of("click"), of("view").withColumn("result", result), of("signup").where("event_id % 4 = 0"), F.lit(NOW).cast("timestamp"), GRACE)


@query(
    "e08_next_attempts",
    f"""WITH e AS (SELECT user_id || '-' || (event_id % 40) AS trial, event_id, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts, event_id) AS number, count(*) OVER (PARTITION BY user_id, event_id % 40) AS n FROM events),
g AS (SELECT trial, number, event_id, sec, CASE WHEN event_id % 3 > 0 THEN event_id END AS call, event_id % 5 = 0 AND event_id % 3 = 0 AS given_up FROM e),
l AS (SELECT trial, event_id AS nonce, sec + event_id % 7 * 3600 AS beat, event_id % 6 = 3 AS past FROM e WHERE number = greatest(1, n - event_id % 2) AND event_id % 4 <> 1),
j AS (SELECT g.*, l.beat, l.past, coalesce(call IS NULL AND nonce = event_id, false) AS adopted, coalesce(NOT past AND epoch(TIMESTAMP '{NOW}') - beat < {GRACE}, false) AS fresh, nonce FROM g LEFT JOIN l USING (trial)),
k AS (SELECT *, coalesce(call, CASE WHEN adopted THEN nonce + 1000000 END) AS own FROM j),
t AS (SELECT trial, count(*) AS used, count(*) FILTER (adopted) AS adopted, arg_max(coalesce(own, -1), number) AS own, arg_max(given_up AND NOT adopted, number) AS given_up, max(sec) AS sec, bool_or(fresh) AS fresh, max(own) FILTER (adopted AND fresh) AS live FROM k GROUP BY trial)
SELECT trial, CASE WHEN own = -1 AND NOT given_up AND epoch(TIMESTAMP '{NOW}') - sec < {GRACE} THEN 'pending' WHEN used >= 4 THEN 'no attempt left' WHEN coalesce(live, own) > -1 AND coalesce(live, own) % 5 > 1 THEN 'not ended' WHEN fresh THEN 'lease' ELSE 'spawn' END AS decision, used, adopted FROM t""",
)
def next_attempts(spark, sf):
    """Events as attempts of trials (a third without a recorded call), some of which hold a lease; calls whose number is 0 or 1 modulo 5 timed out or were refused."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    by = W.partitionBy("trial")
    e = e.select(F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 40).cast("string")).alias("trial"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    e = e.withColumn("number", F.row_number().over(by.orderBy("at", "event_id"))).withColumn("n", F.count("*").over(by))
    third = F.col("event_id") % 3
    ledger = e.select("trial", "number", F.col("event_id").alias("nonce"), F.when(third > 0, F.col("event_id")).alias("call"), "at", F.when((third == 0) & (F.col("event_id") % 5 == 0), F.col("at")).alias("abandoned"))
    held = e.where((F.col("number") == F.greatest(F.lit(1), F.col("n") - F.col("event_id") % 2)) & (F.col("event_id") % 4 != 1))
    leases = held.select("trial", F.col("event_id").alias("nonce"), (F.col("event_id") + 1_000_000).alias("call"), (F.col("at").cast("double") + F.col("event_id") % 7 * 3600).alias("heartbeat"), (F.col("event_id") % 6 == 3).alias("ended"))
    call = F.explode(F.array(F.col("event_id"), F.col("event_id") + 1_000_000))
    polls = e.select("trial", call.alias("call")).withColumn("status", F.when(F.col("call") % 5 == 0, "timeout").when(F.col("call") % 5 == 1, "refused").otherwise("running"))
    return watching.next_attempts(ledger, leases, polls, F.lit(NOW).cast("timestamp"), 4, GRACE)


@query("e04_newly_complete", "WITH o AS (SELECT l_orderkey, max(day) AS whole FROM (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS day FROM lineitem GROUP BY ALL) GROUP BY l_orderkey) SELECT CAST(l_orderkey AS VARCHAR) AS item, CAST(0 AS BIGINT) AS version FROM o WHERE CAST(whole AS DATE) >= DATE '1995-01-01' AND CAST(whole AS DATE) < DATE '1995-07-01'")
def newly_complete(spark, sf):
    """Orders as items whose lines arrive on their ship dates: what became whole in half a year, when all that was whole before is committed."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("item"), F.lit(0).cast("long").alias("version"), F.col("l_linenumber").alias("part"), F.col("l_shipdate").cast("date").alias("day"))
    parts = lines.groupBy("item").agg(F.count_distinct("part").alias("parts"))
    files = lines.join(parts, "item")
    return watching.newly_complete(files.where("day < '1995-07-01'"), watching.complete(files.where("day < '1995-01-01'")))
