"""Watching spawned trials: what a log of polls comes to, which effects are due, which attempt may be spawned next, what is newly complete.

Everything here is a batch plan; ``gaugeworks.streaming.watch`` keeps the same rules as state of a stream.

A trial's log has, in order of seq, ``call`` (an attempt was recorded) and what polls of the current call gave: ``running``, ``network`` (this side's failure), ``done``, ``timeout``,
``refused`` and ``pending`` (ended without a result, another attempt is needed), ``error`` (the trial's own failure). From the next call on a trial that is not done is polled anew. What precedes the first call is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENDED = ("timeout", "refused", "pending")
POLLS = ("running", "network", "done", "error", *ENDED)
#: Network failures in a row that make a trial fail; attempts of a trial; seconds in which a started effect may still be running; seconds after which a lease counts as left.
MOST_TRANSIENT, ALLOWED, GRACE, STALE = 60, 3, 3600, 900


def attempts(log: DataFrame, most_transient: int = MOST_TRANSIENT, allowed: int = ALLOWED) -> DataFrame:
    """trial, attempt, outcome, transient, action, number, at, waited: what each attempt of a trial came to, up to the first that is done.

    outcome is running, done, failed, waiting (its end asks for another attempt) or replaced (waiting, and another attempt came). action is launch, continue or give_up (null while it runs), for the attempt number (of continue the next one), at the
    seq of the event that decided it. A waiting trial whose continuation fails most_transient times by the network fails too (waited says that it had waited).
    """
    own = W.partitionBy("trial").orderBy("seq")
    log = log.withColumn("attempt", F.sum((F.col("kind") == "call").cast("int")).over(own)).where("attempt > 0")
    polls = log.where(F.col("kind").isin(*POLLS))
    by = W.partitionBy("trial", "attempt").orderBy("seq")
    network = (F.col("kind") == "network").cast("int")
    polls = polls.withColumn("_island", F.sum(1 - network).over(by)).withColumn("_run", F.sum(network).over(W.partitionBy("trial", "attempt", "_island").orderBy("seq")))
    ends = F.col("kind").isin("done", "error", *ENDED) | (F.col("_run") >= most_transient)
    polls = polls.withColumn("_end", F.min(F.when(ends, F.struct("seq", "kind"))).over(W.partitionBy("trial", "attempt")))
    # of a waiting attempt, network failures go on counting, from none
    after = F.sum(F.when(F.col("seq") > F.col("_end.seq"), network).otherwise(0)).over(by)
    polls = polls.withColumn("_after", after)
    ended = F.col("_end.kind").isin(*ENDED)
    each = polls.groupBy("trial", "attempt").agg(
        F.first("_end").alias("end"), F.max("_after").alias("after"), F.max_by("_run", "seq").alias("run"),
        F.min(F.when(ended & (F.col("_after") >= most_transient), F.col("seq"))).alias("gone"),
    )
    # an attempt without any poll is there too
    each = log.groupBy("trial", "attempt").agg(F.min("seq").alias("first")).join(each, ["trial", "attempt"], "left")
    last = F.max("attempt").over(W.partitionBy("trial"))
    done = F.min(F.when(F.col("end.kind") == "done", F.col("attempt"))).over(W.partitionBy("trial"))
    each = each.withColumn("last", last).withColumn("done", done).where(F.col("done").isNull() | (F.col("attempt") <= F.col("done")))
    waits, left = F.col("end.kind").isin(*ENDED), F.col("attempt") < allowed
    lost = waits & left & F.col("gone").isNotNull()
    outcome = (
        F.when(F.col("end").isNull(), F.when(F.col("attempt") < F.col("last"), "replaced").otherwise("running"))
        .when(F.col("end.kind") == "done", "done").when(~waits | ~left | lost, "failed").when(F.col("attempt") < F.least("last", F.coalesce("done", "last")), "replaced").otherwise("waiting")
    )
    action = F.when(F.col("end.kind") == "done", "launch").when(waits & left & ~lost, "continue").when(F.col("end").isNotNull(), "give_up")
    transient = F.when(F.col("end").isNull(), F.coalesce("run", F.lit(0))).when(waits & left, F.least("after", F.lit(most_transient))).when(F.col("end.kind") == "network", F.lit(most_transient)).otherwise(0)
    return each.select("trial", F.col("attempt").cast("int"), outcome.alias("outcome"), transient.cast("int").alias("transient"), action.alias("action"), (F.col("attempt") + F.when(action == "continue", 1).otherwise(0)).cast("int").alias("number"), F.when(lost, F.col("gone")).otherwise(F.col("end.seq")).alias("at"), F.coalesce(waits & left, F.lit(False)).alias("waited"))


def settled(log: DataFrame, most_transient: int = MOST_TRANSIENT, allowed: int = ALLOWED) -> DataFrame:
    """trial, status, attempts, transient: where every trial stands."""
    each = attempts(log, most_transient, allowed)
    return each.groupBy("trial").agg(F.max_by(F.struct("outcome", "transient"), "attempt").alias("s"), F.max("attempt").alias("attempts")).select("trial", F.col("s.outcome").alias("status"), "attempts", F.col("s.transient").alias("transient"))


KEY = ("trial", "action", "number")


def effects(commands: DataFrame, intents: DataFrame, outcomes: DataFrame, landed: DataFrame, now: Column, grace: int = GRACE) -> DataFrame:
    """KEY, state, tries of every command (KEY): landed, done, unmapped, in_flight or due.

    An intent (KEY, at) is written before an effect starts, an outcome (KEY, at, result: ok, unmapped or failed) when it has ended. An intent without a later outcome may still be running while it is younger than
    grace; then, and after a failed outcome, the effect is due again. What landed (KEY) is never started again, nor what was ok or has nothing to launch (unmapped).
    """
    asked = commands.select(*KEY).distinct()
    began = intents.groupBy(*KEY).agg(F.max("at").alias("began"), F.count("*").alias("tries"))
    ended = outcomes.groupBy(*KEY).agg(F.max("at").alias("ended"), F.bool_or(F.col("result") == "ok").alias("ok"), F.bool_or(F.col("result") == "unmapped").alias("unmapped"))
    there = landed.select(*KEY).distinct().withColumn("landed", F.lit(True))
    every = asked.join(began, list(KEY), "left").join(ended, list(KEY), "left").join(there, list(KEY), "left")
    running = F.col("began").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("began"))) & (now.cast("double") - F.col("began").cast("double") < grace)
    state = F.when(F.col("landed"), "landed").when(F.col("ok"), "done").when(F.col("unmapped"), "unmapped").when(running, "in_flight").otherwise("due")
    return every.select(*KEY, state.alias("state"), F.coalesce("tries", F.lit(0)).alias("tries"))


def next_attempts(ledger: DataFrame, leases: DataFrame, polls: DataFrame, now: Column, allowed: int = ALLOWED, stale: int = STALE) -> DataFrame:
    """trial, decision, used, adopted: whether the next attempt of each trial may be spawned.

    ledger (trial, number, nonce, call, at, abandoned: when given up, or null): an entry a spawned attempt; call is null where none was recorded. leases (trial, nonce, call, heartbeat, ended): the claim of a trial's container, at most one a trial.
    polls (trial, call, status): a call may be polled more than once, and has ended if one of its polls says so. In this order:

    * an entry without a call whose nonce the lease carries is adopted: its call is the lease's (``adopted`` says how many of a trial are);
    * ``pending``: the last entry has no call and is younger than stale, so it may still start; an older one counts as abandoned;
    * ``no attempt left``: every entry counts, abandoned ones too;
    * ``not ended``: the last call is neither timeout nor refused;
    * ``lease``: a fresh lease; else ``spawn``.
    """
    lease = leases.select("trial", F.col("nonce").alias("_nonce"), F.col("call").alias("_call"), "heartbeat", "ended")
    seconds = lambda c: now.cast("double") - F.col(c).cast("double")
    both = ledger.join(lease, "trial", "left")
    adopted = F.col("call").isNull() & F.col("nonce").eqNullSafe(F.col("_nonce")) & F.col("_nonce").isNotNull()
    both = both.withColumn("adopted", adopted).withColumn("call", F.coalesce("call", F.when(adopted, F.col("_call")))).withColumn("abandoned", F.when(~adopted, F.col("abandoned")))
    fresh = F.col("heartbeat").isNotNull() & ~F.coalesce("ended", F.lit(False)) & (seconds("heartbeat") < stale)
    # the current call is the last entry's, or that of an earlier one which was adopted while its lease is fresh
    one = both.groupBy("trial").agg(
        F.max_by(F.struct("call", "at", "abandoned"), "number").alias("last"), F.count("*").alias("used"), F.count_if("adopted").alias("adopted"), F.bool_or(fresh).alias("fresh"),
        F.max(F.when(F.col("adopted") & fresh, F.col("call"))).alias("live"),
    )
    one = one.withColumn("call", F.coalesce("live", "last.call"))
    over = polls.groupBy("trial", "call").agg(F.bool_or(F.coalesce(F.col("status").isin("timeout", "refused"), F.lit(False))).alias("over"))
    one = one.join(over, ["trial", "call"], "left")
    waits = F.col("last.call").isNull() & F.col("last.abandoned").isNull() & (seconds("last.at") < stale)
    decision = (
        F.when(waits, "pending").when(F.col("used") >= allowed, "no attempt left")
        .when(F.col("call").isNotNull() & ~F.coalesce("over", F.lit(False)), "not ended").when(F.col("fresh"), "lease").otherwise("spawn")
    )
    return one.select("trial", decision.alias("decision"), "used", "adopted")


def complete(files: DataFrame) -> DataFrame:
    """item, version of all that is whole: files (item, version, part, parts), each part seen at least once; a part may be listed again."""
    seen = files.groupBy("item", "version").agg(F.count_distinct("part").alias("n"), F.max("parts").alias("parts"))
    return seen.where(F.col("n") >= F.col("parts")).select("item", "version")


def newly_complete(files: DataFrame, committed: DataFrame) -> DataFrame:
    """complete() less what was committed (item, version)."""
    return complete(files).join(committed.select("item", "version"), ["item", "version"], "left_anti")
