"""Reasoning traces and event logs: marked calls, replay of a state machine, leases, spend caps, token accounts."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROUNDS = 5


NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def last_number(text: str | None) -> str | None:
    """The last number of a text, as it stands but for $, % and commas."""
    found = re.findall(NUMBER, re.sub("[$%,]", "", text or ""))
    return found[-1] if found else None


def replay(events: Iterable[dict], rounds: int = ROUNDS, state: dict | None = None) -> dict:
    """The state of one id after its events in order; with state, carried on from there.

    ``ask``, ``final`` and ``malformed`` are calls: they count with their tokens and set the round. ``ask`` opens a question of its round; ``resolved`` answers it
    when the rounds agree, else it is ignored. ``final`` (with its value) and ``malformed`` (with the last number of the last answer) end the
    log, and what follows is ignored. A log that has reached ``rounds`` without an end is exhausted, with the last number of its last answer.
    """
    state = dict(state or {"status": "active", "round": 0, "pending": None, "value": None, "calls": 0, "tokens": 0, "last": None, "picks": ""})
    for e in events:
        kind = e["type"]
        if state["status"] in ("final", "malformed"):
            break
        if kind == "resolved":
            if state["pending"] is not None and e["round"] is not None and int(e["round"]) == state["pending"]:
                state["last"], state["pending"] = e.get("value"), None
                state["picks"] += e.get("chosen_key") or ""
            continue
        if kind not in ("ask", "final", "malformed"):
            continue
        state["calls"] += 1
        state["tokens"] += int(e.get("n_tokens") or 0)
        state["round"] = int(e.get("round") or 0)
        if kind == "ask":
            state["pending"] = state["round"]
        else:
            state["status"], state["value"] = kind, e.get("value") if kind == "final" else last_number(state["last"])
    return state


def closed(state: dict, rounds: int = ROUNDS) -> dict:
    """The state as a report shows it: exhausted where its rounds are used up without an end."""
    if state["status"] == "active" and state["round"] >= rounds:
        return state | {"status": "exhausted", "value": last_number(state["last"])}
    return state


STATE = "id string, status string, round int, calls int, tokens long, value string, picks string"


def state_row(key: str, s: dict) -> dict:
    return {"id": key, "status": s["status"], "round": s["round"], "calls": s["calls"], "tokens": s["tokens"], "value": s["value"], "picks": s["picks"]}


def replay_logs(events: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """STATE of each id; events have id, seq, type, round, n_tokens, value, chosen_key. A fold over one id's ordered events, which are short."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame([state_row(pdf["id"].iloc[0], closed(replay(pdf.astype(object).where(pdf.notna(), None).to_dict("records"), rounds), rounds))])

    return events.groupBy("id").applyInPandas(run, STATE)


def replay_declared(events: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The same states by windows and one aggregate, for logs in which an ask is answered before the next one: no Python."""
    w = W.partitionBy("id").orderBy("seq")
    over = F.coalesce(F.max(F.col("type").isin("final", "malformed").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    live = events.withColumn("_over", over).where("_over = 0")
    step = F.when(F.col("type").isin("ask", "resolved"), F.col("type"))
    asked = F.last(F.when(F.col("type") == "ask", F.col("round")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    before = F.last(step, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    # a resolved event counts when its round is the last asked one and no counted answer came since
    match = (F.col("type") == "resolved") & (F.col("round") == F.col("_asked"))
    live = live.withColumn("_asked", asked).withColumn("_before", before).withColumn("_m", match)
    turn = F.sum((F.col("type") == "ask").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    live = live.withColumn("_turn", turn)
    first = F.row_number().over(W.partitionBy("id", "_turn", "_m").orderBy("seq"))
    live = live.withColumn("_counts", F.col("_m") & (first == 1) & (F.col("_turn") > 0))
    call = F.col("type").isin("ask", "final", "malformed")
    out = live.groupBy("id").agg(
        F.max_by("type", F.when(call, F.col("seq"))).alias("end"), F.coalesce(F.max_by(F.coalesce("round", F.lit(0)), F.when(call, F.col("seq"))), F.lit(0)).alias("round"), F.count_if(call).cast("int").alias("calls"), F.sum(F.when(call, F.coalesce("n_tokens", F.lit(0))).otherwise(0)).cast("long").alias("tokens"),
        F.max_by("value", F.when(F.col("type") == "final", F.col("seq"))).alias("final"), F.max_by("value", F.when(F.col("_counts"), F.col("seq"))).alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_counts"), F.struct("seq", F.coalesce("chosen_key", F.lit("")).alias("k"))))), lambda s: s["k"]), "").alias("picks"),
    )
    status = F.when(F.col("end").isin("final", "malformed"), F.col("end")).when(F.col("round") >= rounds, "exhausted").otherwise("active")
    number = F.try_element_at(F.regexp_extract_all(F.regexp_replace("last", "[$%,]", ""), F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1))
    return out.select("id", status.alias("status"), F.col("round").cast("int").alias("round"), "calls", "tokens", F.when(status == "final", F.col("final")).when(status.isin("malformed", "exhausted"), number).alias("value"), "picks")


def lease_state(heartbeat: Column, ended: Column, now: Column, fresh_seconds: int = 900) -> Column:
    """none, ended, fresh or stale."""
    return F.when(heartbeat.isNull(), "none").when(ended, "ended").when(now.cast("long") - heartbeat.cast("long") < fresh_seconds, "fresh").otherwise("stale")


def within_cap(ledger: DataFrame, cap: float, keys: list[str], order: list[Column | str], cost: str = "cost", most_unknown: int = 0) -> DataFrame:
    """The rows up to the first whose running cost passes cap, or whose running count of unknown (null) costs passes most_unknown."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    spent, unknown = F.sum(F.coalesce(cost, F.lit(0))).over(w), F.sum(F.col(cost).isNull().cast("int")).over(w)
    return ledger.withColumn("spent", spent).withColumn("_unknown", unknown).where((F.col("spent") <= cap) & (F.col("_unknown") <= most_unknown)).drop("_unknown")


def previous_stratum(turns: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """turns with ``before`` (the last one's value) and ``stratum``: none, changed or same."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return turns.withColumn("before", before).withColumn("stratum", F.when(F.col("before").isNull(), "none").when(F.col("before") == F.col(value), "same").otherwise("changed"))


#: Calls in a trace: <decide type="T">question</decide>; an answer span: <result>...</result>.
CALL = r'<decide type="([a-z]+)">'


def triggers(text: Column) -> Column:
    """The types of all calls in a text."""
    return F.regexp_extract_all(text, F.lit(CALL), F.lit(1))


def without_results(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<result>.*?</result>", "")


def replaceable_share(points: DataFrame, traces: DataFrame) -> DataFrame:
    """id, source, n_points, share of thinking tokens within the points; 0 for a trace without points."""
    spent = points.groupBy("id").agg(F.count("*").alias("n_points"), F.sum("n_tokens").alias("t"))
    return traces.join(spent, "id", "left").select("id", "source", F.coalesce("n_points", F.lit(0)).alias("n_points"), (F.coalesce("t", F.lit(0)) / F.col("n_thinking_tokens")).alias("share"))


def resume(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is left: failed rows of done are done again."""
    return todo.join(done.where("status <> 'failed'").select(key).distinct(), key, "left_anti")


