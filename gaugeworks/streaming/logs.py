"""Structured Streaming twins: event-log replay with state, running scores of prediction files, leases that go stale."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.operators.traces import ROUNDS, STATE, closed, replay, state_row

EVENT = "id string, seq long, type string, round int, n_tokens long, value string, chosen_key string"


def replay_stream(events: DataFrame, rounds: int = ROUNDS, idle: str | None = None) -> DataFrame:
    """STATE of each id with new events, updated by micro-batch. What is kept of an id is its folded state (a few fields and the last event's number), never its events.

    Events come in order from batch to batch (a log is appended to) and in any order within one; an event with a number already folded is a repeat and is passed over. With idle
    (as '10 minutes'), an id without events for that long is given out once more and forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([state_row(key[0], closed(now, rounds))])
            return
        last = now.pop("seq") if now else -1
        new = [r for b in batches for r in b.astype(object).where(b.notna(), None).to_dict("records") if r["seq"] > last]
        now = replay(sorted(new, key=lambda r: r["seq"]), rounds, now)
        state.update((json.dumps(now | {"seq": max([last, *(int(r["seq"]) for r in new)])}),))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([state_row(key[0], closed(now, rounds))])

    return events.groupBy("id").applyInPandasWithState(step, STATE, "log string", "update", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window start, key, n, value: event-time windows with a watermark; rows later than ``late`` are dropped."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), key, "n", "value")


def running_scores(rows: DataFrame) -> DataFrame:
    """task, n, acc, mean_conf so far, of a stream of scored rows."""
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("acc"), F.avg("conf").alias("mean_conf"))


def append_ledger(stream: DataFrame, path: str, checkpoint: str):
    """Rows written exactly once: a file sink with a checkpoint; trigger once over what is there. The started query."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
