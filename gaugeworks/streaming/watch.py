"""Watching trials as a stream: state with timers, effects that happen once, commits of what is newly complete.

``watch`` keeps of a trial a handful of numbers (attempt, network failures in a row, how the attempt ended) and gives a row for each change; a launch that is not acknowledged within the grace is asked for again by a timer.
``Effects`` is a foreachBatch function: intents and outcomes are appended to tables in a folder, so a restart from the checkpoint, which gives the last batch once more, starts nothing again that may be running or
has ended. ``Commits`` commits items that are whole, at a stream's batch or by itself, and tries again what failed.

The rules are those of ``gaugeworks.operators.watching``, which has them as a batch plan; tests hold one against the other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.operators.watching import ALLOWED, ENDED, GRACE, KEY, MOST_TRANSIENT, POLLS, effects, newly_complete

ROWS = "trial string, seq long, status string, attempt int, transient int, action string, number int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """trial's state: seq of the last event, attempt, calls seen, failures in a row, how the attempt ended ('' while it runs), whether done, whether the launch was acknowledged."""

    def __init__(self, most_transient: int, allowed: int, grace: float | None):
        self.most, self.allowed, self.grace = most_transient, allowed, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trial", "seq long, calls int, transient int, ended string, acknowledged boolean, asked int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, calls, transient, ended, acknowledged, asked = self.state.get() if self.state.exists() else (-1, 0, 0, "", False, 0)
        events = sorted((int(s), k) for b in rows for s, k in zip(b["seq"], b["kind"]))
        out, was = [], ended
        for at, kind in events:
            if at <= seq:
                continue  # a repeat
            seq, action, number = at, None, calls
            if kind == "launched":
                acknowledged = True
            elif ended == "done":
                pass
            elif kind == "call":
                calls += 1
                transient, ended = 0, ""
            elif kind in POLLS and calls and ended == "":
                transient = transient + 1 if kind == "network" else 0
                if kind in ENDED:
                    ended = "waiting" if number < self.allowed else "failed"
                    action = "continue" if ended == "waiting" else "give_up"
                elif kind == "done":
                    ended, action = "done", "launch"
                elif kind == "error" or transient >= self.most:
                    ended, action = "failed", "give_up"
            elif kind == "network" and ended == "waiting":
                transient += 1
                if transient >= self.most:
                    ended, action = "failed", "give_up"
            if action:
                out.append((seq, ended, calls, transient, action, number + (action == "continue")))
        if calls:
            out.append((seq, ended or "running", calls, transient, None, None))
        if self.grace is not None and ended == "done" and was != "done" and not acknowledged:
            self._again(timerValues)
        self.state.update((seq, calls, transient, ended, acknowledged, asked))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, calls, transient, ended, acknowledged, asked = self.state.get()
        if acknowledged:
            return
        self.state.update((seq, calls, transient, ended, acknowledged, asked + 1))
        self._again(timerValues)
        yield self._rows(key, [(seq, ended, calls, transient, "launch", calls)])

    def _again(self, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.grace))

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *r) for r in rows], columns=["trial", "seq", "status", "attempt", "transient", "action", "number"])
        return out.astype({"number": "Int32", "action": "object"})

    def close(self) -> None:
        pass


def watch(log: DataFrame, most_transient: int = MOST_TRANSIENT, allowed: int = ALLOWED, grace: float | None = None) -> DataFrame:
    """ROWS of a stream of events (trial, seq, kind): one for each decision (action launch, continue or give_up, with the number of the attempt it is for) and one, without an action, for where a trial stands after a batch.

    Events of a trial come in order from batch to batch and in any order within one; repeats are passed over. With grace (seconds), a launch that no event ``launched`` follows is asked for again each time the
    grace is over; such a stream has timers to look after, so it has no end of its own, under availableNow neither. The session's state store has to be RocksDB (PROVIDER), which timers need.
    """
    grouped = log.select(F.col("trial").cast("string"), F.col("seq").cast("long"), F.col("kind").cast("string")).groupBy("trial")
    return grouped.transformWithStateInPandas(Watch(most_transient, allowed, grace), ROWS, "Update", "None" if grace is None else "ProcessingTime")


def _table(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """The rows appended at a folder so far; none where it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.read.schema(schema).parquet(at)
    return spark.createDataFrame([], schema)


class Effects:
    """foreachBatch function over rows of watch(): starts every command once.

    do(trial, action, number) runs in the tasks of the due commands and returns nothing, or raises: LookupError says that there is nothing to launch, any other error that it is to be tried again at a later
    batch. landed gives what is already there (KEY), whoever started it. Tables commands, intents and outcomes in folder are only appended to; a batch that is given once more appends its commands again, which are distinct when read.
    """

    COMMANDS, INTENTS, OUTCOMES = "trial string, action string, number int", "trial string, action string, number int, at double", "trial string, action string, number int, at double, result string"

    def __init__(self, folder: str, do: Callable[[str, str, int], None], grace: float = GRACE, landed: Callable[[SparkSession], DataFrame] | None = None, clock: Callable[[], float] = time.time):
        self.folder, self.do, self.grace, self.landed, self.clock = folder.rstrip("/"), do, grace, landed, clock

    def states(self, spark: SparkSession) -> DataFrame:
        """effects() of the tables as they are."""
        tables = [_table(spark, f"{self.folder}/{n}", s) for n, s in (("commands", self.COMMANDS), ("intents", self.INTENTS), ("outcomes", self.OUTCOMES))]
        there = self.landed(spark) if self.landed else spark.createDataFrame([], self.COMMANDS)
        return effects(*tables, there, F.lit(self.clock()), self.grace)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, do = batch.sparkSession, self.do
        batch.where("action in ('launch', 'continue')").select(*KEY).distinct().write.mode("append").parquet(f"{self.folder}/commands")
        now = self.clock()
        own = f"{self.folder}/passes/{batch_id}-{time.time_ns()}"
        # the due commands are fixed before their intents change what is due
        self.states(spark).where("state = 'due'").select(*KEY).write.parquet(own)
        due = spark.read.schema(self.COMMANDS).parquet(own)
        due.withColumn("at", F.lit(now)).write.mode("append").parquet(f"{self.folder}/intents")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                results = []
                for trial, action, number in zip(part["trial"], part["action"], part["number"]):
                    try:
                        do(trial, action, int(number))
                        results.append("ok")
                    except LookupError:
                        results.append("unmapped")
                    except Exception:  # noqa: BLE001 - whatever it was, the outcome says so and a later batch tries again
                        results.append("failed")
                yield part.assign(at=now, result=results)

        due.mapInPandas(run, self.OUTCOMES).write.mode("append").parquet(f"{self.folder}/outcomes")


class Commits:
    """foreachBatch function over files (item, version, part, parts): commit(rows) is given what is whole and not yet committed, all of it again after an error.

    Tables files and committed in folder are only appended to; an item is committed again only where the process dies between commit and the append, so commit has to bear a repeat.
    """

    FILES, ITEMS = "item string, version long, part int, parts int", "item string, version long"

    def __init__(self, folder: str, commit: Callable[[DataFrame], None]):
        self.folder, self.commit, self.errors = folder.rstrip("/"), commit, []

    def poll(self, spark: SparkSession) -> int:
        """Items committed by one look at the tables."""
        own = f"{self.folder}/passes/{time.time_ns()}"
        newly_complete(_table(spark, f"{self.folder}/files", self.FILES), _table(spark, f"{self.folder}/committed", self.ITEMS)).write.parquet(own)
        new = spark.read.schema(self.ITEMS).parquet(own)
        if not (n := new.count()):
            return 0
        try:
            self.commit(new)
        except Exception as error:  # noqa: BLE001 - told, and tried again at the next look
            self.errors.append(f"{type(error).__name__}: {error}")
            return 0
        new.write.mode("append").parquet(f"{self.folder}/committed")
        return n

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.select("item", F.col("version").cast("long"), F.col("part").cast("int"), F.col("parts").cast("int")).write.mode("append").parquet(f"{self.folder}/files")
        self.poll(batch.sparkSession)
