"""The watch as a stream against its batch plan; effects that happen once over restarts; commits that are tried again."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import watching
from gaugeworks.streaming import watch as W


def logs(n=40, seed=7):
    r = random.Random(seed)
    rows = []
    for t in range(n):
        kinds = ["call"] + [r.choices(["running", "network", "done", "timeout", "refused", "pending", "error", "call"], [8, 8, 1, 2, 1, 1, 1, 2])[0] for _ in range(r.randint(0, 14))]
        if t % 9 == 0:
            kinds = ["network", *kinds]  # before the first call: passed over
        rows += [(f"t{t}", k, kind) for k, kind in enumerate(kinds)]
    return rows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, W.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def started(spark, source, out, checkpoint, **kwargs):
    stream = spark.readStream.schema("trial string, seq long, kind string").option("maxFilesPerTrigger", 1).json(source)
    rows = W.watch(stream, 3, 3, **kwargs)
    return rows.writeStream.foreachBatch(out).outputMode("update").option("checkpointLocation", checkpoint)


def put(spark, rows, folder, name):
    """One file of rows, so that one batch reads it."""
    import json

    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("".join(json.dumps(dict(zip(("trial", "seq", "kind"), r))) + "\n" for r in rows))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def test_the_stream_says_what_the_batch_plan_says(rocks, tmp_path):
    spark, rows = rocks, logs()
    source = str(tmp_path / "in")
    first = [x for x in rows if x[1] < 4]
    put(spark, random.Random(1).sample(first, len(first)), source, "a.json")
    got = []
    keep = lambda df, k: got.extend(df.collect())
    for _ in range(2):  # the second run restarts from the checkpoint, with the rest and some repeats
        started(spark, source, keep, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        if not os.path.exists(f"{source}/b.json"):
            put(spark, [x for x in rows if x[1] >= 2], source, "b.json")
    log = spark.createDataFrame(rows, "trial string, seq long, kind string")
    last = {}
    for r in got:
        if r["action"] is None:
            last[r["trial"]] = (r["status"], r["attempt"], r["transient"])
    assert {r["trial"]: (r["status"], r["attempts"], r["transient"]) for r in watching.settled(log, 3, 3).collect()} == last
    decided = {(r["trial"], r["action"], r["number"]) for r in watching.attempts(log, 3, 3).collect() if r["action"]}
    said = [(r["trial"], r["action"], r["number"]) for r in got if r["action"]]
    assert len(said) == len(set(said))  # repeats and the restart decide nothing twice
    assert decided <= set(said) and all(x in decided or x[1] == "continue" for x in said)  # a continuation that failed was asked for before
    assert {"launch", "continue", "give_up"} == {x[1] for x in said}


def test_a_timer_asks_again_until_the_launch_is_acknowledged(rocks, tmp_path):
    import time

    spark, source, got = rocks, str(tmp_path / "in"), []
    put(spark, [("a", 0, "call"), ("a", 1, "done"), ("b", 0, "call"), ("b", 1, "done"), ("b", 2, "launched")], source, "a.json")
    q = started(spark, source, lambda df, k: got.extend((r["trial"], r["action"]) for r in df.collect() if r["action"]), str(tmp_path / "c"), grace=0.5).trigger(processingTime="300 milliseconds").start()
    end = time.time() + 90
    while got.count(("a", "launch")) < 2 and time.time() < end:
        time.sleep(0.3)
    put(spark, [("a", 2, "launched")], source, "b.json")
    read = lambda: any(p["numInputRows"] == 1 for p in q.recentProgress)
    while not read() and time.time() < end:  # a stream with timers always has a batch to run
        time.sleep(0.3)
    asked = got.count(("a", "launch"))
    time.sleep(3)
    q.stop()
    assert asked >= 2 and got.count(("a", "launch")) <= asked + 1 and got.count(("b", "launch")) == 1


class Dies(BaseException):
    """The end of the process, as far as a sink can tell."""


def dies(*_):
    raise Dies


def test_an_effect_happens_once_over_failures_restarts_and_replays(spark, tmp_path, monkeypatch):
    folder, done = str(tmp_path / "ledger"), str(tmp_path / "done")
    os.makedirs(done)
    now = [1000.0]

    def do(trial, action, number):
        if trial == "none":
            raise LookupError
        path = f"{done}/{trial}-{action}-{number}"
        n = len([x for x in os.listdir(done) if x.startswith(f"{trial}-")])
        if trial == "flaky" and n < 2:
            open(f"{path}.try{n}", "w").close()
            raise ConnectionError
        assert not os.path.exists(path), "started twice"
        open(path, "w").close()

    effects = lambda **kw: W.Effects(folder, do, grace=100, clock=lambda: now[0], **kw)
    rows = [("ok", "launch", 1), ("none", "launch", 1), ("flaky", "continue", 2), ("there", "launch", 1), ("ok", "give_up", 2)]
    batch = spark.createDataFrame([(t, 1, "s", 1, 0, a, n) for t, a, n in rows], W.ROWS)
    landed = lambda s: s.createDataFrame([("there", "launch", 1)], W.Effects.COMMANDS)
    states = lambda: {r["trial"]: (r["state"], r["tries"]) for r in effects(landed=landed).states(spark).collect()}
    effects(landed=landed)(batch, 0)
    assert states() == {"ok": ("done", 1), "none": ("unmapped", 1), "flaky": ("due", 1), "there": ("landed", 0)}
    effects(landed=landed)(batch, 0)  # the batch is given once more, as after a restart
    assert states()["ok"] == ("done", 1) and states()["flaky"] == ("due", 2)
    effects(landed=landed)(batch.limit(0), 1)
    assert states()["flaky"] == ("done", 3) and sorted(os.listdir(done))[-1].startswith("ok-launch")

    # the process dies between the intent and the outcome
    late = spark.createDataFrame([("late", 1, "s", 1, 0, "launch", 1)], W.ROWS)
    with monkeypatch.context() as m:
        m.setattr(type(late), "mapInPandas", dies)
        with pytest.raises(Dies):
            effects(landed=landed)(late, 2)
    assert states()["late"] == ("in_flight", 1)
    effects(landed=landed)(late, 2)
    assert states()["late"] == ("in_flight", 1) and not os.path.exists(f"{done}/late-launch-1")
    now[0] += 101
    effects(landed=landed)(late.limit(0), 3)
    assert states()["late"] == ("done", 2) and os.path.exists(f"{done}/late-launch-1")


def test_watch_and_effects_together_over_a_restart(rocks, tmp_path):
    spark, source = rocks, str(tmp_path / "in")
    done = str(tmp_path / "done")
    os.makedirs(done)

    def do(trial, action, number):
        with open(f"{done}/{trial}-{action}-{number}", "a") as f:
            f.write("x")

    put(spark, [("a", 0, "call"), ("a", 1, "timeout"), ("b", 0, "call"), ("b", 1, "done")], source, "1.json")
    for name, rows in (("2.json", [("a", 2, "call"), ("a", 3, "done")]), ("3.json", [("b", 2, "network"), ("c", 0, "call"), ("c", 1, "error")]), (None, None)):
        started(spark, source, W.Effects(str(tmp_path / "l"), do), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        if name:
            put(spark, rows, source, name)
    assert {f: open(f"{done}/{f}").read() for f in os.listdir(done)} == {"a-continue-2": "x", "b-launch-1": "x", "a-launch-2": "x"}


def test_commits_are_of_whole_items_and_tried_again(spark, tmp_path):
    seen, fail = [], [True]

    def commit(rows):
        if fail[0]:
            raise OSError("volume")
        seen.append(sorted(map(tuple, rows.collect())))

    c = W.Commits(str(tmp_path / "v"), commit)
    files = lambda rows: spark.createDataFrame(rows, W.Commits.FILES)
    assert c.poll(spark) == 0
    c(files([("a", 1, 0, 2), ("b", 1, 0, 1)]), 0)
    assert seen == [] and c.errors == ["OSError: volume"]
    fail[0] = False
    c(files([("a", 1, 0, 2)]), 1)  # listed again, still not whole
    assert seen == [[("b", 1)]]
    c(files([("a", 1, 1, 2), ("a", 2, 0, 1)]), 2)
    c(files([("a", 1, 1, 2), ("a", 2, 0, 1)]), 2)
    assert seen == [[("b", 1)], [("a", 1), ("a", 2)]] and c.poll(spark) == 0


def test_an_empty_log(spark):
    log = spark.createDataFrame([], "trial string, seq long, kind string")
    assert watching.settled(log).count() == 0
    assert watching.settled(spark.createDataFrame([("a", 1, "done"), (None, 1, "call")], log.schema)).collect()[0]["trial"] is None


def test_decisions_on_the_next_attempt(spark):
    at = lambda s: 10_000.0 - s
    ledger = [
        ("spawn", 1, "n", "c1", at(9000), None), ("running", 1, "n", "c2", at(9000), None), ("pending", 1, "n", None, at(10), None), ("gone", 1, "n", None, at(5000), None), ("lease", 1, "n", "c3", at(9000), None),
        ("adopt", 1, "n", None, at(10), None), ("full", 1, "a", "x", at(9), None), ("full", 2, "b", "y", at(9), None), ("full", 3, "c", None, at(9000), at(2)), ("ended", 1, "n", "c4", at(900), None),
    ]
    leases = [("lease", "z", "c3", at(10), False), ("adopt", "n", "c9", at(10), False), ("ended", "z", "c4", at(10), True)]
    polls = [("spawn", "c1", "timeout"), ("running", "c2", "running"), ("lease", "c3", "refused"), ("adopt", "c9", "running"), ("ended", "c4", "timeout")]
    got = watching.next_attempts(
        spark.createDataFrame(ledger, "trial string, number int, nonce string, call string, at double, abandoned double"), spark.createDataFrame(leases, "trial string, nonce string, call string, heartbeat double, ended boolean"),
        spark.createDataFrame(polls, "trial string, call string, status string"), F.lit(10_000.0),
    )
    assert {r["trial"]: (r["decision"], r["used"], r["adopted"]) for r in got.collect()} == {
        "spawn": ("spawn", 1, 0), "running": ("not ended", 1, 0), "pending": ("pending", 1, 0), "gone": ("spawn", 1, 0), "lease": ("lease", 1, 0), "adopt": ("not ended", 1, 1), "full": ("no attempt left", 3, 0), "ended": ("spawn", 1, 0),
    }
