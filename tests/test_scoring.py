"""A suite scored end to end: structure checks, a run that is killed and taken up again, the lines' commit protocol, digests."""

import glob
import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import scoring
from gaugeworks.sources.scored import ScoredLines

REQUEST = f"id string, group_id string, source string, variant string, state string, questions {scoring.QUESTIONS}"
YES = ("q", "noul", None, "true", "t")
PICK = ("c", "choice", ["a", "b"], "b", "u")


def predicted(spark, rows):
    """rows of (id, questions, answers, error)."""
    schema = f"id string, group_id string, source string, variant string, questions {scoring.QUESTIONS}, answers {scoring.ANSWERS}, error string"
    return spark.createDataFrame([(i, "g", "s", "clean", q, a, e) for i, q, a, e in rows], schema)


def test_structure_checks_name_the_first_fault(spark):
    nan = float("nan")
    good = ("q", ["true", "false"], [0.75, 0.25], None)
    cases = {
        "good": ([YES, PICK], [("c", ["b", "a"], [0.5, 0.5], [1.0, 2.0]), good], None),
        "near": ([YES], [("q", ["false", "true"], [0.25, 0.754], None)], None),
        "overflow": ([YES], None, "overflow"),
        "none": ([YES], None, None),
        "fewer": ([YES, PICK], [good], None),
        "other": ([YES], [("x", ["false", "true"], [0.5, 0.5], None)], None),
        "twice": ([YES, PICK], [good, good], None),
        "keys": ([YES, PICK], [good, ("c", ["a", "z"], [0.5, 0.5], None)], None),
        "more": ([YES], [("q", ["false", "true", "x"], [0.5, 0.5, 0.0], None)], None),
        "nan": ([YES], [("q", ["false", "true"], [nan, 0.5], None)], None),
        "null": ([YES], [("q", ["false", "true"], [None, 0.5], None)], None),
        "below": ([YES], [("q", ["false", "true"], [-0.1, 1.0], None)], None),
        "sum": ([YES], [("q", ["false", "true"], [0.5, 0.52], None)], None),
        "logits": ([YES], [("q", ["false", "true"], [0.5, 0.5], [1.0, float("inf")])], None),
        "order": ([YES, PICK], [("q", ["false", "true"], [0.9, 0.9], None), ("c", ["z", "a"], [0.5, 0.5], None)], None),
    }
    rows, rejected = scoring.prediction_rows(predicted(spark, [(k, *v) for k, v in cases.items()]))
    ids, keys, numbers, total, logits = "answer ids differ from request ids", "probability keys do not match requested options", "non-finite or out-of-range probabilities", "invalid probability sum", "logit keys or values do not match the requested options"
    assert {r["id"]: r["error"] for r in rejected.collect()} == {"overflow": "overflow", "none": ids, "fewer": ids, "other": ids, "twice": ids, "keys": keys, "more": keys, "nan": numbers, "null": numbers, "below": numbers, "sum": total, "logits": logits, "order": total}
    got = {(r["id"], r["question"]): r for r in rows.collect()}
    assert set(got) == {("good", "q"), ("good", "c"), ("near", "q")}
    assert got["good", "q"]["p"] == [0.25, 0.75] and got["good", "q"]["label"] == 1 and got["good", "c"]["logits"] == [2.0, 1.0] and got["good", "c"]["label"] == 1 and got["good", "c"]["parent"] == "good"
    assert got["near", "q"]["raw_sum"] == pytest.approx(1.004) and sum(got["near", "q"]["p"]) == pytest.approx(1)
    empty = scoring.prediction_rows(predicted(spark, []))
    assert empty[0].count() == empty[1].count() == 0


def suite(spark, n=60):
    return spark.createDataFrame([(str(k), f"g{k // 2}", "s", "clean", json.dumps({"k": k}), [YES]) for k in range(n)], REQUEST).repartition(3)


def answering(log, dies=lambda k: False):
    def predict(batches):
        for batch in batches:
            out = []
            for sha, i, state in zip(batch["request_sha256"], batch["id"], batch["state"]):
                k = json.loads(state)["k"]
                if dies(k):
                    raise RuntimeError("the machine is gone")
                with open(f"{log}/{i}", "a") as f:
                    f.write("x")
                p = float("nan") if k == 7 else (k % 10) / 10
                out.append((sha, i, [{"qid": "q", "keys": ["false", "true"], "p": [1 - p, p], "logits": None}], None, 1.0))
            yield pd.DataFrame(out, columns=["request_sha256", "id", "answers", "error", "latency_ms"])

    return predict


def test_a_run_that_is_killed_is_taken_up_again(spark, tmp_path):
    log, whole, folder = str(tmp_path / "log"), str(tmp_path / "whole"), str(tmp_path / "run")
    os.makedirs(log)
    requests = suite(spark)
    scoring.evaluate(requests, answering(log), whole, waves=4)
    for f in glob.glob(f"{log}/*"):
        os.remove(f)
    with pytest.raises(Exception, match="the machine is gone"):
        scoring.evaluate(requests, answering(log, lambda k: k == 31), folder, waves=4)
    spark.dataSource.register(ScoredLines)
    before = {r["id"] for r in spark.read.format("scored_lines").load(folder).collect()}
    assert len(before) < 60 and "31" not in before
    assert scoring.evaluate(requests, answering(log), folder, waves=4) > 0
    assert all(os.path.getsize(f"{log}/{i}") == 1 for i in before)  # what was committed is not asked again
    assert scoring.evaluate(requests, answering(log), folder, waves=4) == 0
    short = lambda x: round(x, 9) if isinstance(x, float) else x
    plain = lambda at: [sorted(repr([short(x) for x in r]) for r in df.collect()) for df in scoring.evaluated(requests, at)]
    assert plain(folder) == plain(whole)
    rows, rejected, report = scoring.evaluated(requests, folder)
    assert rows.count() == 59 and [tuple(r)[0::2] for r in rejected.collect()] == [("7", "non-finite or out-of-range probabilities")] and report.first()["n"] == 59
    assert tuple(scoring.coverage(requests, rows, rejected).first()) == (60, 60, 59, 59, 1)


def test_lines_are_read_as_far_as_they_were_committed(spark, tmp_path):
    folder = str(tmp_path / "lines")
    spark.dataSource.register(ScoredLines)
    read = lambda: spark.read.format("scored_lines").load(folder)
    assert read().count() == 0
    line = ("h", " é\n", [("q", ["a"], [1.0], None)], None, 2.0)
    df = spark.createDataFrame([line, ("i", None, None, "bad", None)], scoring.LINE).repartition(2)
    df.write.format("scored_lines").mode("append").save(folder)
    df.limit(0).write.format("scored_lines").mode("append").save(folder)
    got = {r["request_sha256"]: r for r in read().collect()}
    assert got["h"]["id"] == " é\n" and got["h"]["answers"][0]["p"] == [1.0] and got["i"]["error"] == "bad" and got["i"]["answers"] is None
    assert read().rdd.getNumPartitions() == len(glob.glob(f"{folder}/lines/*.jsonl"))
    with open(f"{folder}/lines/stray.jsonl", "w") as f:  # of a task that no commit names
        f.write("torn")
    assert read().count() == 2
    with pytest.raises(Exception, match="only appended"):
        df.write.format("scored_lines").mode("overwrite").save(folder)
    with pytest.raises(Exception):  # noqa: B017 - strict JSON refuses it in the task
        spark.createDataFrame([("n", "x", None, None, float("nan"))], scoring.LINE).write.format("scored_lines").mode("append").save(folder)
    assert read().count() == 2


def test_digests_do_not_mind_the_order_of_keys_and_sentences(spark):
    states = ['{"a": 1, "b": {"d": [2, 1], "c": null}}', '{"b":{"c":null,"d":[2,1]},"a":1}', '{"a": 1, "b": {"d": [1, 2], "c": null}}', "plain text", None,
              '{"policy": "p", "case": "One. Two. Three."}', '{"case": "Three. One. Two.", "policy": "p"}', '{"policy": "p", "case": "One. Two"}', '{"policy": "p"}']
    df = spark.createDataFrame(list(enumerate(states)), "k int, s string")
    got = [tuple(r) for r in df.orderBy("k").select(scoring.digest(F.col("s")), scoring.semantic_hash(F.col("s"))).collect()]
    assert got[0] == got[1] and got[0][0] == got[0][1] == hashlib.sha256(b'{"a":1,"b":{"c":null,"d":[2,1]}}').hexdigest()
    assert got[2][0] != got[0][0] and got[3][0] and got[4] == (None, None)
    assert got[5][1] == got[6][1] != got[7][1] and got[5][0] != got[6][0] and got[8][0] == got[8][1]


def test_requests_alike_but_for_labels_are_one(spark):
    rows = [("a", "g", "s", "clean", '{"x": 1}', [YES]), ("b", "g", "s", "clean", '{"x":1}', [("q", "noul", None, "false", "other")]), ("c", "g", "s", "clean", '{"x":1}', [PICK])]
    got = [r[0] for r in spark.createDataFrame(rows, REQUEST).select(scoring.request_digest(spark.createDataFrame(rows, REQUEST))).collect()]
    assert got[0] == got[1] != got[2]


def test_training_problems(spark):
    rows = [("1", "ok", None, None), ("2", "bad", None, None), ("3", "compositional", "flat", "k"), ("4", "compositional", "held", "k"), ("5", "compositional", "rand:1", "held"), ("6", "compositional", "rand:2", "k")]
    df = spark.createDataFrame(rows, "id string, source string, family string, structure string")
    found = lambda **kw: {r["id"]: r["problem"] for r in scoring.training_problems(df, families=["flat"], held_structures=["held"], **kw).collect()}
    assert set(found(forbidden=["bad"])) == {"2", "4", "5"} and set(found(allowed=["ok"])) == {"2", "3", "4", "5", "6"}
