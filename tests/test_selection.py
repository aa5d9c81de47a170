"""Admission with re-selection against a plain loop over records."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import selection
from gaugeworks.plans import registry

SCHEMA = "id long, pool int, quota long, stratum string, keys array<string>, `group` string, own string, ord string"


def by_turns(rows, per_group=None, final=None):
    """The rule as it reads: pools in order, strata in turns, every record judged when it is offered."""
    held, out = set(), {}
    for pool in sorted({r[1] for r in rows}):
        mine = sorted((r for r in rows if r[1] == pool), key=lambda r: (r[7], r[0]))
        quota = mine[0][2] if mine[0][2] is not None else len(mine)
        barred = set()
        while True:
            queues = {s: [r for r in mine if r[3] == s] for s in sorted({r[3] for r in mine})}
            taken, groups, status, turn = set(), {}, {}, dict.fromkeys(queues, 0)
            chosen = []
            while len(chosen) < quota and any(queues.values()):
                for s, queue in queues.items():
                    while queue and len(chosen) < quota:
                        r = queue.pop(0)
                        keys = {k for k in r[4] or [] if k is not None}
                        if r[6]:
                            why = r[6]
                        elif r[0] in barred:
                            why = "final_record_rejected"
                        elif keys & (held | taken):
                            why = "duplicate_state"
                        elif per_group is not None and r[5] is not None and groups.get(r[5], 0) >= per_group:
                            why = "group_limit"
                        else:
                            why = "chosen"
                        status[r[0]] = (why, turn[s])
                        if why == "chosen":
                            chosen.append(r[0])
                            taken |= keys
                            groups[r[5]] = groups.get(r[5], 0) + 1
                            turn[s] += 1
                            break
            failed = {i for i in chosen if final and final(i)}
            if not failed:
                break
            barred |= failed
        held |= taken
        out |= status
    return out


def made(seed, n=120, wide=16):
    r = random.Random(seed)
    quota = [r.choice([None, 0, 3, 9, 25]) for _ in range(4)]
    rows = []
    for k in range(n):
        pool = r.choice([0, 1, 1, 2, 3])
        keys = r.choice([None, [], [f"k{r.randrange(wide)}"], [f"k{r.randrange(wide)}", None, f"m{r.randrange(wide)}"], ["hot"], [f"u{k}"], [f"u{k}"]])
        rows.append((k, pool, quota[pool], r.choice("abccc"), keys, r.choice([None, "g", "g", f"g{r.randrange(8)}"]), r.choice([None, None, None, None, "context"]), str(r.randrange(40))))
    return rows


@pytest.mark.parametrize("seed,per_group,last", [(1, None, None), (2, 1, None), (4, 2, 7)])
def test_choice_is_that_of_a_loop_over_records(spark, monkeypatch, seed, per_group, last):
    monkeypatch.setattr(selection, "BLOCK", 7)
    rows = made(seed)
    final = None if last is None else (lambda chosen: chosen.where(F.col("id") % last == 0))
    got = selection.choose(spark.createDataFrame(rows, SCHEMA), ["ord"], per_group, final).collect()
    assert {x["id"]: (x["status"], x["turn"]) for x in got} == by_turns(rows, per_group, None if last is None else (lambda i: i % last == 0))
    assert len({x["id"] for x in got}) == len(got)


@pytest.mark.parametrize("seed,strata,last", [(5, 40, 3), (6, 3, None)])
def test_fronts_are_doubled_until_the_choice_asks_for_no_more(spark, monkeypatch, seed, strata, last):
    """Quotas that need a stratum, or a number of strata, far beyond the first front; pools that stop at their last open record."""
    r, fronts, judge = random.Random(seed), [], selection._judged
    monkeypatch.setattr(selection, "SPARE", 1, raising=False)
    monkeypatch.setattr(selection, "_judged", lambda turns, per_group: fronts.append(turns.count()) or judge(turns, per_group))
    rows = []
    for k in range(400):
        pool, at = r.choice([0, 1, 1, 1, 2]), r.randrange(strata)
        own = "context" if at < strata // 2 + 1 and r.random() < 0.95 else None
        rows.append((k, pool, [2, 12, 0][pool], f"{at:02}", [r.choice(["hot", f"k{k % 90}", f"u{k}"])], f"g{r.randrange(60)}", own, str(r.randrange(40))))
    rows += [(1000, 3, 2, "a", ["x"], None, None, "1"), (1001, 3, 2, "a", ["y"], None, None, "2"), (1002, 3, 2, "a", ["x"], None, None, "3"), (1003, 3, 2, "b", ["x"], None, None, "1")]  # just as many as the quota
    final = None if last is None else (lambda chosen: chosen.where(F.col("id") % last == 0))
    got = selection.choose(spark.createDataFrame(rows, SCHEMA), ["ord"], 2, final).collect()
    assert {x["id"]: (x["status"], x["turn"]) for x in got} == by_turns(rows, 2, None if last is None else (lambda i: i % last == 0))
    assert fronts[0] < fronts[-1]


def test_rounds_judge_a_front_that_hangs_on_the_quota(spark, monkeypatch):
    """d13_refusals and d13_admitted: a pool of many records with a small quota."""
    judged, judge = [], selection._judged
    monkeypatch.setattr(selection, "_judged", lambda turns, per_group: judged.append(turns.count()) or judge(turns, per_group))
    rows = spark.range(20_000).selectExpr("id", "0 AS pool", "10L AS quota", "lpad(id div 5, 5, '0') AS stratum", "array(cast(id % 15000 AS string)) AS keys", "lpad(id div 5, 5, '0') AS `group`", "cast(null AS string) AS own", "lpad(id, 5, '0') AS ord")
    got = selection.choose(rows, ["ord"], 2, lambda chosen: chosen.where("id % 10 = 0")).collect()
    assert sorted((x["id"], x["status"]) for x in got if x["status"] == "chosen") == [(5 * k + (k % 2 == 0), "chosen") for k in range(10)]
    assert max(judged) < 1000


def test_long_chain_and_no_rows(spark):
    rows = [(k, 0, None, "s", [f"{k}", f"{k + 1}"], None, None, f"{k:03}") for k in range(5)]  # each record shares a key with the next
    got = selection.choose(spark.createDataFrame(rows, SCHEMA), ["ord"])
    assert {x["id"]: x["status"] for x in got.collect()} == {k: "chosen" if k % 2 == 0 else "duplicate_state" for k in range(5)}
    assert {x["status"]: x["n"] for x in selection.refusals(got).collect()} == {"chosen": 3, "duplicate_state": 2}
    assert selection.choose(spark.createDataFrame([], SCHEMA), ["ord"], 1).collect() == []


def test_first_of_state(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "x"), (2, "b", "x"), (4, "a", None), (5, "a", None)], "id long, source string, state string")
    assert sorted(x["id"] for x in selection.first_of_state(rows, ["source", "state"]).collect()) == [1, 2, 4]


def test_fingerprints_and_reserved_rows(spark):
    digest = lambda t: hashlib.sha256(" ".join(t.casefold().split()).encode()).hexdigest()
    states = [{"a": "short", "b": {"c": ["a longer \"one\" \\ here", "tiny"]}}, {"a very long name of a field": "x", "b": "y"}, {"n": [1, 2], "m": {}}, "just  a TEXT", {"e": "é\n: \"q\": ", "f": ""}, []]
    rows = spark.createDataFrame([(k, json.dumps(s, ensure_ascii=False)) for k, s in enumerate(states)] + [(9, None)], "id int, state string")
    got = {x["id"]: x["f"] for x in rows.select("id", selection.fingerprint(F.col("state")).alias("f")).collect()}
    want = ["a longer \"one\" \\ here", "x", None, "just a text", "é : \"q\":", None]
    for k, w in enumerate(want):
        assert w is None or got[k] == digest(w)
    assert got[9] is None and len({got[k] for k in range(6)}) == 6
    a, b = (json.dumps({"policy": "p", "case": c}) for c in ("One. Two. Three.", "Three. One. Two."))
    assert len({x["f"] for x in spark.createDataFrame([(a,), (b,)], "state string").select(selection.fingerprint(F.col("state")).alias("f")).collect()}) == 1
    new = spark.createDataFrame([(1, "f1", "r", 1), (2, "f2", "r", 2), (3, "f3", None, 3), (4, None, "r", 4)], "id int, f string, repo string, row int")
    old = spark.createDataFrame([("f1", "q", 1), ("f9", "r", 2), ("f9", None, 3), (None, "z", 1)], "f string, repo string, row int")
    assert sorted(x["id"] for x in selection.fresh(new, old, [["f"], ["repo", "row"]]).collect()) == [3, 4]


def test_refusals_query_against_the_loop(spark, sf):
    from collections import Counter

    from gaugeworks.plans import queries_selection as Q

    rows = [(r["id"], r["pool"].split("|")[0], r["quota"], r["group"], r["keys"], r["group"], r["own"], r["ord"]) for r in Q.candidates(spark, sf).collect()]
    state = {r[0]: r[4][0] for r in rows}
    want = by_turns(rows, Q.PER_GROUP, lambda i: state[i] is not None and int(state[i][:4], 16) % 10 == 0)
    pool = {r[0]: r[1] for r in rows}
    got = {(x["pool"], x["status"]): x["n"] for x in registry.QUERIES["d13_refusals"](spark, sf).collect()}
    assert got == Counter((pool[i], why) for i, (why, _) in want.items()) and any(why == "final_record_rejected" for _, why in got)


def test_pairs_query_against_the_loop(spark, sf):
    from gaugeworks.plans import queries_selection as Q

    rows = [tuple(r) for r in Q.pairs(spark, sf).select("id", "pool", "quota", "stratum", "keys", "group", "own", "ord").collect()]
    want = by_turns([(*r[:7], r[7]) for r in rows])
    got = {x["id"]: x["status"] for x in registry.QUERIES["d14_unique_pairs"](spark, sf).collect()}
    assert got == {k: v[0] for k, v in want.items()} and "duplicate_state" in got.values()
