"""Suite construction, text, logs, sources, read-outs, streams on small made-up rows."""

import json
import hashlib
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text as T
from gaugeworks.operators import graph, logic, suite, text_search, traces
from gaugeworks.plans import rounds
from gaugeworks.sources import files
from gaugeworks.streaming import logs


def value(spark, expr, text="", kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_text_functions(spark):
    v = lambda f, x: value(spark, f, x)
    assert v(T.normalised, "  Straße \n X ") == "strasse x"
    assert v(T.word_list, "Ééa b_1, ß!") == ["ééa", "b_1", "ss"]
    assert v(lambda c: T.grams(T.word_list(c), 2), "a b a b") == ["a b", "b a"] and v(lambda c: T.grams(T.word_list(c), 5), "a b") == []
    assert v(T.clean_html, "<p>a<br/>b</p>") == "a b" and v(lambda c: T.cut_at_word(c, 6), "one two three") == "one …"
    assert v(T.last_number, "a 1,200 then -3.5%") == -3.5 and v(T.last_number, "none") is None
    assert v(T.choice_letter, "The answer is (c).") == "C" and v(T.choice_letter, "so (B) it is") == "B" and v(T.choice_letter, "A or D") == "D" and v(T.choice_letter, "no") is None
    assert v(T.commit_type, "feat(ui)!: thing") == "feature" and v(T.commit_type, "Fixed crash") == "fix" and v(T.commit_type, "") is None
    for subject, want in (("Add unit tests for x", "test"), ("update the README", "docs"), ("fix docs", "fix"), ("perf: spec", "test"), ("chore: x", None), ("7 fixes", None), ("`add` a thing", "feature"), ("Adding", "feature"), ("docs(a): tests", "docs")):
        assert v(T.commit_type, subject) == want, subject
    for text in ("ΣΑΣ ς", "ﬁne ŉ ǰ", "ı İ ſ µ", "a\u00a0b\u2003c\x1fd\x85e", "Ꭰ ꭰ ẞ ß", "ÀÉÖ", "\u1e9e\u0345x"):
        assert v(T.normalised, text) == " ".join(text.casefold().split()), text
    assert v(T.date_facts, "2024-01-05 x 2024-01-01, 2024-01-05") == "2024-01-05 to 2024-01-01: 4 days" and v(T.date_facts, "2024-01-05") == ""
    assert v(T.neutral_tokens, "<|end|> a") == "<end> a" and v(T.line_safe, "a\nb") and not v(T.line_safe, "a b")
    assert [value(spark, T.roman, n, "int") for n in (4, 9, 1994, 3999)] == ["IV", "IX", "MCMXCIV", "MMMCMXCIX"]
    assert [value(spark, T.money, n, "long") for n in (123405, -7)] == ["$1,234.05", "-$0.07"] and v(T.slug, " A b--C! ") == "a-b-c"


def test_bm25(spark):
    d = spark.createDataFrame(list(enumerate(["apple banana", "banana cherry", "cherry durian", "apple banana"])), "doc_id int, text string")
    q = spark.createDataFrame([("a", "apple"), ("c", "cherry durian"), ("z", "zzz")], "item_id string, text string")
    got = {}
    for r in text_search.bm25(d, q, 2).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["doc_id"])
    assert got["a"] == [0, 3] and got["c"][0] == 2 and "z" not in got


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(30) if k % 11] + [(r.randrange(50, 90), r.randrange(50, 90)) for _ in range(25)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["component"] for x in graph.min_label_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_selection(spark):
    df = spark.createDataFrame([(str(k), f"h{k % 7}") for k in range(20)], "id string, h string")
    seen = spark.createDataFrame([("h0",), ("h1",)], "h string")
    got = suite.select_unique(df, seen, 5, suite.hash_order(1, "id")).collect()
    assert len(got) == 5 and {r["h"] for r in got} == {f"h{k}" for k in range(2, 7)}
    with pytest.raises(ValueError):
        suite.select_unique(df, seen, 6, suite.hash_order(1, "id"))


def test_quotas_and_deals(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1)], "k string, n long")
    assert sum(r["quota"] for r in suite.quotas(sizes, "k", "n", 10).collect()) == 10
    got = suite.fill_by_share(spark.createDataFrame([(str(k), 1.0) for k in range(100)], "group string, weight double"), {"train": 0.7, "test": 0.3}, 3)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 70, "test": 30}
    # against the rule written out, with uneven weights, a share of nothing and ties
    weights, shares = {f"g{k}": float(k * k % 11) for k in range(60)}, {"a": 0.5, "none": 0.0, "b": 0.25, "c": 0.25}
    filled, want = dict.fromkeys(shares, 0.0), {}
    for g in sorted(weights, key=lambda g: hashlib.sha256(f"5:{g}".encode()).hexdigest()):
        want[g] = min((x for x in shares if shares[x]), key=lambda x: filled[x] / shares[x])
        filled[want[g]] += weights[g]
    df = spark.createDataFrame(list(weights.items()), "group string, weight double").repartition(3)
    assert {r["group"]: r["split"] for r in suite.fill_by_share(df, shares, 5).collect()} == want


def test_votes(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "a"), (2, "b"), (2, "a"), (3, "a"), (3, None), (3, "a")], "item int, label string")
    got = {r["item"]: (r["label"], r["how"]) for r in suite.unanimous(v).collect()}
    assert got == {1: ("a", "agreed"), 2: (None, "split"), 3: (None, "split")}
    verdicts = spark.createDataFrame([(2, "x", 1, "accept", "b"), (2, "x", 2, "relabel", "a"), (2, "y", 1, "relabel", "a"), (3, "x", 1, "drop", None), (3, "y", 1, "drop", None)], "item int, judge string, line int, verdict string, label string")
    split = spark.createDataFrame([(2,), (3,)], "item int")
    assert [tuple(r) for r in suite.adjudicated(split, verdicts).collect()] == [(2, "a")]


def test_rules_and_negation(spark):
    r = random.Random(8)

    def tree(depth):
        op = r.choice(["and", "or", "not", "unless", "if"]) if depth else None
        return r.choice("abc") if op is None else (op, *[tree(depth - 1) for _ in range({"not": 1, "if": 3}.get(op, 2))])

    facts = spark.createDataFrame([(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (True, False, None)], "a boolean, b boolean, c boolean")
    atoms = {k: F.col(k) for k in "abc"}
    for _ in range(12):
        t = tree(3)
        got = facts.select(logic.rule(t, atoms).alias("x"), logic.rule(logic.push_negation(t), atoms).alias("y"), logic.rule(logic.push_negation(("not", t)), atoms).alias("n")).collect()
        assert all(x["x"] == x["y"] and x["n"] == (None if x["x"] is None else not x["x"]) for x in got)
    assert logic.canonical(("and", "b", ("or", "c", "a"))) == logic.canonical(("and", ("or", "x", "y"), "z"))
    assert logic.canonical(("or", ("and", "a", "b"), ("not", "c"))) == logic.canonical(("or", ("not", "c"), ("and", "b", "a"))) == "or(and(0,1),not(2))"
    assert logic.canonical(("and", "a", "a")) != logic.canonical(("and", "a", "b")) and logic.canonical(("if", "a", "b", "c")) != logic.canonical(("unless", "a", "b"))


EVENTS = "id string, seq long, type string, round int, n_tokens long, value string, chosen_key string"


def events(seed=1):
    r = random.Random(seed)
    return [(f"u{k % 5}", k, r.choices(["ask", "resolved", "final", "malformed"], [8, 8, 1, 1])[0], r.randint(1, 4), r.choice([None, 3, 9]), f"v{k}", r.choice("ABC")) for k in range(90)]


def test_replay_declared_is_the_fold(spark):
    for seed in range(4):
        df = spark.createDataFrame(events(seed), EVENTS)
        key = lambda d: sorted(map(tuple, d.select("id", "status", "round", "calls", "tokens", "value", "picks").collect()))
        assert key(traces.replay_logs(df)) == key(traces.replay_declared(df))


def test_replay_cases():
    ask, res, fin = (lambda n: {"type": "ask", "round": n}), (lambda n, v: {"type": "resolved", "round": n, "value": v}), {"type": "final", "value": "z"}
    assert traces.replay([ask(1), res(2, "x"), res(1, "y"), fin, ask(2)])["value"] == "z"
    # calls and tokens are those of ask, final and malformed, which all set the round; a malformed log has the last number of its last answer
    s = traces.replay([ask(1) | {"n_tokens": 7}, res(1, "about $1,250.5 or 3") | {"n_tokens": 100}, {"type": "malformed", "round": 2, "n_tokens": 5}])
    assert (s["status"], s["value"], s["calls"], s["tokens"], s["round"]) == ("malformed", "3", 2, 12, 2)
    assert traces.replay([{"type": "malformed", "round": 1}])["value"] is None
    # rounds that are used up end a log even when its last ask is open
    assert traces.closed(traces.replay([ask(5)]))["status"] == "exhausted" and traces.closed(traces.replay([ask(4)]))["status"] == "active"
    assert traces.replay([res(1, "x"), ask(1)])["last"] is None
    s = traces.closed(traces.replay([x for k in range(1, 6) for x in (ask(k), res(k, f"v{k}"))]))
    assert (s["status"], s["value"]) == ("exhausted", "5")


def test_replay_stream(spark, tmp_path):
    rows = events(3)
    for k, part in enumerate((rows[:40], rows[40:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(logs.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = logs.replay_stream(stream).writeStream.format("memory").queryName("replayed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("replayed").collect():
        last[r["id"]] = tuple(r) if r["id"] not in last or r["tokens"] >= last[r["id"]][4] else last[r["id"]]
    want = {r["id"]: tuple(r) for r in traces.replay_logs(spark.createDataFrame(rows, EVENTS)).collect()}
    assert last == want


def test_caps_and_leases(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("a", 3, 3.0), ("b", 1, None), ("b", 2, 1.0)], "k string, n int, cost double")
    assert sorted(map(tuple, traces.within_cap(df, 9.0, ["k"], ["n"]).select("k", "n").collect())) == [("a", 1), ("a", 2)]
    s = spark.createDataFrame([(None, False), (100, True), (100, False), (1100, False)], "b long, e boolean")
    at = lambda c: c.cast("timestamp")
    assert [r[0] for r in s.select(traces.lease_state(at(F.col("b")), F.col("e"), at(F.lit(1500)))).collect()] == ["none", "ended", "stale", "fresh"]


def test_requests(spark, tmp_path):
    good = {"state": "s t", "questions": {"q": {"type": "noul", "label": "true"}}}
    lines = [json.dumps(good, ensure_ascii=False), "", json.dumps({"questions": {}}), json.dumps(good | {"_meta": {"id": "own"}}), json.dumps({"state": "s", "questions": {"q": {"type": "noul"}}})]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = files.load_requests(spark, str(tmp_path / "r.jsonl")).orderBy("line").collect()
    assert [(r["line"], r["id"], r["problem"]) for r in got] == [(1, "custom/1", None), (3, "custom/3", "no state"), (4, "own", None), (5, "custom/5", "question without label")]
    assert got[0]["questions"][0]["src"] == "custom_noul" and got[0]["state"] == "s t"
    assert "label" not in files.without_labels(files.load_requests(spark, str(tmp_path / "r.jsonl"))).schema.simpleString()


def test_tolerant_and_archived_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text('note\n{"id": "1", "verdict": "accept"}\n{bad\n{"id": "1", "verdict": "drop"}\n{"id": "2", "verdict": "maybe"}\n')
    assert [(r["id"], r["verdict"]) for r in files.read_verdicts(spark, str(tmp_path / "v.txt")).collect()] == [("1", "drop")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.jsonl", '{"a": 1}\n\n{"a": 2}\n')
        z.writestr("x.txt", "no")
    assert [(r["member"], r["line"]) for r in files.read_zipped_jsonl(spark, str(tmp_path / "z.zip")).collect()] == [("b.jsonl", 1), ("b.jsonl", 3)]
    records = [bytes([len(s)]) + s + bytes([len(a)]) + a + struct.pack(">d", v) for s, a, v in ((b"fen", b"e2e4", 0.5), (b"", b"x", -1.0))]
    ends = [len(records[0]), len(records[0]) + len(records[1])]
    (tmp_path / "x.bag").write_bytes(b"".join(records) + struct.pack("<2q", *ends))
    assert [tuple(r)[1:] for r in files.read_bags(spark, str(tmp_path / "x.bag")).collect()] == [(0, "fen", "e2e4", 0.5), (1, "", "x", -1.0)]
    assert files.read_varint(bytes([0xAC, 0x02]), 0) == (300, 2)


def test_frozen_suites(spark, tmp_path):
    df = spark.createDataFrame([(k, ("train", "test")[k % 2], f"t{k}") for k in range(20)], "id long, split string, text string")
    at = str(tmp_path / "suite")
    assert {r["split"]: r["records"] for r in files.freeze(df, at, {"seed": 1}).collect()} == {"train": 10, "test": 10}
    assert files.load_split(spark, at, "train").count() == 10
    with pytest.raises(PermissionError):
        files.load_split(spark, at, "test")
    assert files.load_split(spark, at, "test", allow_test=True).count() == 10
    with pytest.raises(ValueError):
        files.load_split(spark, at, "other")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        files.freeze(df, at)
    df.where("id = 0").write.mode("append").partitionBy("split").parquet(f"{at}/data")
    with pytest.raises(ValueError):
        files.load_split(spark, at, "train")


def scored_rows(spark, shift):
    r = random.Random(shift)
    rows = []
    for k in range(120):
        ok = r.random() < 0.5 + shift / 10
        conf = 0.55 + 0.4 * r.random()
        rows.append((str(k), "q", f"s{k % 3}", f"t{k % 2}", k // 4, "clean", conf, ok, 0.3 if ok else 1.5, 0.1))
    return spark.createDataFrame(rows, "id string, question string, source string, task string, grp long, variant string, conf double, ok boolean, nll double, brier double")


SPEC = {"panels": {"all": {}, "some": {"exclude_sources": ["s0"]}}, "criteria": [{"left": "all.acc.delta", "op": ">", "right": 0}, {"left": ["some.ece.candidate", "some.ece.parent"], "op": "<=", "right": 1.0, "plus": 0.1}], "rank": [{"path": "all.acc.candidate"}], "samples": 60}


def test_read_out(spark):
    parent = scored_rows(spark, 0)
    got = {r["arm"]: r for r in rounds.read_out({"better": scored_rows(spark, 4), "same": parent}, parent, SPEC).collect()}
    assert got["better"]["passed"] and got["better"]["place"] == 1 and not got["same"]["passed"] and got["same"]["place"] is None
    found = rounds.values(rounds.compare(parent, parent, SPEC))
    assert found["all.nll.lower"] == found["all.nll.upper"] == found["all.acc.delta"] == 0 and found["some.n.parent"] == 80
    more = SPEC | {"criteria": [{"left": "gone.acc.delta", "op": ">", "right": 0}, {"left": "all.n.parent", "op": ">=", "right": "some.n.parent", "plus": 40}, {"left": "all.n.parent", "op": ">", "right": "some.n.parent", "plus": 40}, {"left": ["all.n.parent", "some.n.parent"], "op": "<", "right": 41}]}
    report = rounds.reports({"same": parent}, parent, more)
    assert {r["k"]: r["holds"] for r in rounds.criteria(report, more).collect()} == {0: None, 1: True, 2: False, 3: True}
    assert rounds.judged(report, more).first()["passed"] is None
    ranked = rounds.judged(report.union(report.withColumn("arm", F.lit("other")).withColumn("value", F.col("value") + 1)), {"criteria": [{"left": "all.n.parent", "op": ">", "right": 0}], "rank": [{"by": ["all.acc.candidate", "some.acc.candidate"]}]})
    assert {r["arm"]: r["place"] for r in ranked.collect()} == {"other": 1, "same": 1}  # each alone of its size
    sized = rounds.judged(report.withColumn("arm", F.lit("4b-x")).union(report.withColumn("arm", F.lit("4b-y")).withColumn("value", F.col("value") + 1)).union(report.withColumn("arm", F.lit("4b-z"))), {"criteria": [{"left": "all.n.parent", "op": ">", "right": 0}], "rank": [{"by": ["all.acc.candidate", "some.acc.candidate"]}], "unselectable": ["4b-z"]})
    assert {r["arm"]: (r["size"], r["passed"], r["place"]) for r in sized.collect()} == {"4b-y": ("4b", True, 1), "4b-x": ("4b", True, 2), "4b-z": ("4b", True, None)}
    assert rounds.confirm("same", parent, parent, {"samples": 20, "confirm": {"last": {"panels": {"all": {}}, "criteria": [{"left": "all.acc.delta", "op": ">=", "right": 0}]}}}, "last").first()["passed"]
    assert {r["line"] for r in rounds.table(report).collect() if r["line"].startswith("all.acc")} == {"all.acc +0.0 [+0.0, +0.0]"}


def test_spec_problems():
    assert rounds.analyse(SPEC) == [] and rounds.analyse({}) == ["no panels"]
    bad = {"panels": {"a": {"sources": ["x"], "exclude_sources": ["x"], "odd": 1}}, "criteria": [{"left": "b.acc.delta", "op": "=", "right": None}, {"left": ["a.acc.delta"], "op": ">", "right": "a.ece.lower"}], "rank": [{"path": "a.x.delta"}]}
    assert len(rounds.analyse(bad)) == 8
    assert len(rounds.moves_with_temperature(SPEC)) == 1


def test_validated_context(spark):
    make = lambda ok: spark.createDataFrame([(lo, hi, 0.1 if g else -0.1, True) for (lo, hi), g in zip(((0, 8192), (8192, 16384), (16384, 32768), (32768, 65536)), ok)], "lo long, hi long, lower double, complete boolean")
    assert [rounds.validated_context(make(x), 0.0).first()[0] for x in ((1, 1, 0, 1), (1, 1, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1))] == [16384, 65536, 65536, 8192]  # the interval of the base itself says nothing
    assert rounds.validated_context(make((1, 1, 1, 1)).withColumn("complete", F.col("lo") > 0), 0.0).first()[0] == 8192


def test_closure(spark):
    parts = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "c"), ("x", "y")], "suite string, component string")
    assert sorted(map(tuple, rounds.closure(parts).collect())) == [("b", "a"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c"), ("x", "y")]
