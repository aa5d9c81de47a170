"""Queries over whole tables, on small made-up rows, against brute force."""

import collections
import datetime
import random

from pyspark.sql import functions as F

from gaugeworks.operators import generate
from gaugeworks.plans import queries_reports, queries_suite, queries_traces


def test_components_all_orders(spark, tmp_path):
    """Against union-find; no order key is a multiple of 40, and each links."""
    r = random.Random(7)
    rows = [(40 * k + r.randrange(1, 40), r.randrange(300)) for k in range(220)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for o, c in rows:
        a, b = root(c), root(o % 500 + 1000000)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in queries_suite.connected(spark, str(tmp_path)).collect()}
    assert got == {x: root(x) for x in parent} and len(set(got.values())) > 5


def test_release_candidates_all_orders(spark, tmp_path):
    """No order key is 1 modulo 17; the failing gates and the second seeds are among the others."""
    r = random.Random(8)
    rows = [(17 * k + r.randrange(2, 17), r.randrange(80), r.choice("OFOFOFP"), r.uniform(15_000, 90_000)) for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for o, c, status, price in rows:
        seeds, good = want.get(c, (set(), True))
        want[c] = seeds | {o % 4}, good and status != "P" and price > 20_000
    got = {x["recipe"]: (x["seeds"], x["candidate"]) for x in queries_reports.release_candidates(spark, str(tmp_path)).collect()}
    assert got == {c: (len(s), good and len(s) >= 2) for c, (s, good) in want.items()} and len({v[1] for v in got.values()}) == 2


def test_business_days_all_orders(spark, tmp_path):
    """No order key is 1 modulo 10; days around the holiday, a month's ends, and none."""
    days = [datetime.date(1995, 12, 10) + datetime.timedelta(k) for k in range(40)] + [datetime.date(1998, 8, k) for k in (14, 15, 16)] + [None]
    rows = [(10 * k + 2 + k % 8, d and datetime.datetime(d.year, d.month, d.day, 13)) for k, d in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for o, at in rows:
        due, left, months = at and at.date(), 5, None
        while at and left:
            due += datetime.timedelta(1)
            left -= due.weekday() < 5 and due != datetime.date(1995, 12, 25)
        if at:
            months = (1998 - at.year) * 12 + 8 - at.month - (at.day > 15)
        want[o] = due, months
    assert {x["o_orderkey"]: (x["due"], x["months"]) for x in queries_traces.business_days(spark, str(tmp_path)).collect()} == want


def test_containment_screen_common(spark, tmp_path):
    """Twins, a passage of 50 items and one of 51, items of 9 and 10 grams, an item left with 9: against the reference's rule in plain Python."""
    name = lambda part, n: [f"{part}{j}" for j in range(n)]
    twin, fifty, more = name("twin", 30), name("fifty", 20), name("more", 20)
    items = [twin, twin, *[fifty + name(f"f{k}_", 5) for k in range(50)], *[more + name(f"m{k}_", 30) for k in range(50)], more + name("left", 9), name("nine", 16), name("ten", 17)]
    records = [twin, fifty, more, more + name("left", 9), name("m7_", 30), name("nine", 16), name("ten", 17), twin[:19], twin[:18], name("other", 40)]
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(records)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    grams = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    sets = {k: grams(w) for k, w in enumerate(items) if len(grams(w)) >= 10}
    seen = collections.Counter(g for s in sets.values() for g in s)
    sets = {k: {g for g in s if seen[g] <= 50} for k, s in sets.items()}
    shares = {(d, k): len(grams(w) & s) / len(s) for d, w in enumerate(records) for k, s in sets.items() if len(s) >= 10}
    want = {x: round(v, 6) for x, v in shares.items() if v >= 0.5}
    got = {(x["doc_id"], x["item_id"]): x["containment"] for x in queries_suite.containment_screen(spark, str(tmp_path)).collect()}
    assert got == want and {(0, 0), (0, 1), (6, 104)} <= set(got) and max(seen.values()) == 51 and not {d for d, _ in got} & {2, 3, 5}


def test_buried_fills_the_budget(spark):
    """More than 32 texts, one without a pool, and the greedy choice over the whole pool in plain Python."""
    r = random.Random(9)
    texts = {"a": [f"{k:04d}" for k in range(300)], "b": [f"{k:03d}" + "x" * r.choice([0, 1, 5, 30, 90, 200, 2000]) for k in range(400)]}
    pool = spark.createDataFrame([(s, t) for s, ts in texts.items() for t in ts], "source string, text string")
    order = {x["text"]: x["h"] for x in pool.select("text", F.xxhash64(F.lit(3), "text").alias("h")).collect()}
    records = [("1", "a", "NEEDLE"), ("2", "b", "NEEDLE"), ("3", "b", "N" * 700), ("4", "none", "NEEDLE"), ("5", None, "NEEDLE")]
    got = {x["id"]: (x["n"], x["state"].split("\n\n")) for x in generate.buried(spark.createDataFrame(records, "id string, source string, state string"), pool, 1000, seed=3).collect()}
    for i, source, state in records:
        taken, used = [], len(state)
        for t in sorted(texts.get(source, []), key=order.get):
            if used + len(t) <= 1000:
                taken.append(t)
                used += len(t)
        n, parts = got[i]
        assert n == len(taken) and parts.count(state) == 1 and [x for x in parts if x != state] == taken
    assert got["1"][0] == 248 and len(got) == 5
