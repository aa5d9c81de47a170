"""What only shows on larger tables than the tests', on small made-up ones: queries against their SQL, steps against a plain programme."""

import math

import duckdb
from pyspark.sql import functions as F

from gaugeworks.plans.registry import ORACLE_SQL, QUERIES


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL on tables (rows, schema) written to folder."""
    db = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(folder))
    cur = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = [tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall()]
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def test_hundredths_are_those_of_the_double(spark, tmp_path):
    """0.285 as a double is below the half, whatever its decimal text says."""
    first = lambda p: [math.log(p / ((1 - p) / 9)) / 10] + [0.0] * 63
    rows = [(3 * k, first(p), 1) for k, p in enumerate((0.285, 0.285, 0.28, 0.28, 0.29))]
    got, want = both(spark, tmp_path, "a22_describe", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert got == want and want[0][want[0].index("t0") + 1] == 5
    assert 4 in want[0]


def test_a_call_polled_twice_is_one_attempt(spark, tmp_path):
    """The number of an adopted call (a million above its event's) is an event's own number too."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(n, at + datetime.timedelta(hours=n % 1000), 7, "click", 0.5, "{}") for n in (3, 1_000_003, 6, 1_000_006, 2_000_003, 45, 1_000_045)]
    got, want = both(spark, tmp_path, "e08_next_attempts", events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    assert got == want and len({r[0] for r in got}) == len(got)


def test_resamples_by_blocks_are_the_draws_one_by_one(spark, monkeypatch):
    """Blocks of a few clusters, sums that some clusters lack, a stratum without a name."""
    from gaugeworks.operators import paired

    monkeypatch.setattr(paired, "BLOCK_CELLS", 8)
    rows = [(f"k{n % 2}", None if n == 40 else f"s{n % 3}", n // 2, float(n), n if n % 4 == 0 else None) for n in range(41)]
    df = spark.createDataFrame(rows, "k string, source string, grp long, x double, y long")
    got = {(r["k"], r["b"]): (r["x"], r["y"]) for r in paired.resampled(df, {"x": F.col("x"), "y": F.col("y")}, 37, ["k"]).collect()}
    sums = {}
    for k, source, grp, x, y in rows[:40]:
        a, b = sums.setdefault((k, source), {}).get(grp, (0, None))
        sums[k, source][grp] = (a + x, b if y is None else (b or 0) + y)
    want = {}
    for (k, _), groups in sums.items():
        own, n = [groups[g] for g in sorted(groups)], len(groups)
        for b in range(37):
            drawn = [own[(((b * 1000003 + slot * 7919 + 17) * 48271) % 2147483647 * 16807) % 2147483647 % n] for slot in range(n)]
            x, y = want.get((k, b), (0, None))
            more = [v for _, v in drawn if v is not None]
            want[k, b] = (x + sum(v for v, _ in drawn), y if not more else (y or 0) + sum(more))
    assert got == want


def test_best_documents_are_the_same_in_any_number_of_parts(spark, monkeypatch):
    from gaugeworks.operators import text_search

    docs = spark.createDataFrame([(k, " ".join(f"word{(k * j) % 13}" for j in range(1, 3 + k % 9))) for k in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"word{k} word{k + 3} word{k}") for k in range(8)], "item_id long, text string")
    want = sorted(map(tuple, text_search.bm25(docs, items, 3).collect()))
    monkeypatch.setattr(text_search, "PART_PAIRS", 40)  # parts of a few documents, and a join by shuffle where terms are more
    assert sorted(map(tuple, text_search.bm25(docs, items, 3).collect())) == want and len(want) == 24


def test_lines_are_written_as_they_come(tmp_path):
    """A task's lines are in its file before the last one is made, and a task that fails leaves none."""
    import os

    import pytest
    from pyspark.sql.types import Row

    from gaugeworks.sources import scored

    seen = []

    def lines(fails):
        for k in range(30_000):
            yield Row(request_sha256=f"{k}" * 20, id=str(k), answers=None, error="a b", latency_ms=float("nan") if fails and k == 29_000 else 1.0)
        seen.extend(os.path.getsize(tmp_path / "lines" / f) for f in os.listdir(tmp_path / "lines"))

    w = scored._Writer(str(tmp_path))
    done = w.write(lines(False))
    assert seen and seen[0] > 1 << 20
    w.commit([done])
    r = scored._Reader(str(tmp_path), [])
    got = [x for part in r.partitions() for x in r.read(part)]
    assert done.lines == len(got) == 30_000 and got[-1][1] == "29999" and got[0][3] == "a b"
    with pytest.raises(ValueError):
        w.write(lines(True))
    assert len(os.listdir(tmp_path / "lines")) == 1
