"""The fingerprint query's edited texts and likenesses, with repeated and null doc_ids, and learners on an empty table."""

import hashlib

from pyspark.sql import functions as F

from gaugeworks.llm import fingerprints, language_id, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, edited string"


def jaccard(a, b):
    """Generalised Jaccard similarity of two texts' words."""
    import collections

    x, y = collections.Counter(a.split()), collections.Counter(b.split())
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 1.0


def test_the_query_edits_and_compares_neighbours(spark, tmp_path):
    many = " ".join(f"w{k % 150} common" for k in range(400))
    rows = [(1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, many), (6, many + " more"), (7, "éß 文字 x"), (7, "seven again"), (9, "odd"), (None, "none"), (12, " ".join(f"z{k}" for k in range(300)))]
    spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op8_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    order = [12, 9, 7, 6, 5, 4, 3, 2, 1, None]
    for r in got:
        i = r["doc_id"]
        if i == 7 or order[(order.index(i) + 1) % len(order)] == 7:
            continue  # of rows alike in doc_id either may be the next
        own, near = texts[i][0], texts[order[(order.index(i) + 1) % len(order)]][0]
        half = len(own) // 2
        edited = own[: len(own) - half] + near[:half]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(own) > 500:
            assert abs(r["near_edited"] - jaccard(own, edited)) < 0.25 and abs(r["near_next"] - jaccard(own, near)) < 0.25
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["edited_fingerprint"] == r["fingerprint"]) if edited == own else True
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[2] != prints[9] and prints[3] == prints[4] == "" and sorted(r["doc_id"] or 0 for r in got).count(7) == 2


def test_learners_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for of, columns in ((language_id.op5_language_id, {"doc_id", "held_out", "lang_pred", "score"}), (quality.op7_quality, {"doc_id", "held_out", "score", "predicted"})):
        df = of(spark, str(tmp_path))
        assert columns <= set(df.columns) and df.count() == 0
    assert fingerprints.op8_fingerprints(spark, str(tmp_path)).select(F.col("doc_id")).count() == 0
