"""Review files against a plain programme that builds every slot's file."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from gaugeworks.operators import bundles as B

COUNT = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))


def unit(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def file_of(blocks):
    n, out, starts = len(blocks), "", []
    out = f"Review file: {n} documents, in no particular order.\n\n"
    for k, (title, text, part) in enumerate(blocks, 1):
        out += f"===== Document {k} of {n}: {title}{B.EXCERPT if part else ''} =====\n"
        starts.append(len(out))
        out += text + f"\n===== End of document {k} =====\n\n"
    return out.rstrip() + "\n", starts


def plain(docs, draw, id_, bucket, depth, seed, reach):
    by = {d[0]: d for d in docs}
    order = sorted(docs, key=lambda d: (hashlib.sha256(f"{seed}|ring|{d[0]}".encode()).hexdigest(), d[0]))
    at, places = 0, []
    for d in order:
        places.append((at, d))
        at += COUNT(d[3] or "") + 30
    start, total = int(unit(seed, draw) * at), at
    span = min(int(bucket * reach), total)
    follow = sorted((((a - start) % total), d) for a, d in places)
    target = by[id_]
    fill = int(bucket * 0.86 + unit(seed, draw, id_) * (bucket * 0.93 - 64 - bucket * 0.86))
    used, chosen = COUNT(target[3]) + 40, []
    for rel, d in follow:
        if rel >= span or d[0] == id_ or d[2] == target[2]:
            continue
        text, n = d[3] or "", COUNT(d[3] or "") + 30
        if used + n <= fill:
            chosen.append((d[1] or "", text, False))
            used += n
        else:
            if fill - used >= 300:
                paragraphs, kept = text.split("\n\n"), None
                for k in range(1, len(paragraphs) + 1):
                    if COUNT("\n\n".join(paragraphs[:k])) <= fill - used - 30:
                        kept = "\n\n".join(paragraphs[:k])
                if kept:
                    chosen.append((d[1] or "", kept, True))
            break
        if fill - used < 300:
            break
    if not chosen:
        return None
    best = None
    for slot in range(len(chosen) + 1):
        state, starts = file_of([*chosen[:slot], (target[1] or "", target[3], False), *chosen[slot:]])
        away = abs((starts[slot] + len(target[3]) / 2) / len(state) - depth)
        if best is None or away < best[0]:
            best = (away, state, starts[slot])
    _, state, begin = best
    tokens = COUNT(state)
    return (len(chosen) + 1, sum(p for *_, p in chosen), state, tokens, round(COUNT(state[: begin + len(target[3]) // 2]) / tokens, 4), int(bucket * 0.80) <= tokens <= int(bucket * 0.93))


def test_files_are_those_of_a_plain_programme(spark, monkeypatch):
    monkeypatch.setattr(B, "STRETCH", 900)
    monkeypatch.setattr(B, "BLOCK", 11)
    r = random.Random(5)
    text = lambda: "\n\n".join(" ".join(r.choice(["one", "Zwei", "três", "4"]) for _ in range(r.randint(1, 90))) for _ in range(r.randint(1, 9)))
    docs = [(k, r.choice([f"T{k}", f"a long title {k}", None]), r.choice(["hot", "hot", "x", "y", None]), text()) for k in range(90)]
    docs += [(100, "null", "z", None), (101, "empty", "z", ""), (102, "gap", "z", "\n\n\n\nword"), (103, "long", "w", " ".join(["w"] * 5000))]
    df = spark.createDataFrame(docs, "id long, title string, company string, text string")
    drawn = B.draws(df, [(1200, 300), (2600, 400), (6000, 500)], 9, (0.1, 0.5, 0.9), "s")
    for reach in (4.0, 0.3):
        got = {x["draw"]: x for x in B.bundles(df, drawn, "s", reach).collect()}
        seen = 0
        for d in drawn.collect():
            want = plain(docs, d["draw"], d["id"], d["bucket"], d["depth"], "s", reach)
            assert (d["draw"] in got) == (want is not None)
            if want:
                x = got[d["draw"]]
                assert (x["documents"], x["excerpts"], x["state"], x["state_tokens"], x["target_depth"], x["accepted"]) == want
                seen += x["accepted"]
        assert seen > 5 or reach < 1


def test_no_documents_and_no_draws(spark):
    df = spark.createDataFrame([], "id long, title string, company string, text string")
    assert B.bundles(df, B.draws(df, [(1200, 300)], 3, (0.5,), "s"), "s").collect() == []
    one = spark.createDataFrame([(1, "t", "c", "some words")], df.schema)
    assert B.bundles(one, B.draws(one, [(1200, 300)], 3, (0.5,), "s"), "s").collect() == []


def test_cut_keeps_whole_paragraphs(spark):
    rows = spark.createDataFrame([(1, "a b\n\nc d e\n\nf", 5), (2, "a b c", 2), (3, "\n\nx y", 1), (4, "", 9), (5, None, 9)], "id int, text string, room long")
    assert {(x["id"], x["paragraphs"], x["chars"]) for x in B.cut(rows, ["id"]).collect()} == {(1, 2, 10)}
    assert rows.select(F.max(B.words(F.col("text")))).first()[0] == 6
