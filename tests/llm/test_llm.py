"""The training-data operators against brute force, on small made-up rows: nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import bytescan, decontaminate, fingerprints, language_id, licenses, mixing, ngram_join, quality, repeats, token_files, warc
from gaugeworks.llm.shared import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, tokens string, key string"
SYLLABLES = "an ber chu do éa fi go hü im jo ka li".split()


def made(seed=1, n=60):
    """Random documents with exact and near copies, nulls, empties, repeated rows, a very long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    rows = []
    for k in range(n):
        text = " ".join(word() + r.choice(["", "", ".", ",", "\n"]) for _ in range(r.choice([1, 3, 4, 5, 30, 120])))
        rows.append([k, text])
    for k in range(15):
        base = rows[r.randrange(n)][1].split(" ")
        for _ in range(1 if len(base) > 25 else 0):
            base[r.randrange(len(base))] = word()
        rows.append([n + k, " ".join(base)])
    rows += [[900, None], [901, ""], [902, " \n "], [903, "ÉCOLE"], [904, "12 34 !!"], [905, "lang " * 30_000], [None, "kein Name hier"], rows[3], rows[3], [906, rows[5][1]], [907, rows[5][1].upper()]]
    return [(i, t, ("en", "de", None)[k % 3], ("a", "b", "c", None)[k % 4], len(t or ""), "x", "y", "z") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for shard_ids in (token_files.SHARD_IDS, 100):
        files = token_files.write_shards(docs, block=64, shard_ids=shard_ids)
        got = [tuple(r) for r in token_files.token_digests(docs, block=64, shard_ids=shard_ids).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert files.where("number > 3").count() > 0
    # rows of one doc_id over several shards
    twin = spark.createDataFrame([(5, f"the text {k}", "clash") for k in range(40)] + [(4, "a", "x"), (6, "b", "x")], "doc_id long, text string, start string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.token_digests(twin, shard_ids=8).collect())
    assert [g[1] for g in got] == [4] + [5] * 40 + [6] and [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got[:-1]]).tolist()
    assert token_files.token_digests(empty(spark)).collect() == []


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, 1000) == ids).all()


def test_token_file_random_access(tmp_path):
    import pyarrow as pa

    docs = [np.arange(k, k + n, dtype=np.uint32) for k, n in ((0, 5), (9, 0), (3, 300), (1, 64))]
    (tmp_path / "x").write_bytes(token_files.shard_bytes([4, None, 7, 9], docs, 9, 64))
    s = token_files.Shard(pa.OSFile(str(tmp_path / "x")))
    assert s.doc_ids == [4, None, 7, 9]
    assert all((s.doc(k) == d).all() for k, d in enumerate(docs))
    assert s.ids(70, 75).tolist() == np.concatenate(docs)[70:75].tolist()
    with pytest.raises(ValueError):
        token_files.shard_bytes([1], [np.array([512], np.uint32)], 9)


def test_encoder_is_the_tokenizer(monkeypatch):
    e = token_files.Encoder(token_files.tokenizer_path())
    texts = ["It's 12,5 o'clock.,", "ÀÉ straße. Σας,", "<|endoftext|> a", "x.y z..", "", "don't can't.", "été.   a\x0bb\x1cc", "x" * 500 + " the end."]
    # every letter of every script: alone, capital and small, before and after others, with a full stop
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha()]
    step = 997
    texts += [f"{x}{letters[(k * 7) % len(letters)]} a{x}b. {x.upper()}{x},{x} {x}." for k, x in enumerate(letters) if k % 11 == 0 or k < 3000]
    r = random.Random(4)
    texts += ["".join(r.choice(letters[:2500] + list("abc .,'")) for _ in range(40)) for _ in range(300)]
    monkeypatch.setattr(token_files, "KEPT_BYTES", 50_000)  # words go through both generations
    for text in texts + texts[::step]:
        assert e(text).tolist() == e._plain(text), text


def test_warc(spark):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a/1", big, "x"), (2, "http://a/2", big, "x"), (9, None, big, "x"), (None, "http://a b", big, "x"), (3, "http://a", "short", "x"), (4, "http://a", "short", "x"), (5, "u", None, "x"), (6, "u", "", "x"), (9, "twin", big, "x")]
    rows += [(100 + k, f"http://b/{k}", "<html>" + f" word{k % 7}" * 300 + str(k), "x") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = warc.read_archives(warc.write_archives(pages), payloads=True).collect()
    assert len(got) == len(rows)
    for r in got:
        html = {x[0]: x[2] for x in rows}[r["page_id"]] or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        revisit = html == big and r["page_id"] != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else html.encode())
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


def test_warc_file_has_a_leading_dictionary_and_single_frames():
    import io

    import zstandard

    records = [warc.record_bytes(k, f"http://x/{k}", b"<html>" + b"hello world %d " % k * 40, hashlib.sha1(b"").hexdigest(), None) for k in range(200)]
    data, offsets = warc.archive_bytes(records)
    assert data[:4] == warc.SKIPPABLE and int.from_bytes(data[4:8], "little") > 0
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : offsets[0]]))
    assert d.decompressobj().decompress(data[offsets[150] :]) == records[150]
    assert list(warc.read_archive(io.BytesIO(data))) == records


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_licenses(spark):
    apache = licenses.TEMPLATES[1][0]
    texts = ["Under the\nMIT-License, under the mit license", "mit license the under", "x " * 500 + apache.upper() + " y" * 300, "Apache License, Version 2.0; CC BY-NC", None, "", " ".join(licenses.TEMPLATES[0][0].split()[:15]), "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for k, t in enumerate(texts):
        w = words(t)
        places = {(p, label) for phrase, label in licenses.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()}
        at = [p for p, _ in places]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == sorted({x for _, x in places})
    assert got[2]["labels"] == ["apache-2"] and got[6]["labels"] == [] and got[7]["labels"] == ["gpl-3"]
    assert licenses.license_scan(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, texts[0], "x"), (1, texts[0], "y"), (1, texts[0], "y"), (2, "word " * 60_000 + texts[0], "z")], "doc_id long, text string, labels string")
    assert sorted(((r["doc_id"], r["n_base"], ",".join(r["labels"])) for r in licenses.license_scan(odd).collect()), key=str) == [(1, 2, "mit")] * 2 + [(2, 2, "mit"), (None, 2, "mit")]
    assert got[3]["labels"] == ["apache-2", "cc-by-nc"]


def test_license_join_is_exact():
    r = random.Random(5)
    vocabulary = [f"w{k}".encode() for k in range(40)]
    for _ in range(60):
        templates = [licenses.Template(tuple(r.choice(vocabulary) for _ in range(r.randint(2, 9))), str(k), False, 0.7) for k in range(4)]
        text = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        order = {w: (text.count(w), w) for w in vocabulary}
        got = {(k, at) for k, at, _ in licenses.Join(templates, order).matches(text)}
        want = {(k, at) for k, t in enumerate(templates) for at in range(max(1, len(text) - t.block + 1)) if len(t.tokens & set(text[at : at + t.block])) >= 0.7 * len(t.tokens) - 1e-9}
        assert got == want


def sets_of(text):
    w = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", w)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def reached(ids, pairs):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("in_family,hot", [(2_000_000, None), (20, None), (300_000, 2)])
def test_jaccard_groups(spark, docs, in_family, hot):
    rows = [(r["doc_id"], sets_of(r["text"])) for r in docs.collect()]
    pairs = [(a, b) for a, x in rows for b, y in rows if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = reached({a for a, _ in rows if a is not None}, pairs)
    got = ngram_join.jaccard_groups(docs, in_family=in_family, hot=hot).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter((a, len(x), want.get(a)) for a, x in rows)
    assert ngram_join.jaccard_groups(empty(spark)).collect() == []


def test_one_of_each_group(docs):
    kept = ngram_join.one_of_each_group(docs)
    groups = {r["component_id"] for r in ngram_join.jaccard_groups(docs).collect()}
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(groups, key=str)


def test_repeated_ids_are_compared_text_by_text(spark):
    a, b = " ".join(f"a{k}" for k in range(100)), " ".join(f"b{k}" for k in range(1000))
    rows = [(7, a), (7, b), (7, b + " "), (9, a + " tail"), (8, b + " tail"), (5, "alone it stands here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("twin", F.lit(1)).withColumn("_rows", F.lit(2))
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_groups(df).collect()}
    assert got == {(7, 7), (9, 7), (8, 7), (5, 5)}
    kept = ngram_join.one_of_each_group(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], len(r["text"].split())) for r in kept.collect()) == [(5, 5), (7, 100), (7, 1000)]


def test_join_family_sides():
    keys = [np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint64)] * 2
    for side, want in ((None, [(3, 8)]), (np.array([0, 1]), [(3, 8)]), (np.array([1, 1]), [])):
        assert ngram_join.join_family([8, 3], np.array([8, 8]), [2, 2], keys, side) == want


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40) if k % 9] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(7, None), (500, 500)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e]
    assert got == reached({x for e in real for x in e}, real)


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    odd = spark.createDataFrame(made(), SCHEMA)
    r = {x["text"]: x for x in language_id.predict(odd.select("doc_id", "text"), model).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()}
    assert [r[t]["lang_pred"] for t in (None, "", " \n ", "12 34 !!")] == ["und"] * 4
    assert r["ÉCOLE"]["lang_pred"] != "und"
    kept = language_id.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert [x["lang_pred"] for x in language_id.predict(odd, language_id.fit(empty(spark))).collect()] == ["und"] * odd.count()
    got = docs.select("doc_id", "lang").join(language_id.op5_language_id(spark, sf), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in language_id.op5_language_id(spark, sf).collect())


def test_quality(spark, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op7_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0.3) == (got["quality"] == 1)).mean() > 0.95
    docs = spark.createDataFrame(made(), SCHEMA)
    model = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels, sample=100, epochs=1)
    scores = [r["score"] for r in quality.predict(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.predict(docs, None).collect()} == {0.5}
    assert quality.predict(empty(spark), None).collect() == [] and quality.fit(empty(spark), labels) is not None
    twice = labels.union(labels).withColumn("text", F.lit("clash"))
    again = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), twice, sample=200, epochs=1)
    assert again[1] == model[1] and (again[0] == model[0]).all()


def test_quality_features_are_words_and_runs_of_characters():
    texts = [t for _, t, *_ in made() if t is not None] + ["日本語 é", "a"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    table = np.random.default_rng(3).normal(size=1 << 12).astype(np.float32)
    got = quality.scores(table, 0.2, data, at, 12)

    def bucket(points):
        h = 0
        for c in points:
            h = (h * 0x01000193 + ord(c) + 1) % (1 << 32)
        return (h * 2654435761 % (1 << 32)) >> 20

    def word(w):
        return sum((b + 1) * pow(quality._STEP, k, 1 << 64) for k, b in enumerate(w)) * 0xC2B2AE3D27D4EB4F % (1 << 64) >> 52

    for k, t in enumerate(texts):
        if len(t) > 5000:
            continue
        ids = [bucket(t[p : p + n]) for n in (3, 4, 5) for p in range(len(t) - n + 1)] + [word(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        z = 0.2 + (float(np.mean(table[ids])) if ids else 0.0)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
        u, share = quality.features(np.frombuffer(t.encode(), np.uint8), 12)
        assert dict(zip(u.tolist(), (share * len(ids)).round().astype(int).tolist())) == collections.Counter(ids)


def test_quality_training_is_plain_gradient_descent():
    """The folded table after two steps against the same steps written out."""
    examples = [(np.array([1, 3], np.uint32), np.array([0.25, 0.75], np.float32), 1), (np.array([3], np.uint32), np.array([1.0], np.float32), 0)]
    table, bias = quality.train(lambda epoch: iter(examples), 2, bits=3, dim=2, epochs=1, rate=0.5)
    v = np.random.default_rng(11).uniform(-0.5, 0.5, (8, 2)).astype(np.float32).astype(float)
    w, b = np.zeros((2, 2)), np.zeros(2)
    for step, (ids, share, label) in enumerate(examples):
        rate, h = 0.5 * (1 - step / 2), share @ v[ids]
        p = np.exp(h @ w + b) / np.exp(h @ w + b).sum() - np.eye(2)[label]
        grad = np.outer(share, w @ p) * len(ids) ** 0.5
        w_, b = w - rate * np.outer(h, p), b - rate * 0.1 * p
        v[ids] -= rate * grad
        w = w_
    assert table == pytest.approx((v @ w)[:, 1] - (v @ w)[:, 0], abs=1e-5) and bias == pytest.approx(b[1] - b[0], abs=1e-6)


def test_language_vectors_and_votes():
    """Vectors against n-grams counted one by one, and the votes of one-versus-one machines against a loop."""
    texts = ["Ab c", "", "é1x", "zz zz"]
    data, at = np.frombuffer(b"".join(t.encode() for t in texts), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = language_id.vectors(data, at, 12)
    for k, t in enumerate(texts):
        low = bytes(language_id.LETTERS[b] for b in t.encode())
        n = np.zeros(1 << 12)
        for size in (1, 2, 3):
            for p in range(len(low) - size + 1):
                h = 0
                for b in low[p : p + size]:
                    h = (h * 257 + b + 1) % (1 << 32)
                n[(h * 2654435761 % (1 << 32)) >> 20] += 1
        want = np.sqrt(n) / max(np.linalg.norm(np.sqrt(n)), 1e-9)
        assert got[k] == pytest.approx(want, abs=1e-6)
    rng = np.random.default_rng(1)
    m = language_id.OneVersusOne(["a", "b", "c"], [(0, 1), (0, 2), (1, 2)], rng.normal(size=(5, 3)).astype(np.float32), np.zeros(3))
    x = rng.normal(size=(200, 5)).astype(np.float32)
    best, score = m.predict(x)
    for k in range(200):
        margin = x[k] @ m.weights
        votes, total = [0] * 3, [0.0] * 3
        for (a, b), v in zip(m.pairs, margin):
            votes[a if v >= 0 else b] += 1
            total[a] += float(np.clip(v, -1, 1))
            total[b] -= float(np.clip(v, -1, 1))
        assert best[k] == max(range(3), key=lambda c: (votes[c], total[c])) and 0 <= score[k] <= 1


def test_every_language_is_learned(spark):
    """300 languages, each with a letter pair of its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k * 10 + j, f"{letters[k % 26]}{letters[k // 26]}q " * 8, f"l{k:03d}") for k in range(60) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, per_language=5)
    assert sorted(c.removeprefix("own:") for c in model.families.classes) == sorted({r[2] for r in rows})
    assert language_id.predict(spark.createDataFrame([], df.schema), model).collect() == []
    kept = language_id.accepted(df.union(spark.createDataFrame([(1, None, None), (2, "12", None)], df.schema)), None)
    assert kept.count() == df.count()


@pytest.mark.parametrize("span,gram", [(20, 8), (200, 64)])
def test_repeats(spark, docs, span, gram):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    count = collections.Counter(t[p : p + span] for _, t in rows for p in range(len(t) - span + 1))
    want = collections.Counter()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - span + 1):
            if count[t[p : p + span]] > 1:
                gone[p : p + span] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want[i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.remove_repeats(docs, span, gram).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert collections.Counter(tuple(r)[:5] for r in repeats.remove_repeats(docs, span, gram, at_once=4).collect()) == want
    assert repeats.remove_repeats(empty(spark), span, gram).collect() == []


def test_suffix_sort():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 300):
        group, text = rng.integers(0, max(1, n // 5), n), rng.integers(0, 2, (n, 12)).astype(np.uint8)
        order, shared = repeats.suffix_sort(group, text)
        key = lambda r: (group[r], text[r].tobytes())
        assert [key(r) for r in order] == sorted(map(key, range(n)))
        for a, b, s in zip(order, order[1:], shared[1:]):
            assert s == (-1 if group[a] != group[b] else next((q for q in range(12) if text[a, q] != text[b, q]), 12))


def brute_print(text):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long_hash = lambda x, seed: xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed)
    parted, best = collections.Counter(), {}
    for w, n in collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", text)).items():
        x = xxhash.xxh64_intdigest(w.encode(), 42)
        for i in range(n):
            k = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), long_hash(x, 42)) & 63
            parted[k, k << 58 | x >> 6] += 1
    for (k, x), n in parted.items():
        p, q = (xxhash.xxh64_intdigest((s).to_bytes(4, "little"), long_hash(x, 42)) for s in (1, 2))
        u = lambda h, s: (((h >> s) & 0xFFFFFF) + 0.5) / (1 << 24)
        r, c = -np.log(u(p, 40) * u(p, 16)), np.log(-np.log(u(q, 40) * u(q, 16)))
        b = ((p & 0xFFFF) * 256 + (q & 0xFF) + 0.5) / (1 << 24)
        t = int(np.floor(np.log(n) / r + b))
        rank = (int(np.floor((min(max(c - r * (t - b + 1), -63), 63) + 64) * (1 << 25))), long_hash(t, signed(long_hash(x, 42)) % (1 << 64)) & 0xFFFF)
        best[k] = min(best.get(k, rank), rank)
    return [(k << 16) | best[k][1] for k in sorted(best)]


def test_fingerprints(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["text"]: r["print"] for r in fingerprints.with_fingerprint(rows, "text", "print").collect()}
    assert all(v == brute_print(k) for k, v in got.items())


def test_fingerprint_likeness_estimates_jaccard(spark):
    r = random.Random(9)
    words_ = [f"w{k}" for k in range(3000)]
    rows, truth = [], []
    for k in range(60):
        a = [r.choice(words_) for _ in range(400)]
        b = a[: 5 * k + 50] + [r.choice(words_) for _ in range(350 - 5 * k)]
        x, y = collections.Counter(a), collections.Counter(b)
        truth.append(sum((x & y).values()) / sum((x | y).values()))
        rows.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "x"), "b", "y")
    got = [v[0] for v in df.orderBy("k").select(fingerprints.likeness(F.col("x"), F.col("y"))).collect()]
    assert abs(np.mean(np.array(got) - truth)) < 0.03 and np.sqrt(np.mean((np.array(got) - truth) ** 2)) < 0.09


def test_op8_likeness_is_unbiased_under_skewed_counts(spark, tmp_path):
    """near_next of rows 2k + 1 and 2k: a heavy shared word, heavy differing words, half of a heavy word."""
    name = lambda k, part, n: [f"{part}{k}_{j}" for j in range(n)]
    kinds = [lambda k: (["the"] * 100 + name(k, "a", 100), ["the"] * 100 + name(k, "b", 100)), lambda k: (name(k, "s", 100) + [f"x{k}"] * 400, name(k, "s", 100) + [f"y{k}"] * 400), lambda k: (name(k, "s", 100) + [f"x{k}"] * 400, name(k, "s", 100) + [f"x{k}"] * 200)]
    for n, (kind, want) in enumerate(zip(kinds, (1 / 3, 1 / 9, 3 / 5))):
        pairs = [kind(k) for k in range(60)]
        assert all(abs(sum((collections.Counter(a) & collections.Counter(b)).values()) / sum((collections.Counter(a) | collections.Counter(b)).values()) - want) < 1e-9 for a, b in pairs)
        spark.createDataFrame([(2 * k + m, " ".join(pair[1 - m])) for k, pair in enumerate(pairs) for m in (0, 1)], "doc_id long, text string").write.parquet(str(tmp_path / f"{n}/documents.parquet"))
        got = [r["near_next"] for r in fingerprints.op8_fingerprints(spark, str(tmp_path / str(n))).collect() if r["doc_id"] % 2]
        assert len(got) == 60 and abs(np.mean(got) - want) < 0.04


@pytest.mark.parametrize("in_group", [2, 7, 1000])
def test_next_rows(spark, docs, in_group):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    order = sorted(rows.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["_tie"]))
    want = collections.Counter((a["doc_id"], a["text"], b["text"]) for a, b in zip(order, [*order[1:], order[0]]))
    got = fingerprints.with_next(rows, ["text"], in_group).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["next_text"]) for r in got) == want


def test_op8_edges(spark, tmp_path):
    spark.createDataFrame([(7, "one only text")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = fingerprints.op8_fingerprints(spark, str(tmp_path)).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 13
    spark.createDataFrame([(1, None), (2, ""), (3, "a b c d")], "doc_id long, text string").write.parquet(str(tmp_path / "b/documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op8_fingerprints(spark, str(tmp_path / "b")).collect()}
    assert got[1]["fingerprint"] == "" and got[2]["near_next"] == 1.0 and got[3]["near_next"] == 0.0
    empty(spark).write.parquet(str(tmp_path / "c/documents.parquet"))
    assert fingerprints.op8_fingerprints(spark, str(tmp_path / "c")).collect() == []


def test_decontamination(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    long_ = words(max(texts.values(), key=lambda t: len(set(t.split()))))
    items = [("x", " ".join(long_[10:35])), ("y", "Kein, NAME hier!"), ("z", None), (None, "kein"), ("w", "..."), ("v", "nothing like it anywhere in these")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for chars in (decontaminate.BLOCK_CHARS, 20):
        for r in decontaminate.contamination(docs, bench, block_chars=chars).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            w = words(r["text"])
            hit, found = set(), set()
            for item, text in items:
                t = words(text)
                for k in range(max(1, len(t) - 9) if t and item else 0):
                    g = t[k : k + 10]
                    for p in range(len(w) - len(g) + 1):
                        if w[p : p + len(g)] == g:
                            hit.update(range(p, p + len(g)))
                            found.add(item)
            assert r["n_words"] == len(w) and sum(s["to_word"] - s["from_word"] for s in r["spans"]) == len(hit) and r["items"] == sorted(found)
            for s in r["spans"]:
                assert words(r["text"][s["from_char"] : s["to_char"]]) == w[s["from_word"] : s["to_word"]]
        clean = decontaminate.without_contaminated(docs, bench, block_chars=chars)
        dirty = decontaminate.contamination(docs, bench).where("size(spans) > 0").count()
        assert clean.columns == docs.columns and dirty > 0 and clean.count() == docs.count() - dirty
    assert decontaminate.contamination(empty(spark), bench).collect() == []
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_words > 0 and size(spans) = 0 and size(items) = 0").count() == decontaminate.contamination(docs, bench.limit(0)).where("n_words > 0").count()
    assert decontaminate.char_spans("é, Ab-c", [(0, 2), (2, 3)]) == [(0, 5), (6, 7)]


def allocate(sizes, weights, total, most):
    """Brute force: give by weight, set what is over its bound to it, and give the rest again."""
    out, free = {}, list(range(len(sizes)))
    while free:
        per = (total - sum(out.values())) / sum(weights[k] for k in free)
        over = [k for k in free if per * weights[k] > most * sizes[k]]
        out |= {k: most * sizes[k] for k in over} if over else {k: per * weights[k] for k in free}
        free = [k for k in free if k not in out]
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_mixing(spark, docs, chunk):
    got = mixing.copies(docs, chunk=chunk).toPandas()
    rows = docs.collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter(zip(got["size"], got["source"].fillna("~"))) == collections.Counter((size(r["text"]), r["source"] or "~") for r in rows)
    got["source"] = got["source"].fillna("\U0010ffff")
    by = got.assign(taken=got["copies"] * got["size"]).groupby("source").agg(target=("target", "first"), size=("source_size", "first"), real=("size", "sum"), taken=("taken", "sum"), most=("size", "max")).sort_index()
    assert by["target"].tolist() == pytest.approx(allocate(by["real"].tolist(), [5, 2, 1, 5], 1.5 * got["size"].sum(), 2))
    assert (by["size"] == by["real"]).all() and ((by["taken"] - by["target"]).abs() <= by["most"]).all() and got["copies"].max() <= 2
    # a document's copies are its expectation, rounded down or up
    expected = got["target"] / got["source_size"]
    some = got["size"] > 0
    assert ((got["copies"] >= np.floor(expected - 1e-9)) & (got["copies"] <= np.ceil(expected + 1e-9)))[some].all()
    names = ["key", "also", "number"]
    assert (mixing.copies(docs, chunk=chunk).toPandas().sort_values(names)["copies"].values == got.sort_values(names)["copies"].values).all()
    out = mixing.mixed(docs, chunk=chunk)
    assert out.columns == docs.columns
    want = got.groupby(["key", "also"])["copies"].sum()
    keyed = out.select(*(k.alias(n) for k, n in zip(mixing.row_key(out), names))).toPandas().groupby(names[:2]).size()
    assert keyed.to_dict() == want[want > 0].to_dict()
    assert mixing.copies(empty(spark)).collect() == [] and mixing.mixed(empty(spark)).collect() == []


def test_mixing_keeps_ids_and_other_columns(spark):
    """Ids over 2**53 beside a null one, columns with the names that the operator uses, a null text and a null source that only swap."""
    big = (1 << 60) + 1
    rows = [(big + k, "w " * (k + 1), "s", k, 70 + k, "a", 1) for k in range(8)] + [(None, "w w", "s", 9, 99, "b", 2), (3, "t", None, 1, 2, "c", 3), (3, None, "t", 3, 4, "d", 4)]
    rows += [(4, "same text", "s", k, k, "twin", 5) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy long, key long, order string, _key long")
    got = mixing.copies(df)
    ids = collections.Counter(r["doc_id"] for r in got.collect())
    assert ids == collections.Counter(r[0] for r in rows)
    out = mixing.mixed(df).collect()
    assert len(out) == sum(r["copies"] for r in got.collect()) and {tuple(r) for r in out} <= set(rows)
    taken = {}
    for r in got.collect():
        taken[r["doc_id"], r["size"]] = taken.get((r["doc_id"], r["size"]), 0) + r["copies"]
    size = lambda t: len((t or "").split())
    assert collections.Counter((r["doc_id"], size(r["text"])) for r in out) == {k: v for k, v in taken.items() if v}
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, out))


@pytest.mark.parametrize("sizes,weights,share", [([100, 100, 100], [5, 2, 1], 1.5), ([10, 10], [1, 1], 2.0), ([], [5, 2, 1], 1.5), ([1, 50, 7, 900, 3, 3], [5, 2, 1], 1.5), ([0, 0], [5, 2, 1], 1.5)])
def test_targets_stop_at_twice_the_size(spark, sizes, weights, share):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.with_targets(df, weights, share, 2.0).orderBy("source").collect()]
    assert got == pytest.approx(allocate(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share * sum(sizes), 2.0))


def test_pivot_keeps_expectations():
    n, totals = 2000, np.zeros(5)
    sizes, rest = [50.0, 9.0, 8.0, 8.0, 7.0], [0.3, 0.5, 0.7, 0.2, 0.9]
    for seed in range(n):
        mine = list(rest)
        mixing.settle_dominant(list("abcde"), sizes, mine, seed, 0)
        got, left = mixing.pivot(list("abcde"), sizes, mine, seed, 0)
        assert sum(s * (mine[k] if k == left else got[k]) for k, s in enumerate(sizes)) == pytest.approx(sum(s * x for s, x in zip(sizes, rest)))
        totals += [mine[k] if k == left else got[k] for k in range(5)]
    assert np.abs(totals / n - rest).max() < 0.05


def test_word_hashes_tell_words_apart():
    data, at = bytescan.text_buffer(__import__("pyarrow").array(["Ab c", None, "ab", " x\ty ", "c ab"]))
    h, n = bytescan.word_hashes(data, at)
    assert n.tolist() == [2, 0, 1, 2, 2] and h[0] == h[2] == h[6] and h[1] == h[5] and len(set(h.tolist())) == 4


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = {}
    for name, f in p.STAGES:
        docs = p.written(f(spark, docs, sf), "test")
        stages[name] = docs
    assert [d.columns for d in list(stages.values())[:-1]] == [spark.read.parquet(f"{sf}/documents.parquet").columns] * 4
    lang, one, clean, mix, last = stages.values()
    assert one.count() == ngram_join.jaccard_groups(lang).select("component_id").distinct().count()
    assert decontaminate.contamination(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(spans) > 0").count() == 0
    assert last.count() == mix.count() and last.where("n_tokens < 1").count() == 0
    assert sorted(map(tuple, p.run(spark, sf).collect())) == sorted(map(tuple, last.collect()))
