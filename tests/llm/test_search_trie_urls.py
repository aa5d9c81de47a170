"""URL filters, ranked search and the conversation trie against brute force, on small made-up rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import lexical_search, prefix_trie, url_filter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- ranked search


def by_hand(docs, items, top):
    """docs (doc_id, text), items (item_id, text): the contract, term by term."""
    terms = lambda t: [w.translate(LOWER) for w in TERM.findall(t or "")]
    rows = [(i, collections.Counter(w), len(w)) for i, t in docs for w in [terms(t)] if w]
    n_docs, n_terms = len(rows), sum(n for _, _, n in rows)
    df = collections.Counter(w for _, c, _ in rows for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in rows:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if gone else i, -s) for k, (s, gone, i) in enumerate(sorted(scored)[:top])]
    return out


def texts(n, seed=3, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß文") for _ in range(r.randint(1, 3))) for _ in range(words)] + ["İx", "A1", "k"]
    return [" ".join(r.choice(vocabulary).upper() if r.random() < 0.2 else r.choice(vocabulary) for _ in range(r.choice([1, 3, 10, 40]))) + r.choice(["", "!", "_-"]) for _ in range(n)]


def test_search_is_the_ranking_by_hand(spark):
    rows = [(k, t) for k, t in enumerate(texts(150))]
    rows += [(900, None), (901, ""), (902, " .!_ "), (903, "k " * 30_000), (None, "k A1"), (None, "k A1"), rows[3], rows[3], *[(1000 + k, rows[5][1]) for k in range(20)]]
    items = [(k, t) for k, t in enumerate(texts(12, seed=4))] + [(50, None), (51, ""), (52, "nowhere"), (None, "k"), (53, "k k K a1"), (53, "k k K a1")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, term string").repartition(3)
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for kwargs in ({}, {"shard_postings": 50}, {"block_chars": 100}):
        got = lexical_search.search(docs, bench, top=7, **kwargs)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows, items, 7), key=key)


def test_search_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(docs, bench).count() == 0
    assert lexical_search.search(some, bench).count() == 0
    assert lexical_search.search(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_a_shard_stops_early_and_never_wrongly():
    """Exact beside a full sort, and lists are not read to their ends where the threshold allows it."""
    import numpy as np

    r = np.random.default_rng(1)
    n_docs, n_terms = 3000, 30
    doc = np.repeat(np.arange(n_docs), 5)
    term = np.concatenate([np.sort(r.choice(n_terms, 5, replace=False)) for _ in range(n_docs)])
    impact = r.integers(0, 1000, len(doc)) ** 2
    tie = r.permutation(n_docs)
    shard = lexical_search.Shard(doc, term, impact, n_docs, n_terms, tie)
    looked = []
    scores = shard.scores
    shard.scores = lambda docs: looked.append(len(docs)) or scores(docs)
    for terms in ([1], [2, 3], [4, 5, 6, 7], list(range(n_terms))):
        want = np.zeros(n_docs, np.int64)
        np.add.at(want, doc, np.where(np.isin(term, terms), impact, 0))
        order = np.lexsort((tie, -want))[:10]
        best, score = shard.top(np.array(terms), 10)
        assert best.tolist() == order.tolist() and score.tolist() == want[order].tolist()
    assert looked[0] <= 64  # one list: its first round holds the answer
    assert not shard.met.any() and not shard.wanted.any()


# -- conversation trie


def trie_by_hand(rows):
    """rows (conv_id, turn, role, text): the contract, node by node."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, ms in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in ms if len(built[c]) == len(node))))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def talks(n=60, seed=5, deep=12):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.choice([1, 1, 2, 3, 5, deep])):
            rows.append((c, turn, r.choice(["user", "tool"]) if turn == 1 else "user", r.choice(["a b", "a  b\tc", "x"]) if turn < 4 else "y"))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_trie_is_the_tree_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    rows = talks() + [(200, None, None, None), (200, 0, "user", None), (201, None, "user", ""), (201, None, "user", "zz"), (None, 1, "user", "lost"), (200, 0, "user", None), (-3, 0, "user", "x"), (-3, 1, None, "é ß"), (4000, 0, "user", "only")]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]
    df = spark.createDataFrame([(*x, 7, "z") for x in rows], "conv_id long, turn long, role string, text string, depth int, at string").repartition(3)
    own = prefix_trie.turns(df)
    got = prefix_trie.trie(*prefix_trie.rebuilt(own))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == trie_by_hand(rows)


def test_trie_without_rebuilding_and_of_one_deep_chain(spark):
    rows = [(c, t, "u", "w w") for c in (5, 9) for t in range(40)] + [(9, 40, "u", "end")]
    own = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(map(tuple, prefix_trie.trie(own, own.groupBy("conv_id").agg(F.max("at").alias("length"))).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [5] * 41 + [9] and got[41][2] == 5 and got[0][6] == 80 and {r[5] for r in got} == {1}


def test_trie_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(empty)))
    assert got.columns[-1] == "ends_sha256" and got.count() == 0


# -- URL filters

URLS = [
    None, "", "no scheme/x", "://", "http://", "https://A.Org", "https://a.ORG/", "https://org/x?y#z", "ftp://x.example.org/es/1", "http://example.org/es", "http://notexample.org/es/", "http://example.org/en/12", "http://example.org/en/2",
    "http://x.com/fr/?a", "http://x.com/de/", "http://com/de/", "http://x.com/DE/", "http://a.b.c.com:80/de/", "x://y://z.org/q", "http://x.org#/es/", "http://x.org?a=/es/", "http://a.com\n/de/\nx", "http://é.org/é", "http://" + "a." * 5000 + "org/" + "z/" * 5000,
]


def rule_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, None))


def test_written_rules_and_parts(spark):
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(URLS)] + [(None, URLS[7], "h", 1)] * 2, "page_id long, url string, host string, fits int")
    none = url_filter.mined(spark.createDataFrame([], "url string, bad boolean"))
    got = url_filter.judged(pages, none).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = rule_by_hand(URLS[7 if r["page_id"] is None else r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), r
    assert url_filter.judged(pages.limit(0), none).count() == 0
    assert {r["rule"] for r in url_filter.judged(pages, none, rules=()).collect()} == {None}
    with pytest.raises(ValueError):
        url_filter.judged(pages, none, rules=[("block", "", "/")])


def rules_by_hand(rows, support, least_pages, confidence):
    """rows (tokens, bad): every combination of tokens that leads to block."""
    least = max(least_pages, support * len(rows))
    counts = collections.Counter(frozenset(c) for ts, _ in rows for k in range(1, len(ts) + 1) for c in itertools.combinations(sorted(ts), k))
    bad = collections.Counter(frozenset(c) for ts, b in rows if b for k in range(1, len(ts) + 1) for c in itertools.combinations(sorted(ts), k))
    kept = {c: bad[c] / counts[c] for c in counts if bad[c] >= least and bad[c] / counts[c] >= confidence}
    return {c: v for c, v in kept.items() if not any(d < c and kept[d] >= v for d in kept)}


def test_rules_are_all_combinations_that_hold(spark):
    r = random.Random(2)
    rows = []
    for k in range(400):
        url = f"http://{r.choice(['free', 'my'])}-{r.choice(['bets', 'news'])}.example.{r.choice(['net', 'org'])}/{r.choice(['en', 'de'])}/{k}"
        bad = ("free-bets" in url and r.random() < 0.9) or ("net/de" in url and r.random() < 0.7) or r.random() < 0.1
        rows.append((url, bad))
    urls = spark.createDataFrame(rows, "url string, bad boolean")
    token_rows = [(set(x["t"]), x["bad"]) for x in urls.select(url_filter.tokens(F.col("url")).alias("t"), "bad").collect()]
    rules = url_filter.mined(urls, support=0.02, least_pages=5, confidence=0.6, most_tokens=20)
    got = {frozenset(x["items"]): x["confidence"] for x in rules.collect()}
    want = rules_by_hand(token_rows, 0.02, 5, 0.6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and any(len(k) > 1 for k in want)
    judged = url_filter.judged(spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string"), rules, rules=())
    for x in judged.collect():
        fits = [c for c in want if c <= token_rows[x["page_id"]][0]]
        assert (x["verdict"], x["n_learned"]) == ("block" if fits else "allow", len(fits))
        assert x["confidence"] == (pytest.approx(max(want[c] for c in fits)) if fits else None)
    few = url_filter.mined(urls, support=0.02, least_pages=5, confidence=0.6, most_rules=3)
    assert few.count() <= 3


def test_rules_of_wide_pages_are_all_there(spark, monkeypatch):
    """More telling tokens than twelve a page: those that say least are in rules too. Any number of rules is judged."""
    r = random.Random(8)
    rows = []
    for k in range(300):
        bad = r.random() < 0.5
        site = "site-" + "-".join(chr(97 + j) * 2 for j in range(14)) if bad else "other"
        rows.append((f"http://{site}.net/{'a/' if bad and r.random() < 0.4 else ''}{'b/' if r.random() < 0.5 else ''}x", bad))
    urls = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = [set(x[0]) for x in urls.select(url_filter.tokens(F.col("url"))).collect()]
    rules = url_filter.mined(urls, support=0.02, least_pages=5, confidence=0.5)
    got = {frozenset(x["items"]): x["confidence"] for x in rules.collect()}
    alone = {t: (sum(b and t in ts for ts, (_, b) in zip(tokens, rows)), sum(t in ts for ts in tokens)) for t in set().union(*tokens)}
    want = {frozenset([t]): b / n for t, (b, n) in alone.items() if b >= 6 and b / n >= 0.5}
    assert {k: v for k, v in got.items() if len(k) == 1} == pytest.approx(want) and len(want) > 15 and frozenset(["part a"]) in got
    pages = spark.createDataFrame([(k % 5, u) for k, (u, _) in enumerate(rows)] * 2 + [(None, None)], "page_id long, url string")
    looked_up = sorted(map(str, url_filter.judged(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "INDEXED", 3)
    assert sorted(map(str, url_filter.judged(pages, rules).collect())) == looked_up


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "u://a"), (2, "u://b"), (3, "u://c"), (4, None), (None, "u://d"), (1, "u://e")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 1, 0), (3, None, None), (4, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_filter.labelled(pages, labels).collect()), key=str) == sorted([("u://a", True), ("u://e", True), ("u://b", False), (None, True)], key=str)


def test_tokens(spark):
    get = lambda u: set(spark.createDataFrame([(u,)], "u string").select(url_filter.tokens(F.col("u"))).first()[0])
    assert get("https://M.ads-track.Example.com/EN/12/a.html?page=2&ref=x&page=3#top") == {"host m.ads-track.example.com", "word m", "word ads", "word track", "word example", "word com", "part en", "part 0", "part a.html", "name page", "name ref"}
    assert get(None) == get("nothing") == set()
