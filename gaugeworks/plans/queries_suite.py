"""Queries over documents, labels, benchmark, orders: suite construction, text, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.functions import text as T
from gaugeworks.operators import graph, suite, text_search
from gaugeworks.plans.registry import query

NORM = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
WORDS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')"


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("d01_text_digest", f"SELECT doc_id, sha256({NORM}) AS digest FROM documents")
def text_digest(spark, sf):
    return docs(spark, sf).select("doc_id", T.digest(F.col("text")).alias("digest"))


@query("d05_word_grams", f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 7], ' ') AS g FROM w, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS k) WHERE len(w) >= 8) SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(coalesce(n, 0) AS INTEGER) AS grams FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) USING (doc_id)")
def word_grams(spark, sf):
    w = docs(spark, sf).select("doc_id", T.word_list(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("words"), F.size(T.grams(F.col("w"), 8)).alias("grams"))


GRAMS = f"dw AS (SELECT doc_id, {WORDS} AS w FROM documents), iw AS (SELECT item_id, {WORDS} AS w FROM benchmark), dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 7], ' ') AS g FROM dw, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS k) WHERE len(w) >= 8), ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS g FROM iw, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS k) WHERE len(w) >= 8), dn AS (SELECT doc_id, count(*) AS n FROM dg GROUP BY 1), pr AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN ig USING (g) GROUP BY ALL)"


@query("j20_gram_overlap", f"WITH {GRAMS}, ni AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1) SELECT doc_id, item_id, shared, round(shared / (dn.n + ni.n - shared), 6) AS jaccard, round(shared / ni.n, 6) AS containment FROM pr JOIN dn USING (doc_id) JOIN ni USING (item_id)")
def gram_overlap(spark, sf):
    got = text_search.gram_overlap(docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return got.withColumn("jaccard", F.round("jaccard", 6)).withColumn("containment", F.round("containment", 6))


@query("j21_containment_screen", f"WITH {GRAMS}, i1 AS (SELECT * FROM ig WHERE item_id IN (SELECT item_id FROM ig GROUP BY 1 HAVING count(*) >= 10)), rare AS (SELECT g FROM i1 GROUP BY g HAVING count(*) <= 50), i2 AS (SELECT * FROM i1 WHERE g IN (SELECT g FROM rare)), ni AS (SELECT item_id, count(*) AS n FROM i2 GROUP BY 1 HAVING count(*) >= 10) SELECT doc_id, item_id, round(count(*) / any_value(ni.n), 6) AS containment FROM dg JOIN i2 USING (g) JOIN ni USING (item_id) GROUP BY ALL HAVING count(*) / any_value(ni.n) >= 0.5")
def containment_screen(spark, sf):
    """The bounds of the reference's screen: a gram of more than 50 items is common, items of fewer than 10 grams are left out."""
    got = text_search.gram_overlap(docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), most_items=50, least_grams=10)
    return got.where("containment >= 0.5").select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


@query("d05_overlap_report", f"WITH {GRAMS}, ni AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1), j AS (SELECT doc_id, max(shared / (dn.n + ni.n - shared)) AS most FROM pr JOIN dn USING (doc_id) JOIN ni USING (item_id) GROUP BY 1), b AS (SELECT DISTINCT {NORM} AS t FROM benchmark) SELECT doc_id, b.t IS NOT NULL AS exact, round(coalesce(most, 0), 6) AS most, b.t IS NOT NULL OR coalesce(most, 0) > 0.2 AS offends FROM documents LEFT JOIN b ON b.t = {NORM.replace('text', 'documents.text')} LEFT JOIN j USING (doc_id)")
def overlap_report(spark, sf):
    return text_search.overlap_report(docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")).withColumn("most", F.round("most", 6))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("o10_bm25", f"""WITH d AS (SELECT doc_id, list_filter({WORDS}, lambda x: length(x) >= 2 AND x NOT IN ({STOP})) AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
q AS (SELECT DISTINCT item_id, unnest(list_filter({WORDS}, lambda x: length(x) >= 2 AND x NOT IN ({STOP}))) AS term FROM benchmark), t AS (SELECT doc_id, term, n AS len, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term), s AS (SELECT item_id, doc_id, round(sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN t USING (term) JOIN df USING (term), st GROUP BY item_id, doc_id)
SELECT item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 3""")
def bm25(spark, sf):
    return text_search.bm25(docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), 3).select("item_id", "doc_id", "rank")


@query("d08_shared_lines", "WITH l AS (SELECT source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents), x AS (SELECT source, p, regexp_replace(line, '[0-9]+', '#', 'g') AS line FROM (SELECT source, 'first' AS p, l[1] AS line FROM l WHERE len(l) > 0 UNION ALL SELECT source, 'last', l[-1] FROM l WHERE len(l) > 0 UNION ALL SELECT source, 'any', unnest(l) FROM l)) SELECT p AS place, count(*) AS n FROM (SELECT DISTINCT p, line FROM x WHERE source IN ('src0', 'src1') INTERSECT SELECT DISTINCT p, line FROM x WHERE source IN ('src2', 'src3')) GROUP BY p")
def shared_lines(spark, sf):
    d = docs(spark, sf)
    return text_search.shared_lines(d.where("source in ('src0', 'src1')"), d.where("source in ('src2', 'src3')"))


@query("d12_merged_duplicates", f"WITH x AS (SELECT doc_id, {NORM} AS t, lang FROM documents) SELECT sha256(t) AS h, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS copies FROM x GROUP BY t HAVING count(DISTINCT lang) = 1")
def merged_duplicates(spark, sf):
    return suite.merged_duplicates(docs(spark, sf).withColumn("h", T.digest(F.col("text"))), "h", "lang", "doc_id")


@query("d10_split_problems", f"WITH x AS (SELECT doc_id, source, {NORM} AS t, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS split FROM documents) SELECT 'group in several splits' AS problem, count(*) AS n FROM (SELECT source FROM x GROUP BY source HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'id twice', count(*) FROM (SELECT doc_id FROM x GROUP BY doc_id HAVING count(*) > 1) UNION ALL SELECT 'text twice', count(*) FROM (SELECT t FROM x GROUP BY t HAVING count(*) > 1)")
def split_problems(spark, sf):
    rows = docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("group"), T.digest(F.col("text")).alias("h"), F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("split"))
    return suite.split_problems(rows)


@query("d11_components", "WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey % 500 + 1000000 AS b FROM orders), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM x UNION SELECT x.b, r.c FROM r JOIN x ON r.node = x.a WHERE r.c < x.b) SELECT node, min(c) AS component FROM r GROUP BY node")
def connected(spark, sf):
    """Over every order."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return graph.min_label_components(o.select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_orderkey") % 500 + 1000000).cast("long").alias("b")))


@query("d15_unanimous_votes", "WITH v AS (SELECT o_orderkey AS item, l_linenumber AS judge, CASE WHEN l_quantity > 5 THEN 'yes' WHEN l_quantity > 2 THEN 'no' END AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 3), s AS (SELECT item, count(label) AS n, min(label) AS a, max(label) AS b FROM v GROUP BY item) SELECT item, CASE WHEN n = 3 AND a = b THEN a END AS label, CASE WHEN n = 3 AND a = b THEN 'agreed' ELSE 'split' END AS how FROM s")
def unanimous_votes(spark, sf):
    v = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("item"), F.when(F.col("l_quantity") > 5, "yes").when(F.col("l_quantity") > 2, "no").alias("label"))
    return suite.unanimous(v)


@query("o01_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256('17:' || doc_id) LIMIT 50")
def hash_sample(spark, sf):
    return docs(spark, sf).select("doc_id").orderBy(suite.hash_order(17, F.col("doc_id").cast("string"))).limit(50)


@query("o02_select_unique", f"WITH seen AS (SELECT DISTINCT {NORM} AS t FROM documents WHERE doc_id % 4 = 0), x AS (SELECT doc_id, {NORM} AS t, sha256('3:' || doc_id) AS o FROM documents WHERE doc_id % 4 <> 0) SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY o) AS k FROM x WHERE t NOT IN (SELECT t FROM seen)) WHERE k = 1 ORDER BY o LIMIT 100")
def select_unique(spark, sf):
    d = docs(spark, sf).select("doc_id", T.digest(F.col("text")).alias("h"))
    return suite.select_unique(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0"), 100, suite.hash_order(3, F.col("doc_id").cast("string"))).select("doc_id")


@query("j18_anti_selection", f"WITH x AS (SELECT doc_id, {NORM} AS t FROM documents), v AS (SELECT * FROM x WHERE doc_id % 5 = 0) SELECT count(*) AS n, min(doc_id) AS least FROM (SELECT t, min(doc_id) AS doc_id FROM x WHERE t NOT IN (SELECT t FROM v) AND doc_id NOT IN (SELECT doc_id FROM v) GROUP BY t)")
def anti_selection(spark, sf):
    x = docs(spark, sf).select("doc_id", T.digest(F.col("text")).alias("h"))
    v = x.where("doc_id % 5 = 0")
    left = x.join(v.select("h").distinct(), "h", "left_anti").join(v.select("doc_id"), "doc_id", "left_anti")
    return left.groupBy("h").agg(F.min("doc_id").alias("doc_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("o04_hash_split", "SELECT split, count(*) AS n, sum(doc_id) AS ids FROM (SELECT doc_id, ['train', 'dev', 'test'][1 + (CAST('0x' || right(sha256('9:' || source || ':' || doc_id), 8) AS BIGINT) % 3)] AS split FROM documents) GROUP BY split")
def hash_split(spark, sf):
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    return docs(spark, sf).withColumn("split", suite.hash_split(9, key, ("train", "dev", "test"))).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("o05_balanced_pairs", "WITH x AS (SELECT doc_id AS id, lang, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY lang, y ORDER BY id) AS k FROM x) SELECT a.lang, a.k, a.id AS id_true, b.id AS id_false FROM r a JOIN r b ON a.lang = b.lang AND a.k = b.k AND a.y AND NOT b.y ORDER BY a.k, a.lang LIMIT 20")
def balanced_pairs(spark, sf):
    x = docs(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select(F.col("doc_id").alias("id"), "lang", (F.col("quality") == 1).alias("y"))
    return suite.balanced_pairs(x, "lang", "y", 20, ["id"]).select("lang", "k", "id_true", "id_false")


@query("w5_capped", "SELECT source, count(*) AS n, sum(doc_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 12 GROUP BY source")
def capped(spark, sf):
    return suite.capped(docs(spark, sf), ["source"], 12, ["doc_id"]).groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("w6_round_robin", "SELECT doc_id, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS turn FROM documents) ORDER BY turn, source LIMIT 70")
def round_robin(spark, sf):
    return suite.round_robin(docs(spark, sf), "source", [F.desc("doc_id")], 70).select("doc_id", "turn")


@query("w7_grouped_split", "WITH g AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY min(doc_id), source) AS k FROM documents GROUP BY lang, source) SELECT lang, CASE WHEN k <= 3 THEN 'calibration' ELSE 'train' END AS split, count(*) AS n FROM documents JOIN g USING (lang, source) GROUP BY ALL")
def grouped_split(spark, sf):
    return suite.first_groups(docs(spark, sf), "lang", "source", F.col("doc_id"), 3).groupBy("lang", "split").agg(F.count("*").alias("n"))


@query("o07_quotas", "WITH s AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 GROUP BY source), x AS (SELECT source, n * 137 / sum(n) OVER () AS share FROM s), f AS (SELECT source, share, floor(share) AS fl, 137 - sum(floor(share)) OVER () AS short, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, source) AS k FROM x) SELECT source, CAST(fl + CASE WHEN k <= short THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def quotas(spark, sf):
    return suite.quotas(docs(spark, sf).where("doc_id % 7 <> 0").groupBy("source").agg(F.count("*").alias("n")), "source", "n", 137)


@query("o03_dealt_groups", None)
def dealt_groups(spark, sf):
    w = docs(spark, sf).groupBy(F.col("source").alias("group")).agg(F.count("*").alias("weight"))
    return suite.fill_by_share(w, {"train": 0.7, "dev": 0.1, "test": 0.2}, 5)


@query("o09_cells", "WITH x AS (SELECT doc_id, lang, CASE WHEN n_chars < 1000 THEN 's' WHEN n_chars < 5000 THEN 'm' ELSE 'l' END AS b, row_number() OVER (PARTITION BY lang, CASE WHEN n_chars < 1000 THEN 's' WHEN n_chars < 5000 THEN 'm' ELSE 'l' END ORDER BY doc_id) AS k FROM documents) SELECT lang, b AS bucket, CASE WHEN k <= 2 THEN 'test' WHEN k <= 4 THEN 'dev' ELSE 'train' END AS split, count(*) AS n FROM x WHERE k <= 26 GROUP BY ALL")
def cells(spark, sf):
    bucket = F.when(F.col("n_chars") < 1000, "s").when(F.col("n_chars") < 5000, "m").otherwise("l")
    x = docs(spark, sf).select("doc_id", "lang", bucket.alias("bucket")).withColumn("k", F.row_number().over(W.partitionBy("lang", "bucket").orderBy("doc_id"))).where("k <= 26")
    return x.groupBy("lang", "bucket", F.when(F.col("k") <= 2, "test").when(F.col("k") <= 4, "dev").otherwise("train").alias("split")).agg(F.count("*").alias("n"))


@query("o19_contrast_cases", "WITH x AS (SELECT CAST(vec_id AS VARCHAR) AS id, ['a', 'b', 'c', 'd'] AS keys, CAST(label % 4 AS INTEGER) AS label FROM embeddings), p AS (SELECT id, keys, label, list_transform(list_sort(list_transform(keys, lambda k: sha256('0:' || id || ':' || k) || k)), lambda s: s[65:]) AS perm FROM x) SELECT id || '/none_present' AS id, id AS parent_id, 'none_present' AS variant, array_to_string(list_filter(keys, lambda k: k <> keys[label + 1]), ',') || ',none' AS keys, 3 AS label FROM p UNION ALL SELECT id || '/none_absent', id, 'none_absent', 'a,b,c,d,none', label FROM p UNION ALL SELECT id || '/permuted', id, 'permuted', array_to_string(perm, ','), CAST(list_position(perm, keys[label + 1]) - 1 AS INTEGER) FROM p")
def contrast_cases(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.array(*map(F.lit, "abcd")).alias("keys"), (F.col("label") % 4).cast("int").alias("label"))
    return suite.contrast_cases(x).withColumn("keys", F.array_join("keys", ","))


@query("l10_clean_html", "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')) AS h FROM pages")
def clean_html(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.sha2(T.clean_html(F.col("html")), 256).alias("h"))


@query("l10_cut_at_word", "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(left(text, 80), '[ \\t\\n\\x0b\\f\\r]+[^ \\t\\n\\x0b\\f\\r]*$', '') || ' …' END AS head FROM documents")
def cut_at_word(spark, sf):
    return docs(spark, sf).select("doc_id", T.cut_at_word(F.col("text"), 80).alias("head"))


@query("l13_last_number", "SELECT doc_id, CAST(list_extract(regexp_extract_all(regexp_replace(text, '[$%,]', '', 'g'), '-?[0-9]+(?:\\.[0-9]+)?'), -1) AS DOUBLE) AS number FROM documents")
def last_number(spark, sf):
    return docs(spark, sf).select("doc_id", T.last_number(F.col("text")).alias("number"))


@query("l29_formats", "SELECT o_orderkey AS id, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM orders")
def formats(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), T.slug(F.col("o_orderpriority")).alias("slug"))


@query("a36_suite_summary", "WITH x AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, any_value(n) AS n, min(n_chars) AS least, max(CASE WHEN k = least(n, CAST(floor(n * 0.5) AS BIGINT) + 1) THEN n_chars END) AS q50, max(CASE WHEN k = least(n, CAST(floor(n * 0.95) AS BIGINT) + 1) THEN n_chars END) AS q95, max(n_chars) AS most FROM x GROUP BY lang")
def suite_summary(spark, sf):
    from gaugeworks.operators.metrics import nearest_rank

    d = docs(spark, sf)
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")).join(nearest_rank(d, "n_chars", (0.5, 0.95), ["lang"]), "lang")
