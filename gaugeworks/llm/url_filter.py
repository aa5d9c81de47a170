"""URL filters (11): association rules of URL tokens, mined from labels by FP-growth, matched by an inverted index. DataFrame functions only.

Host and path: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; the path is what follows it up to ``?``, ``#`` or the end.
A null url, or one without ``://``, has neither (both empty) and no tokens.

Written rules (verdict, host, path) fit their host and all its subdomains, where the url's path starts with the rule's; of those that fit, the longest (host and path together) decides, then the one
of the longer host, then ``block``. Where none fits, the learned rules decide: a url that holds all tokens of a learned rule is blocked, any other is allowed.

Tokens of a url are its whole host, the words of its host's labels, its path's parts (lowered, runs of digits as 0) and the names in its query, each once.

Learning: a page whose page_id is a doc_id of labels with quality 0 or toxic 1 is one to block, another labelled page one to allow (a label given twice counts if either says block; a null in both says
nothing). A rule is a set of tokens whose pages to block are at least ``support`` of all labelled ones and ``least_pages``, whose confidence is at least ``confidence``, and no part of which is a rule as confident. All of them are found: a
page gives every token that enough pages to block have (no other can be in a rule). Tokens of the very same pages (by two 64-bit hashes) are one item, so the host's words and its own parts, which always come together, make no combinations
with each other; Spark's FP-growth mines the items with the label, and a rule of items then stands for each choice of one token of each. ``most_rules`` may ask for the most confident only; without it there is no bound.

Matching: every rule stands in the index under its rarest token, as its key. Up to ``INDEXED`` rules the index is an array of buckets by hash, one value made by a scalar subquery, and judging a page looks up the buckets of
the page's tokens and tests the few rules there: one projection without a shuffle, so no host is a hot key. More rules are joined with the pages' tokens on the key.

Repeated rows give repeated results, a null page_id stays one, other columns are ignored, and an empty table on either side works: without labelled pages there are no learned rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import ASCII_LOWER, ASCII_UPPER, written

#: The dealt rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT, LEAST_PAGES, CONFIDENCE = 0.001, 10, 0.5
#: Rules up to which the index is one value; written rules at most.
INDEXED, MOST_WRITTEN = 5_000, 100_000
BLOCK = "=block"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens, each with the kind of its place before it."""
    of = host(url)
    parts = lambda text, at, kind: F.transform(F.filter(F.split(F.regexp_replace(F.lower(text), r"[0-9]+", "0"), at), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    names = F.regexp_replace(query, r"(?s)=[^&]*", "")
    whole = F.filter(F.array(F.concat(F.lit("host "), of)), lambda x: x != "host ")
    return F.array_distinct(F.concat(whole, parts(of, r"[^\p{L}\p{N}]+", "word "), parts(path(url), "/", "part "), parts(names, "&", "name ")))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad, of the pages whose page_id has a label."""
    said = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    marks = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg((F.max(said) == 1).alias("bad"))
    return pages.select(F.col("page_id").alias("doc_id"), F.col("url").cast("string").alias("url")).join(marks, "doc_id").select("url", "bad")


def _classes(each: DataFrame, least: float) -> DataFrame:
    """item, tokens, n: the tokens (page, bad, token) that at least least pages to block have; those of the same pages are one item, named by the first of them."""
    page = lambda seed: F.sum(F.xxhash64("page", F.lit(seed)).cast("decimal(38,0)"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), page(1).alias("h1"), page(2).alias("h2")).where(F.col("bad") >= least)
    return counts.groupBy("n", "bad", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.get("tokens", F.lit(0)).alias("item"), "tokens", "n")


def mined(urls: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES, confidence: float = CONFIDENCE, most_tokens: int | None = None, most_rules: int | None = None) -> DataFrame:
    """key, items, confidence, pages: the rules that lead to block, learned from urls (url, bad); of at most most_tokens tokens, and the most_rules most confident, where these are given."""
    from pyspark.ml.fpm import FPGrowth

    spark, none = urls.sparkSession, "key string, items array<string>, confidence double, pages long"
    pages = written(urls.select(F.monotonically_increasing_id().alias("page"), "bad", tokens(F.col("url")).alias("tokens")), "url-pages")
    n = pages.count()
    if not n:
        return spark.createDataFrame([], none)
    least = max(least_pages, support * n)
    each = pages.select("page", "bad", F.explode("tokens").alias("token"))
    classes = written(_classes(each, least), "url-tokens")
    baskets = each.join(classes.select(F.col("item").alias("token"), "item"), "token").groupBy("page", "bad").agg(F.collect_list("item").alias("item"))
    items = F.concat("item", F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>")))
    model = FPGrowth(itemsCol="items", minSupport=(math.ceil(least) - 0.5) / n, minConfidence=confidence).fit(written(baskets.select(items.alias("items")), "url-baskets"))
    rules = model.associationRules.where((F.size("consequent") == 1) & F.array_contains("consequent", BLOCK))
    if most_tokens is not None:
        rules = rules.where(F.size("antecedent") <= most_tokens)
    rules = written(rules.select(F.monotonically_increasing_id().alias("rule"), F.array_sort("antecedent").alias("items"), "confidence", F.round(F.col("support") * n).cast("long").alias("pages")), "url-rules")
    of = classes.select(F.col("item").alias("token"), "tokens", "n")
    known = rules.select("rule", F.explode("items").alias("token")).join(of, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("key"), F.collect_list(F.struct(F.col("token").alias("item"), "tokens")).alias("parts"))
    rules = written(rules.join(known, "rule"), "url-keyed")
    # a rule whose tokens include all of another's that is as confident adds nothing
    wide = rules.select(F.col("rule").alias("_rule"), F.col("key").alias("token"), F.col("items").alias("_items"), F.col("confidence").alias("_confidence"))
    held = rules.select("rule", "items", "confidence", F.explode("items").alias("token")).join(wide, "token")
    idle = held.where((F.size("_items") < F.size("items")) & (F.size(F.array_except("_items", "items")) == 0) & (F.col("_confidence") >= F.col("confidence"))).select("rule").distinct()
    # the rarest item's token comes first and is the key
    rarest = lambda p: p["item"] == F.col("key")
    parts = F.concat(F.filter("parts", rarest), F.filter("parts", lambda p: ~rarest(p)))
    chosen = F.aggregate(F.transform(parts, lambda p: p["tokens"]), F.array(F.array().cast("array<string>")), lambda made, ts: F.flatten(F.transform(made, lambda m: F.transform(ts, lambda t: F.concat(m, F.array(t))))))
    rules = rules.join(idle, "rule", "left_anti").select(F.explode(chosen).alias("items"), "confidence", "pages")
    rules = rules.select(F.get("items", F.lit(0)).alias("key"), F.array_sort("items").alias("items"), "confidence", "pages")
    return written(rules if most_rules is None else rules.orderBy(F.desc("confidence"), F.desc("pages"), "items").limit(most_rules), "url-learned")


def _buckets(n: int) -> int:
    return 1 << max(4, n.bit_length())


def _place(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def index(rules: DataFrame, buckets: int) -> Column:
    """An array of buckets by the hash of key, each an array of its rules: a scalar subquery."""
    filled = rules.groupBy(_place(F.col("key"), buckets).alias("at")).agg(F.collect_list(F.struct(*rules.columns)).alias("rules"))
    kind = filled.schema["rules"].dataType
    every = rules.sparkSession.range(buckets).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("rules", F.array().cast(kind)).alias("rules")))), lambda b: b["rules"])).scalar()


def found(keys: Column, table: Column, buckets: int) -> Column:
    """The rules of the index whose key is among keys (distinct ones)."""
    return F.flatten(F.transform(keys, lambda k: F.filter(F.get(table, _place(k, buckets)), lambda r: r["key"] == k)))


def _looked_up(df: DataFrame, learned: DataFrame, buckets: int) -> DataFrame:
    """df with n_learned and confidence (the greatest) of the rules that hold, by the index."""
    df = df.withColumn("learned", index(learned, buckets))
    whole = F.filter(found(F.col("tokens"), F.col("learned"), buckets), lambda r: F.size(F.array_except(r["items"], F.col("tokens"))) == 0)
    return df.withColumn("fits", F.transform(whole, lambda r: r["confidence"])).withColumn("n_learned", F.size("fits")).withColumn("confidence", F.array_max("fits"))


def _joined(df: DataFrame, learned: DataFrame) -> DataFrame:
    """_looked_up() by a join on the key, for any number of rules."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "url-judged")
    each = rows.select("_row", "tokens", F.explode("tokens").alias("key")).join(learned.select("key", "items", F.col("confidence").alias("_fit")), "key")
    fits = each.where(F.size(F.array_except("items", "tokens")) == 0).groupBy("_row").agg(F.count("*").cast("int").alias("n"), F.max("_fit").alias("confidence"))
    return rows.join(fits, "_row", "left").withColumn("n_learned", F.coalesce("n", F.lit(0))).drop("_row", "n")


def judged(pages: DataFrame, learned: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_learned, confidence: n_learned rules fit, the most confident of them with this confidence (null without one)."""
    spark, own = pages.sparkSession, [(v, h.lower(), p) for v, h, p in rules]
    if len(own) > MOST_WRITTEN or any(v not in ("allow", "block") or not h for v, h, _ in own):
        raise ValueError(f"rules are at most {MOST_WRITTEN}, allow or block, each with a host")
    written_rules = spark.createDataFrame(own, "verdict string, key string, path string")
    own_buckets, n_learned = _buckets(len(own)), learned.count()
    url = F.col("url").cast("string")
    # what is used more than once is a column of its own, so nothing is computed twice
    df = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"), index(written_rules, own_buckets).alias("own"))
    levels = max((h.count(".") + 1 for _, h, _ in own), default=0)
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, levels + 1)])) if own else F.array().cast("array<string>")
    fit = F.filter(found(suffixes, F.col("own"), own_buckets), lambda r: F.startswith(F.col("path"), r["path"]))
    length = lambda r: F.struct((F.length(r["key"]) + F.length(r["path"])).alias("n"), F.length(r["key"]).alias("h"), r["verdict"].alias("verdict"), F.concat(r["key"], r["path"]).alias("rule"))
    df = df.withColumn("best", F.array_max(F.transform(fit, length))).drop("own")
    df = _joined(df, learned) if n_learned > INDEXED else _looked_up(df, learned, _buckets(n_learned))
    verdict = F.coalesce("best.verdict", F.when(F.col("n_learned") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return df.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "n_learned", "confidence")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, mined(labelled(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
