"""Overlap screens and retrieval over texts, as equi-joins on exploded terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.functions import text as T
from gaugeworks.operators.packing import cut_off


def gram_table(docs: DataFrame, key: str, text: str, size: int = 8) -> DataFrame:
    """key, gram (a 64-bit hash of its words), n (the document's number of grams)."""
    g = docs.select(key, T.gram_hashes(T.word_list(F.col(text)), size).alias("g"))
    return g.select(key, F.size("g").alias("n"), F.explode("g").alias("gram"))


def gram_overlap(records: DataFrame, items: DataFrame, size: int = 8, most_items: int | None = None, least_grams: int = 0) -> DataFrame:
    """doc_id, item_id, shared, jaccard, containment of pairs that share a gram: an inverted-index join.

    Grams travel as 64-bit hashes. Those that more than most_items items have are dropped first (a stop-gram filter on the item side, before the join). The join with the
    items' grams is the first shuffle of the record side (none, where Spark finds the items small enough to broadcast), so only shared grams are ever grouped. Items of fewer than least_grams grams,
    before or after that filter, are left out; before it, they do not count towards most_items.
    """
    r, i = gram_table(records, "doc_id", "text", size), gram_table(items, "item_id", "text", size).where(F.col("n") >= least_grams)
    if most_items is not None:
        rare = i.groupBy("gram").count().where(F.col("count") <= most_items).select("gram")
        i = i.join(rare, "gram")
        i = i.withColumn("n", F.count("*").over(W.partitionBy("item_id"))).where(F.col("n") >= least_grams)
    pairs = r.withColumnRenamed("n", "n_doc").join(i.withColumnRenamed("n", "n_item"), "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.first("n_doc").alias("n_doc"), F.first("n_item").alias("n_item"))
    return pairs.select("doc_id", "item_id", "shared", (F.col("shared") / (F.col("n_doc") + F.col("n_item") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.col("n_item")).alias("containment"))


def overlap_report(records: DataFrame, items: DataFrame, size: int = 8, limit: float = 0.2) -> DataFrame:
    """doc_id, exact, most (greatest Jaccard), offends for each record: exact after normalising, or above the limit."""
    most = gram_overlap(records, items, size).groupBy("doc_id").agg(F.max("jaccard").alias("most"))
    same = items.select(T.digest(F.col("text")).alias("h")).distinct().withColumn("exact", F.lit(True))
    out = records.select("doc_id", T.digest(F.col("text")).alias("h")).join(same, "h", "left").join(most, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("most", F.lit(0.0)).alias("most"))
    return out.withColumn("offends", F.col("exact") | (F.col("most") > limit))


def terms(docs: DataFrame, key: str, text: str, stop: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """key, term, tf, len: words of two characters or more that are no stop words."""
    w = F.filter(T.word_list(F.col(text)), lambda x: (F.length(x) >= 2) & ~x.isin(*stop))
    each = docs.select(key, w.alias("w")).withColumn("len", F.size("w"))
    return each.select(key, "len", F.explode("w").alias("term")).groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


#: Pairs of a document and a query that one part of the documents may make.
PART_PAIRS = 2_000_000


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """item_id, doc_id, score, rank: the k best documents of each query; query terms count once, ties go by doc_id.

    Only terms of queries are kept of the index. Its postings are dealt by doc_id to as many parts as keep each to PART_PAIRS pairs, so a part scores its own documents and
    passes on no more than its k best of each query; no pairs are shuffled, and what a task holds does not grow with the table.
    """
    sizes = docs.select(F.size(F.filter(T.word_list(F.col("text")), lambda x: (F.length(x) >= 2) & ~x.isin(*T.STOP_WORDS))).alias("len"))
    n, mean = sizes.agg(F.count("*"), F.avg("len")).first()
    asked = terms(queries, "item_id", "text").select("item_id", "term")
    parts = 1 + n * asked.agg(F.count_distinct("item_id")).first()[0] // PART_PAIRS
    index = cut_off(terms(docs, "doc_id", "text").join(asked.select("term").distinct(), "term", "left_semi"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = asked.join(df, "term").select("item_id", "term", idf.alias("idf"))
    # small tables of queries go to every part; larger ones are joined by shuffle, and postings dealt afterwards
    wanted = F.broadcast(wanted) if asked.count() <= PART_PAIRS else wanted
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / float(mean or 1.0)))
    scores = index.repartition(parts, "doc_id").join(wanted, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score")).where("score > 0")
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def shared_lines(rows: DataFrame, others: DataFrame, masked: bool = True) -> DataFrame:
    """place (first, last, any), n: distinct lines of rows that others have too, digits masked or not."""
    def table(df: DataFrame) -> DataFrame:
        each = df.select(T.lines(F.col("text")).alias("l")).where("size(l) > 0")
        mask = T.masked_digits if masked else (lambda c: c)
        one = lambda name, c: each.select(F.lit(name).alias("place"), mask(c).alias("line"))
        return one("first", F.get("l", F.lit(0))).union(one("last", F.element_at("l", -1))).union(each.select(F.explode("l").alias("x")).select(F.lit("any").alias("place"), mask(F.col("x")).alias("line"))).distinct()

    return table(rows).intersect(table(others)).groupBy("place").agg(F.count("*").alias("n"))
