"""Queries that group documents into padded passes and batches; a document's characters stand for its tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import packing
from gaugeworks.plans.registry import query

CAP = 32


def _padded(n: int, steps: int = 8, floor: int = 16) -> int:
    step = max(floor, (1 << (n - 1).bit_length()) // steps)
    return -(-n // step) * step



@query(
    "o13_length_passes",
    f"""WITH RECURSIVE s AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) AS j, CAST(ceil(n / step) AS BIGINT) * step AS pad
 FROM (SELECT *, greatest(16, (1 << CASE WHEN n = 1 THEN 0 ELSE length(bin(n - 1)) END) // 8) AS step FROM (SELECT source, doc_id, greatest(1, length(coalesce(text, ''))) AS n FROM documents))),
dp AS (SELECT source, CAST(0 AS BIGINT) AS j, [{{'c': CAST(0 AS BIGINT), 'p': CAST(0 AS BIGINT)}}] AS w FROM (SELECT DISTINCT source FROM documents)
 UNION ALL SELECT source, j, list_prepend({{'c': b.c, 'p': b.p}}, w[1:{CAP - 1}]) FROM
 (SELECT dp.source, s.j, w, list_min(list_transform(w, lambda x, k: {{'c': x.c + greatest(256, {[_padded(k, 4, 1) for k in range(1, CAP + 1)]}[k] * pad), 'k': -k, 'p': x.p + 1}})) AS b FROM dp JOIN s ON s.source = dp.source AND s.j = dp.j + 1))
SELECT source, max(j) AS items, arg_max(w[1].p, j) AS passes, arg_max(w[1].c, j) AS tokens FROM dp GROUP BY source""",
)
def length_passes(spark, sf):
    """Each source's documents in passes of at most 32: how many, and their padded tokens, the least possible."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "source", F.length(F.coalesce("text", F.lit(""))).alias("length"))
    placed = packing.length_passes(docs, CAP, ["source"])
    each = placed.groupBy("source", "pass_end").agg(F.first("pass_items").alias("n"), F.first("pass_tokens").alias("tokens"))
    return each.groupBy("source").agg(F.sum("n").alias("items"), F.count("*").alias("passes"), F.sum("tokens").alias("tokens"))


def _records(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select(F.col("doc_id").alias("id"), F.md5(F.col("doc_id").cast("string")).alias("shuffled"), (F.col("doc_id") % 3 + 1).cast("int").alias("rows"), F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).alias("longest"))
    return packing.numbered(docs, [], ["shuffled", "id"])


@query("o12_balanced_steps")
def balanced_steps(spark, sf):
    """An epoch of all documents in the order of a hash: 8 records a micro-batch, 4 micro-batches a step, 4 ranks."""
    return packing.balanced_steps(_records(spark, sf), 8, 4, 4)


@query("o12_budget_passes")
def budget_passes(spark, sf):
    """The micro-batches of the epoch, each in passes of at most 16,384 padded tokens."""
    records = _records(spark, sf)
    plan = packing.balanced_steps(records, 8, 4, 4).where("copy = 0").select("step", "micro", "rank", "id")
    rows = plan.join(records.select(F.col("id").cast("string").alias("id"), "rows", "longest"), "id")
    return packing.budget_passes(rows, ["step", "micro", "rank"], 16_384)
