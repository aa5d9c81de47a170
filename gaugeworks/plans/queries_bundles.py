"""Review files made of documents; their words stand for tokens, their sources for companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import bundles as B
from gaugeworks.plans.registry import query

#: A bucket's tokens and the most that a target has (fixed values); files of a bucket; depths.
SIZES, FILES, DEPTHS, SEED = ((4096, 3100), (8192, 6500), (16384, 6500), (32768, 6500), (65536, 6500)), 24, (0.1, 0.5, 0.9), "bundle"


def pool(spark, sf):
    """One document a doc_id, the text with runs of blanks and of empty lines collapsed."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t]+\\n", "\n"), "[ \\t]{2,}", " "), "\\n{3,}", "\n\n")
    d = d.select(F.col("doc_id").alias("id"), F.col("source").alias("company"), F.btrim(text, F.lit(" \n\t")).alias("text"))
    return d.groupBy("id").agg(F.min(F.struct("company", "text")).alias("_d")).select("id", F.concat(F.lit("Document "), F.col("id").cast("string")).alias("title"), "_d.company", "_d.text")


@query("o18_review_files")
def review_files(spark, sf):
    """Files of five lengths around a target at three depths, filled from all documents of other sources."""
    docs = pool(spark, sf)
    out = B.bundles(docs, B.draws(docs, SIZES, FILES, DEPTHS, SEED), SEED)
    return out.select("draw", F.col("id").alias("doc_id"), "bucket", "depth", "documents", "excerpts", F.sha2("state", 256).alias("state_sha256"), "state_tokens", "target_depth", "accepted")
