"""A predictor by arithmetic, and prediction rows derived from the ``embeddings`` table, so that every metric has a table to run on (see FIXTURES.md F2).

One row a question: ten options; system A has logits 10 * embedding[0:10], system B those of [10:20]; probabilities are kept to six
decimals, as a stored prediction file would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.probability import softmax


LANGS = ("de", "en", "es", "fr")


def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights from the number of the document; every 17th lacks an answer, every 19th has an option too many, every 23rd is too heavy, every 29th below zero, every 31st is no answer at all."""
    for batch in batches:
        out = []
        for sha, id_, state in zip(batch["request_sha256"], batch["id"], batch["state"]):
            n = json.loads(state)["doc_id"]
            answers = []
            for at, (qid, keys) in enumerate((("lang", list(LANGS)), ("long", ["true", "false"]), ("lines", [str(k) for k in range(5)]))):
                w = [float((n * 7 + k * 3 + at) % 11 + 1) for k in range(len(keys))]
                p = [x / sum(w) for x in w]
                if n % 23 == 0 and at == 1:
                    p = [x * 1.05 for x in p]
                if n % 29 == 0 and at == 2:
                    p[0] = -p[0]
                if n % 19 == 0 and at == 0:
                    keys, p = [*keys, "xx"], [*p, 0.0]
                answers.append({"qid": qid, "keys": keys, "p": p, "logits": None})
            error = "context overflow" if n % 31 == 0 else None
            out.append((sha, id_, answers[:2] if n % 17 == 0 else answers, error, float(n % 100)))
        yield pd.DataFrame(out, columns=["request_sha256", "id", "answers", "error", "latency_ms"])


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cut = lambda at: F.transform(F.slice("embedding", at, 10), lambda x: x.cast("double") * 10)
    kept = lambda z: F.transform(softmax(F.col(z)), lambda x: F.round(x, 6))
    t = t.select(
        F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("long").alias("vec_id"), F.lit("q").alias("question"), F.floor(F.col("vec_id") / 4).alias("grp"),
        F.concat(F.lit("s"), F.col("vec_id") % 5).alias("source"), F.concat(F.lit("t"), F.col("vec_id") % 3).alias("task"), F.lit("clean").alias("variant"),
        F.col("label").cast("int").alias("label"), cut(1).alias("logits"), cut(11).alias("logits_b"), ((F.col("vec_id") * 1733) % 70000).alias("length"),
    )
    return t.withColumn("p", kept("logits")).withColumn("p_b", kept("logits_b"))


#: The same table in DuckDB: ``preds`` with the scored columns of system A (conf, ok, nll, brier) and of B (conf_b, ok_b, nll_b, brier_b).
SQL = """
r0 AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(vec_id AS BIGINT) AS vec_id, 'q' AS question, CAST(vec_id AS BIGINT) // 4 AS grp, 's' || (vec_id % 5) AS source, 't' || (vec_id % 3) AS task, 'clean' AS variant,
  CAST(label AS INTEGER) AS label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10) AS logits, list_transform(embedding[11:20], lambda x: CAST(x AS DOUBLE) * 10) AS logits_b, (CAST(vec_id AS BIGINT) * 1733) % 70000 AS length FROM embeddings),
r1 AS (SELECT *, list_max(logits) AS m, list_max(logits_b) AS mb FROM r0),
r2 AS (SELECT *, list_transform(logits, lambda x: exp(x - m)) AS e, list_transform(logits_b, lambda x: exp(x - mb)) AS eb FROM r1),
r3 AS (SELECT *, list_sum(e) AS s, list_sum(eb) AS sb FROM r2),
r4 AS (SELECT *, list_transform(e, lambda x: round(x / s, 6)) AS p, list_transform(eb, lambda x: round(x / sb, 6)) AS p_b FROM r3),
preds AS (SELECT id, vec_id, question, grp, source, task, variant, label, logits, logits_b, length, p, p_b, list_max(p) AS conf, list_position(p, list_max(p)) - 1 AS pred, list_position(p, list_max(p)) - 1 = label AS ok,
  -ln(greatest(p[label + 1], 1e-9)) AS nll, list_sum(list_transform(p, lambda x, k: CASE WHEN k = label + 1 THEN (x - 1) * (x - 1) ELSE x * x END)) AS brier,
  list_max(p_b) AS conf_b, list_position(p_b, list_max(p_b)) - 1 AS pred_b, list_position(p_b, list_max(p_b)) - 1 = label AS ok_b, -ln(greatest(p_b[label + 1], 1e-9)) AS nll_b FROM r4)
"""
