"""Quality classifier (7): supervised subword embeddings.

Each text is the average of learned vectors of its hashed words and of its hashed runs of 3 to 5 characters (code points, white space included); a
softmax layer gives the probability of label 1. Vectors and layer are trained by stochastic gradient descent in numpy, one document a step, with a
linearly falling rate. For scoring the layer is folded into the vectors: one number for each bucket, so a text's score is a sum of table look-ups.

The model is fitted on about ``sample`` labelled rows (a documented bound), taken by a hash of doc_id and text from the rows that are not held out;
only their text and label are learned from. Their features are written to the shared folder in a random order and come to the driver a part at a time,
in every epoch anew, so the driver never holds them all. Everything else covers all rows.

A null text is an empty one; an empty text has no features and gets the layer's bias. Null labels and a null doc_id are not learned
from; a doc_id with several labels gives an example for each, a repeated row counts once. With no labelled rows every score is 0.5. Repeated rows give
repeated results, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.bytescan import IS_SPACE, powers, runs, text_buffer
from gaugeworks.llm.language_id import held_out
from gaugeworks.llm.shared import written

BITS, DIM, EPOCHS, RATE, SAMPLE, CUT = 17, 8, 5, 2.0, 4000, 0.3
GRAMS = (3, 4, 5)
_STEP = 0xD6E8FEB86659FD93
#: Examples that come to the driver at a time.
PART = 800


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and each text's first place among them."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4"), lead[at]


def grams(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each kind of feature: buckets, each row's first place among them (and the number), and which are whole (None: all)."""
    points, first = code_points(data, at)
    left = np.repeat(first[1:], np.diff(first)).astype(np.int32) - np.arange(len(points), dtype=np.int32)
    c = points + np.uint32(1)
    gram = np.zeros(len(c), np.uint32)
    for k in range(min(max(GRAMS), len(c))):
        gram[: len(c) - k] = gram[: len(c) - k] * np.uint32(0x01000193) + c[k:]
        if k + 1 in GRAMS:
            yield (gram * np.uint32(2654435761)) >> np.uint32(32 - bits), first, left > k
    b = data.astype(np.uint32) + np.uint32(1)
    space = IS_SPACE[data]
    edge = np.ones(len(b), bool)
    edge[1:] = space[:-1]
    edge[at[:-1][at[:-1] < len(b)]] = True
    starts = np.flatnonzero(~space & edge)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(np.where(space, np.uint64(0), b) * powers(_STEP, len(b)), out=sums[1:])
    words = (sums[np.append(starts[1:], len(b))] - sums[starts]) * powers(pow(_STEP, -1, 1 << 64), len(b))[starts] if len(starts) else np.zeros(0, np.uint64)
    yield (words * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits), np.searchsorted(starts, at), None


def features(data: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text and their shares, which sum to 1."""
    got = [(i if ok is None else i[ok]).astype(np.int64) for i, _, ok in grams(data, np.array([0, len(data)]), bits)] if len(data) else []
    u, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return u, (n / max(1, n.sum())).astype(np.float32)


def train(examples: Callable[[int], Iterable[tuple[np.ndarray, np.ndarray, int]]], n: int, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> tuple[np.ndarray, float]:
    """From the n (buckets, shares that sum to 1, label) that examples gives for an epoch the folded table (logit of label 1 for each bucket) and bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * n), 0
    for epoch in range(epochs):
        for ids, share, label in examples(epoch):
            now = rate * (1 - done / steps)
            done += 1
            h = share @ vectors[ids]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            vectors[ids] -= now * len(ids) ** 0.5 * share[:, None] * (layer @ p)
            layer -= now * np.outer(h, p)
            bias -= now * 0.1 * p
    folded = vectors @ layer
    return (folded[:, 1] - folded[:, 0]).astype(np.float32), float(bias[1] - bias[0])


def scores(table: np.ndarray, bias: float, data: np.ndarray, at: np.ndarray, bits: int = BITS) -> np.ndarray:
    out = np.full(len(at) - 1, bias)
    for lo, hi in runs(at, 1 << 18):
        part = at[lo : hi + 1] - at[lo]
        if not part[-1]:
            continue
        total, n = np.zeros(hi - lo), np.zeros(hi - lo)
        for index, first, ok in grams(data[at[lo] : at[hi]], part, bits):
            value = table[index]
            if ok is not None:
                value[~ok] = 0
            total += np.diff(np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])[first])
            n += np.diff(first) if ok is None else np.diff(np.concatenate([[0], np.cumsum(ok)])[first])
        out[lo:hi] += total / np.maximum(1, n)
    return 1 / (1 + np.exp(-out))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, **options) -> tuple[np.ndarray, float] | None:
    """Sparse features of the bounded sample are written once; the driver, which trains, reads them part by part."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("_id is not null and quality in (0, 1)").where(~held_out(F.col("_id")))
    total = known.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = written(known.where(draw < min(1.0, sample / total)).distinct(), "quality-sample")  # of known size, so Spark broadcasts it only where it is small
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(chosen, texts["doc_id"] == chosen["_id"], "inner").select("doc_id", "quality", "text").dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            got = []
            for k, q in enumerate(batch.column("quality").to_pylist()):
                ids, share = features(data[at[k] : at[k + 1]], bits)
                got.append((q, ids.astype("<u4").tobytes(), share.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pydict({"quality": [g[0] for g in got], "ids": [g[1] for g in got], "share": [g[2] for g in got]}, pa.schema([("quality", pa.int32()), ("ids", pa.binary()), ("share", pa.binary())]))

    order = F.xxhash64("ids", "quality", F.lit("order"))
    found = written(rows.mapInArrow(run, "quality int, ids binary, share binary"), "quality-features")
    n = found.count()
    parts = max(1, -(-n // PART))
    found = written(found.withColumn("part", F.pmod(order, F.lit(parts))).repartition(max(1, min(parts, 200)), "part").sortWithinPartitions("part", order), "quality-examples")

    def examples(epoch: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for k in np.random.default_rng(epoch).permutation(parts).tolist():
            some = sorted(found.where(F.col("part") == k).collect(), key=lambda r: (bytes(r["ids"]), r["quality"]))
            for j in np.random.default_rng((epoch, k)).permutation(len(some)):
                yield np.frombuffer(some[j]["ids"], "<u4"), np.frombuffer(some[j]["share"], "<f4"), some[j]["quality"]

    return train(examples, n, bits, **options)


def predict(docs: DataFrame, model: tuple[np.ndarray, float] | None, bits: int = BITS) -> DataFrame:
    """doc_id, score for each row; one pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.full(batch.num_rows, 0.5) if model is None else scores(*model, *text_buffer(batch.column("text")), bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = predict(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
