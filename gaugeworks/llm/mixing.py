"""Mixing sources to target weights (10): pivotal dependent rounding through a distributed reduction tree.

Sources (by code point, null last) get weights, repeating, and share ``share`` times the size of all documents; a target
stops at ``most`` times its source's size and the excess is shared again by weight until none is above. A document's
expected copies are target / size of its source. The whole part is taken; the fractional rest is settled by pivotal
rounding: two documents trade mass, measured in words so that the source's total stays as it is, until one of them is
integral. A document that is large beside all smaller ones together trades with each of them, in one draw. Every document
keeps its expectation, and a source misses its target by less than one document, as a rule a small one.

The tree: the documents of a source are dealt by a hash over chunks of about ``chunk`` rows, each chunk leaves at most one
fractional document, and those meet in chunks of their own, level by level. No source is ever in one task, however large.
Only doc_id, source, size and a fraction travel. Draws come from hashes of seed, level and the two documents: reruns agree.

Null texts and texts without words have size 0 and are taken 0 words (one copy of each when the target share of their
source is at least 1, so that no source loses its empty rows by chance). Null doc_ids are documents as others are. Rows alike in doc_id, text and
source are documents of their own, told apart by a number; where the mix takes some of them once more than others, those that are first by a hash of all columns are taken.
An empty table gives an empty result. Columns of any other name are passed through as they are. Sources stay a table: their targets are found by
a few grouped sums, and no number of sources is too large.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from gaugeworks.llm.shared import spare, written

WEIGHTS, SHARE, MOST, SEED, CHUNK = (5.0, 2.0, 1.0), 1.5, 2.0, 20240917, 4096


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, ...) with target.

    Targets are in proportion to the weights and sum to share times all sizes; those over most times their size are set to it and the rest is
    shared by the others, until none is above. A source is held at its bound when most * size / weight is below the level of words a unit of
    weight; the level only rises from one round to the next, and a round is one grouped sum.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source: already grouped
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    sources = written(sources.withColumn("weight", weight).withColumn("level", most * F.col("source_size") / F.col("weight")), "mix-sources")
    total, level, held = None, 0.0, -1
    while True:
        low = F.col("level") < level
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(low, F.col("source_size"))).alias("bound"), F.sum(F.when(~low, F.col("weight"))).alias("free"), F.count_if(low).alias("held")).first()
        total = share * (r["all"] or 0)
        if r["held"] == held or not r["free"]:
            break
        held, level = r["held"], (total - most * (r["bound"] or 0)) / r["free"]
    return sources.withColumn("target", F.least(most * F.col("source_size"), level * F.col("weight")) if r["free"] else most * F.col("source_size").cast("double")).drop("weight", "level")


def _draw(*key) -> float:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, key)).encode("utf-8", "surrogatepass"), seed=7) / 2**64


def settle_dominant(ids: list[str], sizes: list[float], rest: list[float], seed: int, level: int, several: float = 64.0) -> None:
    """Settle those documents, largest first, that are large beside all smaller ones together: no one partner could take their mass.

    Such a document goes to 0 or 1 with one draw; each smaller one is its partner in a trade of part of the mass, in proportion to what it can
    take in either direction, so that every expectation and the total of words stay. rest is changed in place; documents come by falling size.
    """
    s, x = np.array(sizes, float), np.array(rest, float)
    for i in range(len(s) - 1):
        if not 1e-9 < x[i] < 1 - 1e-9:
            continue
        sj, xj = s[i + 1 :], x[i + 1 :]
        room = np.where((xj > 1e-9) & (xj < 1 - 1e-9), np.minimum((1 - xj) * sj / (x[i] * s[i]), xj * sj / ((1 - x[i]) * s[i])), 0.0)
        total = room.sum()
        if total >= several:
            break
        if total < 1:
            continue
        up = _draw(seed, level, "dominant", ids[i]) < x[i]
        words = -(1 - x[i]) * s[i] if up else x[i] * s[i]
        x[i + 1 :] = np.clip(xj + words * room / total / np.maximum(sj, 1e-300), 0, 1)
        x[i] = 1.0 if up else 0.0
    rest[:] = x.tolist()


def pivot(ids: list[str], sizes: list[float], rest: list[float], seed: int, level: int) -> tuple[list[int], int]:
    """One pass over fractional rests in (0, 1): 0 or 1 for each, and the place of the one left fractional (-1: none); rest holds its mass.

    The pair (i, j) moves along s_i x_i + s_j x_j = constant in one of two directions until the first of them is 0 or 1;
    the direction is drawn so that both keep their expectation.
    """
    out, open_ = [-1] * len(rest), -1
    for j in range(len(rest)):
        if rest[j] <= 1e-12 or rest[j] >= 1 - 1e-12:
            out[j] = int(rest[j] > 0.5)
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        si, sj = sizes[i], sizes[j]
        up = min((1 - rest[i]) * si, rest[j] * sj)  # words that j can give to i
        down = min(rest[i] * si, (1 - rest[j]) * sj)  # words that i can give to j
        d = up if _draw(seed, level, ids[i], ids[j]) * (up + down) < down else -down
        rest[i] += d / si
        rest[j] -= d / sj
        open_ = -1
        for k in (i, j):
            if rest[k] <= 1e-9 or rest[k] >= 1 - 1e-9:
                out[k] = int(rest[k] > 0.5)
            else:
                open_ = k
    return out, open_


def row_key(docs: DataFrame) -> list[Column]:
    """Two hashes (128 bits) of doc_id, text and source that tell null from empty and a text from a source."""
    parts = [x for c in ("doc_id", "text", "source") for x in (docs[c], docs[c].isNull())]
    return [F.xxhash64(*parts, F.lit("first")), F.xxhash64(F.lit("second"), *reversed(parts))]


def _settle(level: int, last: bool, seed: int, chunk: int, schema: pa.Schema):
    """A chunk of a source's fractional documents: those that are settled, and one that is left open."""

    def run(table: pa.Table) -> pa.Table:
        size, rest, taken = (table.column(c).to_numpy() for c in ("size", "rest", "copies"))
        names = [np.array(table.column(c), np.int64) for c in ("key", "also", "number")]
        o = np.lexsort((*reversed(names), -size))  # large ones first: what is left over at the end is small
        ids = [f"{a}/{b}/{c}" for a, b, c in zip(*(x[o].tolist() for x in names))]
        sizes, mass = size[o].tolist(), rest[o].tolist()
        settle_dominant(ids, sizes, mass, seed, level)
        got, left = pivot(ids, sizes, mass, seed, level)
        if left >= 0 and last:  # the last one of its source
            got[left], left = int(_draw(seed, "last", ids[left]) < mass[left]), -1
        table = table.take(pa.array(o))
        new = {"copies": pa.array(taken[o] + np.maximum(got, 0), pa.int32()), "rest": pa.array([mass[k] if k == left else 0.0 for k in range(len(got))], pa.float64()), "open": pa.array([k == left for k in range(len(got))], pa.bool_()), "slot": pa.array(table.column("slot").to_numpy() // chunk, pa.int64())}
        return pa.table([new.get(f.name, table.column(f.name)) for f in schema], schema=schema)

    return run


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, key, also, number, source, size, source_size, target, copies: one row for each row of docs.

    (key, also) is row_key(), number counts rows alike in it from 1.
    """
    kind = docs.schema["doc_id"].dataType
    key, also = row_key(docs)
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(docs["doc_id"].alias("doc_id"), key.alias("key"), also.alias("also"), docs["source"].cast("string").alias("source"), size.alias("size"))
    # rows alike are counted before they are numbered: no window, and a row that is repeated very often is one row until here
    rows = written(rows.groupBy("key", "also").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("n")), "mix-sizes")
    sources = with_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")), weights, share, most)
    table = sources.select(F.col("source").alias("of"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("rows") / chunk)).cast("long").alias("chunks"))
    x = rows.join(table, rows["source"].eqNullSafe(table["of"])).drop("of").withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    x = x.withColumn("expected", expected).withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("expected") + 1e-12)).otherwise(F.when(F.col("expected") >= 1, 1).otherwise(0)).cast("int"))
    x = x.withColumn("rest", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("expected") - F.col("copies"))).otherwise(F.lit(0.0)))
    x = x.withColumn("slot", F.pmod(F.xxhash64("key", "also", "number", F.lit(seed)), F.col("chunks"))).withColumn("open", F.lit(True))
    columns = ["doc_id", "key", "also", "number", "source", "size", "source_size", "target", "copies", "rest", "slot", "open"]
    schema, arrow = x.select(*columns).schema, to_arrow_schema(x.select(*columns).schema)
    levels, n = 1, sources.agg(F.max(F.ceil(F.col("rows") / chunk))).first()[0] or 1
    while n > 1:
        levels, n = levels + 1, -(-n // chunk)
    done, x = [], x.select(*columns)
    for level in range(levels):
        x = written(x.groupBy("source", "slot").applyInArrow(_settle(level, level == levels - 1, seed, chunk, arrow), schema), f"mix-{level}")
        done.append(x.where("not open"))
        x = x.where("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("rest", "slot", "open").withColumn("doc_id", F.col("doc_id").cast(kind))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as many times as it is taken; all columns of docs."""
    key, also, order, place, many = (spare(docs.columns, c) for c in ("key", "also", "order", "place", "many"))
    by_key = copies(docs, **options).groupBy("key", "also").agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count("*").alias("n"))
    by_key = written(by_key.select(F.col("key").alias("_key"), F.col("also").alias("_also"), "least", (F.col("all") - F.col("least") * F.col("n")).alias("more")).where("least > 0 or more > 0"), "mix-copies")
    # one shuffle of the texts, by two columns that are never null; both branches read the same one
    keyed = docs.withColumns(dict(zip((key, also), row_key(docs))))
    got = keyed.join(by_key.hint("merge"), (keyed[key] == by_key["_key"]) & (keyed[also] == by_key["_also"]))
    rows = got.select(*[keyed[c] for c in docs.columns], keyed[key], keyed[also], by_key["least"].alias(many), by_key["more"].alias(place))
    out = rows.where(F.col(place) == 0).select(*docs.columns, many)
    if by_key.where("more > 0").limit(1).count():
        plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        few = rows.where(F.col(place) > 0).withColumn(order, F.row_number().over(W.partitionBy(key, also).orderBy(F.xxhash64(*plain))))
        out = out.union(few.select(*docs.columns, (F.col(many) + (F.col(order) <= F.col(place)).cast("int")).alias(many)))
    return out.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(many))).alias(order)).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    got = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
