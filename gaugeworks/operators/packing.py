"""Padded passes and batches: items grouped into passes of least padded cost, records of a step cut into runs of like cost, runs cut to a budget.

``length_passes`` is exact over any number of items. Its dynamic programme runs over items in order of length and looks back ``cap`` places, so what a block of places does to the costs at its border is a matrix
of cap by cap numbers, by (min, +): blocks are computed apart, a chain of matrices gives each block the true costs at its border, blocks are computed once more with these, and a second chain, backwards, says where the passes
that cross a border begin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.operators.routing import padded_count, padded_length

#: Tokens that a pass costs at least (fixed value); items that one task's programme takes.
LEAST, BLOCK = 256, 1 << 16
_FAR = 1 << 60


def cut_off(df: DataFrame) -> DataFrame:
    """df without its lineage: a checkpoint where the session has a folder for it, else kept in memory or on disk."""
    spark = df.sparkSession
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) else df.persist()


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """df with its place (from 0) within keys by order. In two steps over ranges of (keys, order), so neither a hot key nor a hot value is one task, as long as order tells rows apart."""
    ranged = cut_off(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)], F.col("_range").alias("_of"), before.alias("_before"))
    same = F.col("_range") == F.col("_of")
    for j, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{j}"))
    within = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_in", within).join(counts, same).withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_in", "_of", "_before", *[f"_key{j}" for j in range(len(keys))])


class Programme:
    """Passes of 1 .. cap items that end at a place, costed with the padded length of the last one."""

    def __init__(self, cap: int, counts: Sequence[int], least: int):
        self.cap, self.least = cap, least
        self.counts = np.asarray(counts, np.int64)  # padded sizes of passes of 1 .. cap

    def costs(self, padded: int) -> np.ndarray:
        return np.maximum(self.least, self.counts * padded)

    def matrix(self, padded: np.ndarray) -> np.ndarray:
        """[k, s]: least cost at the place k before the block's end, from cost 0 at the place s before its start."""
        window = np.where(np.eye(self.cap, dtype=bool), 0, _FAR)
        for p in padded:
            best = (window + self.costs(int(p))[:, None]).min(axis=0)
            window = np.vstack([np.minimum(best, _FAR), window[:-1]])
        return window

    def cuts(self, padded: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Size of the last pass of a least grouping up to each place of the block; of equal costs the larger pass."""
        window, out = border.copy(), np.empty(len(padded), np.int64)
        for j, p in enumerate(padded):
            total = window + self.costs(int(p))
            k = self.cap - 1 - int(np.argmin(total[::-1]))
            out[j] = k + 1
            window = np.concatenate([[min(int(total[k]), _FAR)], window[:-1]])
        return out


def _entries(cuts: np.ndarray, cap: int) -> list[tuple[int, int]]:
    """For the end t places before the block's end: (places before its start where the passes begin that cross its start, the end of the first of them in the block, from its start on, or 0)."""
    out: list[tuple[int, int]] = []
    for t in range(cap):
        j, end = len(cuts) - t, 0
        while j > 0:
            end, j = j, j - int(cuts[j - 1])
        out.append((-j, end))
    return out


def length_passes(items: DataFrame, cap: int, keys: Sequence[str] = (), order: str = "id", length: str = "length", least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """items with place, pass_end (the place after the last item of its pass, which numbers the passes of keys), pass_items and pass_tokens: passes of at most cap items in order of length, of the least padded cost
    in all: padded count x padded length of the longest, at least ``least``. Of equal costs, later passes are as large as they can be.

    order tells items of one length apart. Items without a length count as empty. An empty table gives an empty result. Blocks are of ``block`` items (cap at least); of each, cap x cap numbers go through the chain of its keys.
    """
    spark, block = items.sparkSession, max(block, cap)
    counts = [r[0] for r in spark.range(1, cap + 1).select(padded_count(F.col("id"))).orderBy("id").collect()]
    programme = Programme(cap, counts, least)
    size = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(1))
    rows = numbered(items.withColumn("_padded", padded_length(size)).withColumn("_size", size), keys, ["_size", order])
    # a single text stands for all keys, whatever their types
    key = F.to_json(F.struct(*[F.col(k).alias(str(j)) for j, k in enumerate(keys)])) if keys else F.lit("")
    rows = cut_off(rows.withColumn("_key", key).withColumn("_block", F.floor(F.col("place") / block)))
    lean = rows.select("_key", "_block", "place", "_padded")

    def ordered(table: pa.Table) -> np.ndarray:
        return table.sort_by("place").column("_padded").to_numpy()

    def matrices(table: pa.Table) -> pa.Table:
        m = programme.matrix(ordered(table))
        return pa.table({"_key": table.column("_key").slice(0, 1), "_block": table.column("_block").slice(0, 1), "n": [table.num_rows], "m": pa.array([m.ravel().tolist()], pa.list_(pa.int64()))})

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, border = None, None
        for batch in batches:
            out = []
            for k, b, m in zip(batch.column("_key").to_pylist(), batch.column("_block").to_pylist(), batch.column("m")):
                if k != key:
                    key, border = k, np.array([0] + [_FAR] * (cap - 1))
                out.append((k, b, border.tolist()))
                border = np.minimum((np.asarray(m.values.to_numpy()).reshape(cap, cap) + border[None, :]).min(axis=1), _FAR)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["_key", "_block", "border"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, back, end = None, 0, 0
        for batch in batches:
            out = []
            for k, b, n, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("_key", "_block", "n", "starts", "ends"))):
                if k != key:
                    key, back, end = k, 0, b * block + n
                out.append((k, b, back, end))
                end = b * block + ends[back] if ends[back] else end
                back = starts[back]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.string() if j == 0 else pa.int64()) for j in range(4)], ["_key", "_block", "back", "end"])

    def crossings(left: pa.Table, right: pa.Table) -> pa.Table:
        cuts = programme.cuts(ordered(left), np.asarray(right.column("border")[0].values.to_numpy()))
        found = _entries(cuts, cap)
        return pa.table({"_key": left.column("_key").slice(0, 1), "_block": left.column("_block").slice(0, 1), "n": [left.num_rows], "starts": pa.array([[s for s, _ in found]], pa.list_(pa.int64())), "ends": pa.array([[e for _, e in found]], pa.list_(pa.int64()))})

    def ends(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        cuts = programme.cuts(left.column("_padded").to_numpy(), np.asarray(right.column("border")[0].values.to_numpy()))
        first, j = int(right.column("_block")[0].as_py()) * block, len(cuts) - int(right.column("back")[0].as_py())
        out = np.full(len(cuts), int(right.column("end")[0].as_py()), np.int64)
        while j > 0:
            i = max(0, j - int(cuts[j - 1]))
            out[i:j] = first + j
            j -= int(cuts[j - 1])
        return pa.table({"_key": left.column("_key"), "place": left.column("place"), "pass_end": out})

    by = ["_key", "_block"]
    each = lean.groupBy(*by).applyInArrow(matrices, "_key string, _block long, n long, m array<long>")
    borders = cut_off(each.repartition("_key").sortWithinPartitions(*by).mapInArrow(forward, "_key string, _block long, border array<long>"))
    back = lean.groupBy(*by).cogroup(borders.groupBy(*by)).applyInArrow(crossings, "_key string, _block long, n long, starts array<long>, ends array<long>")
    back = back.repartition("_key").sortWithinPartitions("_key", F.desc("_block")).mapInArrow(backward, "_key string, _block long, back long, end long")
    placed = lean.groupBy(*by).cogroup(borders.join(back, by).groupBy(*by)).applyInArrow(ends, "_key string, place long, pass_end long")
    out = rows.drop("_block").join(placed, ["_key", "place"])
    passes = placed.join(rows.select("_key", "place", "_padded"), ["_key", "place"]).groupBy("_key", "pass_end").agg(F.count("*").alias("pass_items"), F.max("_padded").alias("_longest"))
    passes = passes.withColumn("pass_tokens", F.greatest(F.lit(least).cast("long"), padded_count(F.col("pass_items")) * F.col("_longest"))).drop("_longest")
    return out.join(passes, ["_key", "pass_end"]).select(*items.columns, "place", "pass_end", "pass_items", "pass_tokens")


def run_cost(rows: Sequence[tuple[int, int]]) -> int:
    """Padded tokens of a pass over records of (rows, longest row): rows x the longest."""
    return sum(r for r, _ in rows) * max(n for _, n in rows)


def balanced_cut(sizes: Sequence[tuple[int, int]], n: int) -> list[int]:
    """Starts of exactly n runs of neighbours whose greatest cost is as small as possible: the least capacity by bisection, runs filled to it in turn; where that leaves fewer, the costliest run that can be is halved."""

    def starts(cap: int) -> list[int]:
        out, rows, longest = [0], 0, 0
        for k, (r, longer) in enumerate(sizes):
            if rows and (rows + r) * max(longest, longer) > cap:
                out.append(k)
                rows, longest = 0, 0
            rows, longest = rows + r, max(longest, longer)
        return out

    low, high = max(r * x for r, x in sizes), run_cost(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(starts(mid)) <= n else (mid + 1, high)
    cut = starts(low)
    while len(cut) < n:
        ends = [*cut[1:], len(sizes)]
        _, at = max((run_cost(sizes[a:b]), -k) for k, (a, b) in enumerate(zip(cut, ends)) if b - a > 1)
        a, b = cut[-at], ends[-at]
        cut.insert(1 - at, a + (b - a) // 2)
    return cut


PLAN = "step long, micro int, rank int, id string, copy int, tokens long, step_records int, last boolean"


def balanced_steps(records: DataFrame, batch: int, accum: int, world: int, ceiling: int | None = None) -> DataFrame:
    """PLAN of records (id, place from 0, rows, longest): a step takes batch x accum x world records by place, cut in order of cost into one run for each micro-batch and rank.

    Runs of a step are of neighbours in cost whose greatest padded cost is as small as possible; the k-th micro-batch of all ranks are the k-th costliest runs. A short last step has fewer micro-batches, and is filled up with its own
    first records (copy 1 and up), which count in step_records. With a ceiling, a step whose costliest run is above it gets one more micro-batch for each rank until none is; a record above it by itself raises.
    A step is a bounded number of records, so each is one task's group, and steps are independent.
    """
    per_step = batch * accum * world

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        own = [(str(i), int(r), int(n)) for i, r, n in zip(part["id"], part["rows"], part["longest"])]
        if ceiling is not None and (over := max(r * n for _, r, n in own)) > ceiling:
            raise ValueError(f"a record needs {over} padded tokens, more than the ceiling of {ceiling}")
        micro = -(-len(own) // (world * batch))
        fill = lambda step, rest: step + [rest[k % len(rest)] for k in range(max(0, world * micro - len(step)))]
        step = fill(own, own)
        while True:
            step = sorted(step, key=lambda x: -x[1] * x[2])
            sizes = [(r, n) for _, r, n in step]
            at = balanced_cut(sizes, world * micro)
            runs = [step[a:b] for a, b in zip(at, [*at[1:], len(step)])]
            cost = [run_cost([(r, n) for _, r, n in run]) for run in runs]
            if ceiling is None or max(cost) <= ceiling:
                break
            micro += 1
            step = fill(step, sorted(step, key=lambda x: x[1] * x[2]))
        order, seen, out = sorted(range(len(runs)), key=lambda k: -cost[k]), {}, []
        for place, k in enumerate(order):
            for i, _, _ in runs[k]:
                seen[i] = seen.get(i, -1) + 1
                out.append((int(part["step"].iloc[0]), place // world, place % world, i, seen[i], cost[k], len(step), place // world == micro - 1))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])

    steps = records.select(F.col("id").cast("string").alias("id"), "place", "rows", "longest", F.floor(F.col("place") / per_step).cast("long").alias("step"))
    return steps.groupBy("step").applyInPandas(plan, PLAN)


def budget_passes(rows: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """keys, id, pass_number (from 0) of rows (keys, id, rows, longest), the costliest first: a row goes to the last pass while the pass's padded tokens stay within the budget, else it opens the next (alone it may be above). keys tell
    bounded groups apart, such as micro-batches."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def passes(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_cost=part["rows"] * part["longest"]).sort_values(["_cost", "id"], ascending=[False, True])
        number, many, longest, out = 0, 0, 0, []
        for r, n in zip(part["rows"], part["longest"]):
            if many and (many + r) * max(longest, n) > budget:
                number, many, longest = number + 1, 0, 0
            many, longest = many + r, max(longest, n)
            out.append(number)
        return part.assign(pass_number=out)[[*keys, "id", "pass_number"]]

    return rows.groupBy(*keys).applyInPandas(passes, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "id"]) + ", pass_number int")
