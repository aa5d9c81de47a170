"""What the operators of this subpackage share: the shared work folder, tables cut from their lineage, connected components.

Executors and driver share only the folder named in ``spark.checkpoint.dir``. Files that an operator writes go there,
under a name no other attempt uses, and are listed in a table that holds only what successful tasks wrote.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that parts words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in a local session that has none, a new temporary folder, kept in the session's conf."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gaugeworks.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("gaugeworks.shared.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/gaugeworks/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage is cut, a lost executor costs no recompute."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def give_back() -> None:
    """Free memory that a Python worker's allocators hold on to goes back to the system: workers live on after a task, and an executor's limit counts all of them."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def spare(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; null gives an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write data as folder/name by way of a temporary name, so that a reader never sees half a file. Runs on executors."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{at}/{name}")
    return f"{folder}/{name}"


def open_file(path: str):
    """A random-access handle on a file of put_file()."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Alternating large-star and small-star steps, each a grouped minimum (with map-side partial aggregation, so the hub of
    a large star is no hot group) and an equi-join on the node, which adaptive execution splits when it is skewed. Every
    round is written to the shared folder. Rounds grow as the logarithm of the longest path. Nulls are dropped.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo is not null and hi is not null")
    nodes = written(e.selectExpr("explode(array(lo, hi)) as node").distinct(), f"{name}-nodes")
    e = written(e.where("lo < hi").distinct(), f"{name}-0")
    before = None
    for k in range(1, most_rounds):
        # large star: each larger neighbour of a node is tied to the node's smallest neighbour
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        # small star: a node and its smaller neighbours are tied to the smallest of them
        large = large.where("lo < hi").distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(least, "u")
        small = small.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        e = written(small.where("lo < hi").distinct(), f"{name}-{k}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # every edge is now (component, node), one for each node but the smallest
    return nodes.join(e.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
