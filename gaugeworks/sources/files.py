"""Readers and writers: JSON lines, labelled requests, tolerant verdict files, archives, binary records, frozen suites."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

SPLITS = ("train", "calibration", "development", "test")
REQUEST = "state string, questions map<string, struct<type: string, instructions: string, criteria: string, label: string, src: string>>, _meta struct<id: string, group_id: string, source: string, variant: string>"


def work_folder(spark) -> str:
    """A new folder in the one that executors and driver share; a temporary one where the session has none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{at or tempfile.mkdtemp(prefix='gaugeworks-')}/suite-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with an explicit schema; only the line feed parts lines, so U+2028 and the like are data."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text of each line that is not blank. Files are read in splits: lines are counted by split, then numbered within it, so a large file is many tasks' work."""
    t = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place"), F.col("value").alias("text"))
    counts = t.groupBy("file", "_start").agg(F.count("*").alias("_n"))
    before = counts.select("file", "_start", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("file", "_start").orderBy("_place"))
    return t.withColumn("_in", within).join(before, ["file", "_start"]).select("file", (F.col("_in") + F.col("_before")).cast("int").alias("line"), "text").where(F.trim("text") != "")


def load_requests(spark: SparkSession, path: str, source: str = "custom") -> DataFrame:
    """Labelled requests with their defaults, and ``problem`` (null for good rows): id is source/line, src is source_type, variant is clean."""
    rows = read_lines(spark, path).select("line", F.from_json("text", REQUEST, {"mode": "PERMISSIVE"}).alias("r"))
    q = F.map_entries("r.questions")
    unlabelled = F.exists(q, lambda e: e["value"]["label"].isNull())
    problem = F.when(F.col("r").isNull() | F.col("r.state").isNull(), "no state").when(F.coalesce(F.size("r.questions"), F.lit(0)) <= 0, "no questions").when(unlabelled, "question without label")
    own = F.concat(F.lit(f"{source}/"), F.col("line").cast("string"))
    typed = F.transform(q, lambda e: F.struct(e["key"].alias("qid"), e["value"]["type"].alias("type"), e["value"]["instructions"].alias("instructions"), e["value"]["criteria"].alias("criteria"), e["value"]["label"].alias("label"), F.coalesce(e["value"]["src"], F.concat(F.lit(f"{source}_"), e["value"]["type"])).alias("src")))
    return rows.select("line", F.coalesce("r._meta.id", own).alias("id"), F.coalesce("r._meta.group_id", "r._meta.id", own).alias("group_id"), F.coalesce("r._meta.source", F.lit(source)).alias("source"), F.coalesce("r._meta.variant", F.lit("clean")).alias("variant"), "r.state", typed.alias("questions"), problem.alias("problem"))


def without_labels(requests: DataFrame) -> DataFrame:
    """What a predictor may see: state and, of each question, its type, instructions and criteria."""
    return requests.select("id", "state", F.transform("questions", lambda q: F.struct(q["qid"], q["type"], q["instructions"], q["criteria"])).alias("questions"))


def read_verdicts(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("accept", "relabel", "drop")) -> DataFrame:
    """id, verdict, label, reason: lines that start with a brace and parse, with an allowed verdict; the last line of an id counts."""
    rows = read_lines(spark, path).where(F.col("text").startswith("{")).select("file", "line", F.from_json("text", "id string, verdict string, label string, reason string").alias("v"))
    rows = rows.where(F.col("v.id").isNotNull() & F.col("v.verdict").isin(*allowed))
    return rows.groupBy("v.id").agg(F.max_by("v", F.struct("file", "line")).alias("v")).select("v.id", "v.verdict", "v.label", "v.reason")


def read_zipped_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, member, line (from 1), text of JSON lines within zip files; an archive is one task's work, a member is read line by line."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(n for n in z.namelist() if n.endswith(".jsonl")):
                        with z.open(m) as f:
                            rows = [(name, m, k, line.decode("utf-8").rstrip("\n")) for k, line in enumerate(f, 1) if line.strip()]
                        yield pd.DataFrame(rows, columns=["file", "member", "line", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, line long, text string")


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """A base-128 number, low groups first, and the place after it."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def bag_records(data: bytes) -> list[bytes]:
    """Records of a bag file: a footer of little-endian 64-bit end offsets, whose own start is the last of them."""
    if not data:
        return []
    first = struct.unpack_from("<q", data, len(data) - 8)[0]
    ends = struct.unpack_from(f"<{(len(data) - first) // 8}q", data, first)
    return [data[a:b] for a, b in zip((0, *ends[:-1]), ends)]


def read_bags(spark: SparkSession, path: str) -> DataFrame:
    """file, index, state, action, value of records: two length-prefixed texts and a big-endian double."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = []
                for k, r in enumerate(bag_records(content)):
                    n, at = read_varint(r, 0)
                    state, at = r[at : at + n].decode("utf-8"), at + n
                    n, at = read_varint(r, at)
                    rows.append((name, k, state, r[at : at + n].decode("utf-8"), struct.unpack(">d", r[at + n :])[0]))
                yield pd.DataFrame(rows, columns=["file", "index", "state", "action", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, index long, state string, action string, value double")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, quoted cells over several lines, doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def freeze(rows: DataFrame, path: str, info: Mapping | None = None) -> DataFrame:
    """Write a suite by split and its manifest (split, records, questions, digest); an existing target is refused.

    The digest of a split is a sum of row hashes, so it does not depend on the order or number of files.
    """
    rows.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/data")
    manifest = split_digests(rows.sparkSession.read.parquet(f"{path}/data")).withColumn("info", F.lit(json.dumps(dict(info or {}), sort_keys=True)))
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return rows.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def split_digests(rows: DataFrame) -> DataFrame:
    columns = sorted(c for c in rows.columns if c != "split")
    return rows.groupBy("split").agg(F.count("*").alias("records"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def load_split(spark: SparkSession, path: str, split: str, allow_test: bool = False) -> DataFrame:
    """A split of a frozen suite: unknown names and, unless allowed, the test split are refused; records and digest must be the manifest's."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    if split == "test" and not allow_test:
        raise PermissionError("the test split is locked")
    rows = spark.read.parquet(f"{path}/data").where(F.col("split") == split)  # partition pruning
    want = spark.read.json(f"{path}/manifest").where(F.col("split") == split).first()
    got = split_digests(rows).first()
    if want is None or got is None or (int(want["records"]), want["digest"]) != (got["records"], got["digest"]):
        raise ValueError(f"{split} is not what the manifest says")
    return rows


def leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """run, base, seed, transfer_acc, objective of result files; missing blocks are null; best transfer first, nulls last."""
    schema = "base string, seed long, transfer struct<acc: double>, development struct<objective: double>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("run"), "base", "seed", F.col("transfer.acc").alias("transfer_acc"), F.col("development.objective").alias("objective"))
    return rows.orderBy(F.desc_nulls_last("transfer_acc"), "run")


def request_digest(columns: list[str]):
    """sha256 of the compact JSON of the named columns, in that order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def file_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def read_tar(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """file, member, text of the members of (compressed) tar archives whose name ends with suffix; one member in memory at a time."""
    import tarfile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                    for m in t:
                        if m.isfile() and m.name.endswith(suffix):
                            yield pd.DataFrame([(name, m.name, t.extractfile(m).read().decode("utf-8", "replace"))], columns=["file", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, text string")


def literal_list(cell):
    """A column of Python list literals of strings or numbers as arrays of text; null where it is none."""
    import ast

    @F.pandas_udf("array<string>")
    def of(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                got = ast.literal_eval(v)
                return [str(i) for i in got] if isinstance(got, (list, tuple)) else None
            except (ValueError, SyntaxError, TypeError):
                return None

        return pd.Series([one(v) for v in x], dtype=object)

    return of(cell)


#: Statuses of a remote predictor: refused rows are kept as rejected; others are tried again.
REFUSED, AGAIN = (400, 413, 422), (408, 429, 500, 502, 503, 504)


def asked(requests: DataFrame, send, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """id, status, answer of each request through send(text) -> (status, answer), on the executors, with bounded retries and doubling waits.

    A refused request has its status and no answer; one that fails to the end, or with any other status, raises, and Spark runs the task again.
    """
    import time

    def one(text: str) -> tuple[int, str | None]:
        status = 0
        for k in range(tries):
            status, answer = send(text)
            if status == 200:
                return status, answer
            if status in REFUSED:
                return status, None
            if status not in AGAIN:
                break
            time.sleep(wait * 2**k)
        raise ConnectionError(f"status {status}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "status": [g[0] for g in got], "answer": [g[1] for g in got]})

    return requests.select("id", "text").mapInPandas(run, "id string, status int, answer string")
