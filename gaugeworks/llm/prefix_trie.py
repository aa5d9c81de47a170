"""Conversation prefix trie (13): each conversation's first owned depth by binary search through joins, then chains summed bottom-up.

A node of depth d is a distinct sequence of the first d turns (role, text) of conversations, the root is the empty one; its members are the conversations that start with it, and its
smallest member owns it. A conversation that owns a prefix owns all its longer ones, since their members are fewer and it is among them: what it owns is a chain of nodes from its first
owned depth to its length, and all chains together are the tree.

1. Turns are numbered, and every prefix gets a digest: 128 bits in sums of hashes of (position, turn), so that prefixes of a conversation of any length are running sums in two steps
   (over blocks of BLOCK turns, then within each). A table of minima keeps the smallest conversation, the number of members and the words of the last turn for each (depth, digest).
2. Uniform binary search, all conversations at once: with k falling, depth lo + 2**k is looked up, first the conversation's digest there, then the digest's minimum; where another conversation is
   smaller, lo rises. Round k only meets depths with k trailing zeros, so the tables are written by that number and each row is read in one round.
3. What a chain adds by itself (its last node if childless, and tokens saved at its nodes) is summed over the chains that hang from it, from the bottom up in doubled steps: after round k
   a chain holds the sums of all chains less than 2**(k+1) steps below, so the rounds grow with the logarithm of the chains' depth.
4. Nodes get the sums below them in their own chain (running sums in two steps again) and those of the chains that hang there.

Ends of a node: a hash needs its members' ids in order, so they are packed by ranges into texts first; one task then runs over a node's packed texts one by one and keeps none.

Order within a conversation: by turn, null first, then by a digest of role and text. A null role or text is empty; rows with a null conv_id belong to no conversation. Repeated rows are turns of
their own. Conversations without turns are members of the root alone. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.llm.shared import new_folder, written

#: Turns of a conversation that one window sums; characters of packed ids in a row.
BLOCK, PIECE = 4096, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
#: The dealt rebuilding: conversations by twenties share the first crc32 % 4 turns of the first of them.
FAMILY, HEADS = 20, 4


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), turn_digest, words: the turns of each conversation in order. Numbers come in two steps over ranges, so a conversation of any length is many tasks' work."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    # written, since a range's number must not change when a lost executor's part is made again
    t = written(t.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "turn_digest").withColumn("_range", F.spark_partition_id()), "trie-turns")
    counts = t.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"))
    before = counts.select("conv_id", "_range", F.coalesce(F.sum("_n").over(W.partitionBy("conv_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("conv_id", "_range").orderBy(F.col("turn").asc_nulls_first(), "turn_digest"))
    return t.withColumn("_in", within).join(before, ["conv_id", "_range"]).select("conv_id", (F.col("_in") + F.col("_before")).alias("at"), "turn_digest", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns() with each conversation's head taken from the first of its family; and conv_id, length of every conversation, turnless ones too."""
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = own.groupBy("conv_id").agg(F.max("at").alias("n")).select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    tails = own.join(convs.select("conv_id", "h", "given"), "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("given")).alias("at"), "turn_digest", "words")
    first = own.where(F.col("at") < HEADS).withColumnRenamed("conv_id", "base")
    heads = convs.where("given > 0").select("conv_id", "base", "given").join(first, "base").where("at <= given").select("conv_id", "at", "turn_digest", "words")
    return tails.unionByName(heads), convs.select("conv_id", "length")


def running(df: DataFrame, key: str, at: str, values: list[str], falling: bool = False) -> DataFrame:
    """df with sum_<value>: the running sums of each value within key by at (from 0 on), in two steps over blocks of BLOCK."""
    df = df.withColumn("_block", F.floor(F.col(at) / BLOCK))
    order = (lambda c: F.col(c).desc()) if falling else F.col
    blocks = df.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    past = W.partitionBy(key).orderBy(order("_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", *[F.coalesce(F.sum(f"_{v}").over(past), F.lit(0)).alias(f"_{v}") for v in values])
    within = W.partitionBy(key, "_block").orderBy(order(at)).rowsBetween(W.unboundedPreceding, 0)
    for v in values:
        df = df.withColumn(f"sum_{v}", F.sum(v).over(within))
    df = df.join(blocks, [key, "_block"])
    for v in values:
        df = df.withColumn(f"sum_{v}", F.col(f"sum_{v}") + F.col(f"_{v}"))
    return df.drop("_block", *[f"_{v}" for v in values])


def prefixes(turns_: DataFrame) -> DataFrame:
    """conv_id, at, digest (of the prefix up to at), words, level (trailing zeros of at)."""
    hash_ = lambda k: F.xxhash64(F.lit(k), F.col("at"), F.col("turn_digest"))
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    # 32 bits at a time: sums of 2**31 turns stay within a long
    t = turns_.withColumn("x", hash_(1)).withColumn("y", hash_(2))
    t = t.select("conv_id", "at", "words", low(F.col("x")).alias("a"), F.shiftrightunsigned("x", 32).alias("b"), low(F.col("y")).alias("c"), F.shiftrightunsigned("y", 32).alias("d"))
    t = running(t, "conv_id", "at", ["a", "b", "c", "d"])
    return t.select("conv_id", "at", F.unhex(F.md5(F.concat_ws(",", "sum_a", "sum_b", "sum_c", "sum_d"))).alias("digest"), "words", _level(F.col("at")).alias("level"))


def _level(at: Column) -> Column:
    """Trailing zeros of a number from 1 on."""
    return F.round(F.log2(at.bitwiseAND(-at).cast("double"))).cast("int")


def _by_level(df: DataFrame, name: str) -> DataFrame:
    """df in the shared folder, a folder a level, so that a round of the search reads its own level alone."""
    at = new_folder(df.sparkSession, name)
    df.write.partitionBy("level").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def first_owned(convs: DataFrame, own_prefixes: DataFrame, minima: DataFrame, root: int) -> DataFrame:
    """conv_id, length, lo, above: the greatest depth that a conversation does not own (0 where that is the root), and who owns it."""
    state = convs.select("conv_id", "length", F.lit(0).cast("long").alias("lo"), F.lit(root).cast("long").alias("above"))
    longest = convs.agg(F.max("length")).first()[0] or 0
    for k in range(int(longest).bit_length() - 1, -1, -1):
        here = own_prefixes.where(F.col("level") == k).select("conv_id", F.col("at").alias("probe"), "digest")
        least = minima.where(F.col("level") == k).select(F.col("at").alias("probe"), "digest", "owner")
        probed = state.withColumn("probe", F.col("lo") + (1 << k)).join(here, ["conv_id", "probe"], "left").join(least, ["probe", "digest"], "left")
        lower = F.col("owner").isNotNull() & (F.col("owner") != F.col("conv_id"))
        state = written(probed.select("conv_id", "length", F.when(lower, F.col("probe")).otherwise(F.col("lo")).alias("lo"), F.when(lower, F.col("owner")).otherwise(F.col("above")).alias("above")), f"trie-search-{k}")
    return state


def summed_up(chains: DataFrame, root: int) -> DataFrame:
    """chains (conv_id, parent, leaves, saved) with the sums of all chains below added: doubled steps, bottom-up."""
    now = chains.withColumn("up", F.col("parent"))
    for k in range(64):
        if now.where("up is not null").limit(1).count() == 0:
            break
        add = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        # nothing is above the root's chain, where most chains soon arrive
        arrived = now.where(F.col("up").isNull() | (F.col("up") == root)).withColumn("up", F.lit(None).cast("long"))
        further = now.where(F.col("up") != root).withColumnRenamed("up", "_up").join(now.select(F.col("conv_id").alias("_up"), "up"), "_up").drop("_up")
        now = arrived.unionByName(further).join(add, "conv_id", "left")
        now = written(now.select("conv_id", "parent", (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"), "up"), f"trie-chains-{k}")
    return now.select("conv_id", "leaves", "saved")


def ends_hashed(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of ends (conv_id, depth, member): SHA-256 of the members' decimal ids, ascending, joined by commas."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, rows = None, [], 0, []
        for batch in batches:
            for conv, depth, member in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if node != (conv, depth) or size > PIECE:
                    if node is not None:
                        rows.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids, size = (conv, depth), [], 0
                ids.append(member)
                size += 20
            yield _rows(rows, ["conv_id", "depth", "first", "ids"])
            rows = []
        if node is not None:
            yield _rows([(*node, ids[0], ",".join(map(str, ids)))], ["conv_id", "depth", "first", "ids"])

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, rows = None, None, []
        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if node == (conv, depth):
                    sha.update(b",")
                else:
                    if node is not None:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = (conv, depth), hashlib.sha256()
                sha.update(ids.encode())
            yield _rows(rows, ["conv_id", "depth", "ends_sha256"])
            rows = []
        if node is not None:
            yield _rows([(*node, sha.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    ranged = ends.select("conv_id", "depth", "member").repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    packed = ranged.mapInArrow(pack, "conv_id long, depth long, first long, ids string")
    return packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hash_, "conv_id long, depth long, ends_sha256 string")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"ids": pa.string(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(n, pa.int64())) for k, n in enumerate(names)], names)


def trie(turns_: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node of the trie of turns (conv_id, at, turn_digest, words) of conversations (conv_id, length)."""
    spark = convs.sparkSession
    root, members = convs.agg(F.min("conv_id"), F.count("*")).first()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if root is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in columns))
    own = _by_level(prefixes(turns_), "trie-prefixes")
    # a group's minimum and count are taken by task first: a prefix that a third of all conversations share is no hot group
    minima = _by_level(own.groupBy("at", "digest", "level").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.max("words").alias("words")), "trie-minima")
    found = first_owned(convs, own, minima, root)

    owns = (F.col("lo") < F.col("length")) | (F.col("conv_id") == root)
    chains = found.where(owns).select("conv_id", "length", "lo", F.when(F.col("conv_id") != root, F.col("above")).alias("parent"))
    nodes = minima.select(F.col("owner").alias("conv_id"), F.col("at").alias("depth"), F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("words")).alias("gain"))
    nodes = nodes.unionByName(spark.range(1).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(members).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("gain")))

    hung = chains.where("parent is not null")
    below = hung.groupBy(F.col("parent").alias("conv_id"), F.col("lo").alias("length")).agg(F.lit(True).alias("_hung"))
    gains = nodes.groupBy("conv_id").agg(F.sum("gain").alias("saved"))
    alone = chains.join(below, ["conv_id", "length"], "left").join(gains, "conv_id", "left")
    sums = summed_up(written(alone.select("conv_id", "parent", F.when(F.col("_hung"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")), "trie-chains"), root)

    hanging = hung.select("conv_id", "parent", "lo").join(sums, "conv_id").groupBy(F.col("parent").alias("conv_id"), F.col("lo").alias("depth")).agg(F.count("*").alias("hanging"), F.sum("leaves").alias("h_leaves"), F.sum("saved").alias("h_saved"))
    nodes = nodes.join(hanging, ["conv_id", "depth"], "left").join(chains, "conv_id")
    last, none = F.col("depth") == F.col("length"), F.lit(0).cast("long")
    nodes = nodes.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("lo") + 1, F.col("parent")).when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("hanging", none) + F.when(last, none).otherwise(1)).alias("n_children"),
        F.coalesce("h_leaves", F.when(last, none + 1).otherwise(none)).alias("leaves"), (F.coalesce("h_saved", none) + F.col("gain")).alias("saved"),
    )
    # the root's own chain begins at the root: the node below it hangs from itself
    nodes = nodes.withColumn("parent_conv_id", F.when((F.col("conv_id") == root) & (F.col("depth") > 0), F.col("conv_id")).otherwise(F.col("parent_conv_id")))
    nodes = running(nodes, "conv_id", "depth", ["leaves", "saved"], falling=True).withColumnsRenamed({"sum_leaves": "n_leaves", "sum_saved": "saved_tokens"})

    ends = ends_hashed(found.select(F.when(owns, F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member")))
    out = nodes.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return out.select(*columns)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-own")
    return trie(*rebuilt(own))


#: CRC-32 of a decimal number's characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
ORACLE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(i) AS n, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.i AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
      UNION ALL SELECT c.conv_id, t.i - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE t.i > c.h),
p AS (SELECT conv_id, 0 AS d, '' AS k, 0 AS w FROM c
      UNION ALL SELECT conv_id, d, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM r),
node AS (SELECT d, k, min(conv_id) AS owner, count(*) AS n, max(w) AS w FROM p GROUP BY d, k),
m AS (SELECT conv_id, d, k, owner, n, node.w FROM p JOIN node USING (d, k)),
len AS (SELECT conv_id, max(d) AS l FROM p GROUP BY conv_id),
kids AS (SELECT a.d, a.k, count(DISTINCT b.owner) AS kids FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d = a.d + 1 GROUP BY a.d, a.k),
gain AS (SELECT m.conv_id, m.d, m.k, CASE WHEN m.owner = m.conv_id THEN (m.n - 1) * m.w ELSE 0 END AS g, CASE WHEN m.owner = m.conv_id AND kids.k IS NULL THEN 1 ELSE 0 END AS leaf FROM m LEFT JOIN kids USING (d, k)),
tail AS (SELECT d, k, sum(g) OVER below AS g, sum(leaf) OVER below AS leaf FROM gain WINDOW below AS (PARTITION BY conv_id ORDER BY d DESC ROWS UNBOUNDED PRECEDING)),
sums AS (SELECT d, k, sum(g) AS saved, sum(leaf) AS leaves FROM tail GROUP BY d, k),
ends AS (SELECT m.d, m.k, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM m JOIN len ON len.conv_id = m.conv_id AND len.l = m.d GROUP BY m.d, m.k)
SELECT node.owner AS conv_id, CAST(node.d AS BIGINT) AS depth, up.owner AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN kids USING (d, k) JOIN sums USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN (SELECT conv_id AS child, d AS up_d, owner FROM m) up ON up.child = node.owner AND up.up_d = node.d - 1
"""
