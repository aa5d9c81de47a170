"""Queries over admission with re-selection and over what earlier suites have reserved."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import text as T
from gaugeworks.operators import selection
from gaugeworks.operators.packing import cut_off
from gaugeworks.plans.queries_suite import NORM
from gaugeworks.plans.registry import query

#: Records of a source in a split, in the order in which splits choose; records of a group in one pool; characters of a record.
QUOTAS, PER_GROUP, CONTEXT = {"0-test": 20, "1-development": 20, "2-train": 5000}, 2, 4000
PAIRS = 400

_DIGEST = f"sha256({NORM})"


def candidates(spark, sf):
    """Documents as candidates: groups are dealt to splits by a hash, languages are strata, one candidate of a state in a source."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    group = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.floor(F.col("id") / 20).cast("string"))
    own = F.when(F.coalesce(T.normalised(F.col("text")), F.lit("")) == "", "empty").when(F.char_length("text") > CONTEXT, "context")
    d = d.select("id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("stratum"), group.alias("group"), T.digest(F.col("text")).alias("state"), own.alias("own"))
    d = selection.first_of_state(d, ["source", "state"])
    digit = F.substring(F.sha2("group", 256), 1, 1)
    test, development, train = QUOTAS
    split = F.when(digit < "4", test).when(digit < "8", development).otherwise(train)
    quota = F.create_map(*[F.lit(x) for pair in QUOTAS.items() for x in pair])
    return d.select("id", F.concat_ws("|", split, "source").alias("pool"), quota[split].alias("quota"), "stratum", F.array("state").alias("keys"), "group", "own", F.sha2(F.concat(F.lit("select|"), F.col("id").cast("string")), 256).alias("ord"))


@query(
    "d13_admitted",
    f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS stratum, coalesce(lang, '') || '/' || (doc_id // 20) AS grp, {_DIGEST} AS state,
 CASE WHEN coalesce({NORM}, '') = '' THEN 'empty' WHEN length(text) > {CONTEXT} THEN 'context' END AS own FROM documents),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source, state ORDER BY doc_id) = 1),
p AS (SELECT *, CASE WHEN sha256(grp)[1] < '4' THEN '0-test' WHEN sha256(grp)[1] < '8' THEN '1-development' ELSE '2-train' END AS split, sha256('select|' || doc_id) AS ord FROM f),
c AS (SELECT *, dense_rank() OVER (ORDER BY split || '|' || source) AS pool, CASE split {" ".join(f"WHEN '{s}' THEN {n}" for s, n in QUOTAS.items())} END AS quota FROM p),
sel AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS turns
 UNION ALL SELECT k, any_value(taken) || coalesce(list(state) FILTER (ok AND v <= quota), []), coalesce(list(doc_id) FILTER (ok AND v <= quota), []), coalesce(list(turn) FILTER (ok AND v <= quota), []) FROM
 (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY turn, stratum) AS v FROM
  (SELECT *, row_number() OVER (PARTITION BY ok, stratum ORDER BY ord, doc_id) - 1 AS turn FROM
   (SELECT *, free AND row_number() OVER (PARTITION BY grp, free ORDER BY ord, doc_id) <= {PER_GROUP} AS ok FROM
    (SELECT sel.k + 1 AS k, sel.taken, c.doc_id, c.stratum, c.grp, c.state, c.quota, c.ord, c.own IS NULL AND NOT list_contains(sel.taken, c.state) AS free FROM sel JOIN c ON c.pool = sel.k + 1)))) GROUP BY k),
s AS (SELECT unnest(ids) AS doc_id, unnest(turns) AS turn FROM sel)
SELECT s.doc_id, c.split || '|' || c.source AS pool, c.stratum, s.turn FROM s JOIN c ON c.doc_id = s.doc_id""",
)
def admitted(spark, sf):
    """Documents in three splits of every source, in turns over languages: no state twice, at most two of a group in a pool, short enough."""
    offered = selection.choose(candidates(spark, sf), ["ord"], PER_GROUP)
    return offered.where("status = 'chosen'").select(F.col("id").alias("doc_id"), "pool", "stratum", "turn")


@query("d13_refusals")
def refused(spark, sf):
    """How many documents each pool chose, and how many it refused for what, where every tenth state fails in its final form: the choice is made again without those."""
    rows = selection.written(candidates(spark, sf))  # texts are read and digested once
    pools = F.element_at(F.split("pool", r"\|"), 1)
    failing = rows.where(F.conv(F.substring(F.element_at("keys", 1), 1, 4), 16, 10).cast("long") % 10 == 0).select("id")
    failing = selection.written(failing)
    rows = rows.withColumn("pool", pools)  # one pool a split, sources as strata
    offered = selection.choose(rows.withColumn("stratum", F.col("group")), ["ord"], PER_GROUP, lambda chosen: chosen.join(failing, "id"))
    return selection.refusals(offered)


def pairs(spark, sf):
    """Orders as pairs of states, their first and their last line's part; the first line's return flag is the family."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("line"))
    lines = lines.groupBy("id").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    pool = F.when(F.col("a.l_returnflag") == "A", 0).when(F.col("a.l_returnflag") == "N", 1).otherwise(2)
    keys = F.array_distinct(F.array(F.col("a.l_partkey").cast("string"), F.col("b.l_partkey").cast("string")))
    return lines.select("id", pool.alias("pool"), F.lit(PAIRS).cast("long").alias("quota"), F.lit("").alias("stratum"), keys.alias("keys"), F.lit(None).cast("string").alias("group"), F.lit(None).cast("string").alias("own"), F.sha2(F.concat(F.lit("pair|"), F.col("id").cast("string")), 256).alias("ord"))


@query("d14_unique_pairs")
def unique_pairs(spark, sf):
    """The first pairs of each family, up to its quota, that share no state with a pair admitted before."""
    return selection.choose(pairs(spark, sf), ["ord"])


_STATES = "o_orderkey, 'buyer ' || o_custkey AS who, o_orderpriority AS how, o_orderstatus AS status, o_custkey % 1000 AS place, year(o_orderdate) AS y"


@query(
    "d04_fresh_records",
    f"""WITH s AS (SELECT {_STATES} FROM orders), f AS (SELECT *, sha256(lower(CASE WHEN length(who) >= length(how) THEN who ELSE how END)) AS fingerprint FROM s), old AS (SELECT * FROM f WHERE y <= 1995)
SELECT o_orderkey, fingerprint FROM f WHERE y >= 1996 AND fingerprint NOT IN (SELECT fingerprint FROM old) AND NOT EXISTS (SELECT 1 FROM old WHERE old.how = f.how AND old.status = f.status AND old.place = f.place)""",
)
def fresh_records(spark, sf):
    """Orders from 1996 on whose longest text and whose origin no earlier order has."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    who = F.concat(F.lit("buyer "), F.col("o_custkey").cast("string"))
    state = F.to_json(F.struct(F.struct(who.alias("who"), F.col("o_custkey").alias("number")).alias("order"), F.array("o_orderpriority", "o_orderstatus").alias("tags")))
    rows = o.select("o_orderkey", selection.fingerprint(state).alias("fingerprint"), F.col("o_orderpriority").alias("repo"), F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 1000).cast("string").alias("row"), F.year("o_orderdate").alias("y"))
    return selection.fresh(rows.where("y >= 1996"), rows.where("y <= 1995"), [["fingerprint"], ["repo", "split", "row"]]).select("o_orderkey", "fingerprint")


@query(
    "j19_training_states",
    f"""WITH d AS (SELECT doc_id, {_DIGEST} AS text_sha256, sha256('split|' || doc_id)[1] AS digit FROM documents)
SELECT doc_id FROM d WHERE digit >= 'c' AND text_sha256 IN (SELECT text_sha256 FROM d WHERE digit < 'c' AND text_sha256 IS NOT NULL)""",
)
def training_states(spark, sf):
    """Documents of the development part whose state the training or calibration part has."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    digit = F.substring(F.sha2(F.concat(F.lit("split|"), F.col("doc_id").cast("string")), 256), 1, 1)
    # texts are read and digested once; what is joined are narrow rows
    d = cut_off(d.select("doc_id", T.digest(F.col("text")).alias("text_sha256"), F.when(digit < "8", "train").when(digit < "c", "calibration").otherwise("development").alias("split")))
    return d.where("split = 'development'").join(selection.training_states(d), "text_sha256", "left_semi").select("doc_id")
