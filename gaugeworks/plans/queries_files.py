"""Queries over files written from the given tables and read back, over records made of the embeddings, and over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import parsing
from gaugeworks.functions import text as T
from gaugeworks.operators import generate, reliability, reports
from gaugeworks.plans.registry import query
from gaugeworks.sources import files
from gaugeworks.sources.files import work_folder
from gaugeworks.sources.fixtures import SQL as PREDS
from gaugeworks.sources.fixtures import prediction_rows

WITH = f"WITH {PREDS}"


@query("s02_load_requests", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'g' || doc_id // 4 END AS group_id, CASE WHEN doc_id % 5 = 0 THEN 'own' ELSE source END AS source, 'clean' AS variant, CASE WHEN doc_id % 7 = 0 THEN 'no state' WHEN doc_id % 11 = 0 THEN 'no questions' WHEN doc_id % 13 = 0 THEN 'question without label' END AS problem, CASE WHEN doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) END AS state FROM documents")
def load_requests(spark, sf):
    """Documents as labelled requests in JSON lines, some of them faulty, read back with their defaults and problems."""
    k = F.col("doc_id")
    question = F.struct(F.lit("noul").alias("type"), F.when(k % 13 != 0, F.lit("true")).alias("label"))
    asked = F.when(k % 11 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<type:string,label:string>>"))).otherwise(F.create_map(F.lit("q"), question))
    meta = F.struct(k.cast("string").alias("id"), F.when(k % 3 != 0, F.concat(F.lit("g"), F.floor(k / 4).cast("string"))).alias("group_id"), F.when(k % 5 != 0, F.col("source")).alias("source"))
    folder = work_folder(spark)
    spark.read.parquet(f"{sf}/documents.parquet").select(F.to_json(F.struct(F.when(k % 7 != 0, F.coalesce("text", F.lit(""))).alias("state"), asked.alias("questions"), meta.alias("_meta")))).write.text(folder)
    return files.load_requests(spark, folder, "own").select("id", "group_id", "source", "variant", "problem", F.sha2("state", 256).alias("state"))


_SPLIT = "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 7 THEN 'calibration' WHEN doc_id % 10 < 8 THEN 'development' ELSE 'test' END"


def frozen(spark, sf):
    k = F.col("doc_id") % 10
    split = F.when(k < 6, "train").when(k < 7, "calibration").when(k < 8, "development").otherwise("test")
    folder = work_folder(spark)
    return files.freeze(spark.read.parquet(f"{sf}/documents.parquet").withColumn("split", split), folder), folder


@query("k02_frozen_suite", f"SELECT {_SPLIT} AS split, count(*) AS records FROM documents GROUP BY ALL")
def frozen_suite(spark, sf):
    """The manifest of documents frozen by split."""
    return frozen(spark, sf)[0].select("split", "records")


@query("s03_load_split", f"SELECT doc_id, source, sha256(coalesce(text, '')) AS text FROM documents WHERE {_SPLIT} = 'development'")
def load_split(spark, sf):
    """A split of the frozen suite, checked against its manifest."""
    _, folder = frozen(spark, sf)
    return files.load_split(spark, folder, "development").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))


@query("s16_verdicts", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE quality WHEN 1 THEN 'accept' ELSE 'drop' END AS verdict, CAST(toxic AS VARCHAR) AS label FROM labels WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def verdicts(spark, sf):
    """Labels as lines of verdicts among lines that are none: prose, torn JSON, an unknown verdict."""
    k = F.col("doc_id")
    good = F.to_json(F.struct(k.cast("string").alias("id"), F.when(k % 5 == 0, "maybe").when(F.col("quality") == 1, "accept").otherwise("drop").alias("verdict"), F.col("toxic").cast("string").alias("label")))
    folder = work_folder(spark)
    spark.read.parquet(f"{sf}/labels.parquet").select(F.when(k % 3 != 0, good).when(k % 2 == 0, F.concat(F.lit("note on "), k.cast("string"))).otherwise(F.substring(good, 1, 12))).write.text(folder)
    return files.read_verdicts(spark, folder).select("id", "verdict", "label")


@query("l09_neutral_tokens", r"SELECT doc_id, sha256('<a_1> ' || regexp_replace(coalesce(text, ''), '<\|([A-Za-z0-9_]+)\|>', '<\1>', 'g') || ' <end> <|no|' ) AS text FROM documents")
def neutral_tokens(spark, sf):
    t = F.concat(F.lit("<|a_1|> "), F.coalesce("text", F.lit("")), F.lit(" <|end|> <|no|"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(T.neutral_tokens(t), 256).alias("text"))


@query("l16_repeated_sentence", r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?][ \t\n\f\r]+'), lambda x: lower(trim(x))), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL) SELECT lang, count(*) AS n, count(*) FILTER (len(s) > len(list_distinct(s))) AS repeated FROM s JOIN documents USING (doc_id) GROUP BY lang")
def repeated_sentence(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(parsing.repeated_sentence(F.col("text"))).alias("repeated"))


@query("l21_tagged_lines", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ask' WHEN 1 THEN 'final' ELSE 'malformed' END AS kind, CASE WHEN event_id % 4 < 2 THEN event_type || ' ' || user_id END AS body FROM events")
def tagged_lines(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    tag = F.get(F.array(*map(F.lit, ("ASK:", "  FINAL : ", "Ask: ", ""))), (F.col("event_id") % 4).cast("int"))
    line = F.concat(tag, F.lit(" "), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")), F.lit("  "))
    return e.select("event_id", parsing.tagged_line(line).alias("t")).select("event_id", "t.kind", "t.body")


@query("l15_named_intents", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS longest, CASE WHEN event_id % 3 = 0 THEN event_type END AS only FROM events")
def named_intents(spark, sf):
    """The option that a sentence names: one, two of which the longer counts, or none."""
    names = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error", "vie", "clic")))
    only = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error", "also")))
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit("I would pick "), F.upper("event_type"), F.lit("."))).when(k == 1, F.concat(F.lit("Also "), "event_type")).otherwise(F.lit("No idea"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", parsing.named_option(said, names).alias("longest"), parsing.only_option(said, only).alias("only"))


@query("l23_confidence_features", f"{WITH} SELECT id, round(conf, 6) AS pmax, round(conf - list_sort(p)[9], 6) AS margin, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(10), 6) AS entropy, round(ln(10), 6) AS log_k FROM preds")
def confidence_features(spark, sf):
    return reliability.features(prediction_rows(spark, sf)).select("id", *[F.round(c, 6).alias(c) for c in reliability.FEATURES])


@query("p11_changed_settings", "SELECT o_orderkey AS job, CASE WHEN o_orderkey % 2 = 0 AND o_custkey <> 0 THEN 'lr=' || o_custkey ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ';new=1' ELSE '' END AS changed FROM orders")
def changed_settings(spark, sf):
    """Orders as trials with four settings: one often at its default, one unknown to the defaults, one of the infrastructure."""
    k = F.col("o_orderkey")
    config = F.map_filter(F.create_map(F.lit("lr"), F.when(k % 2 == 0, F.col("o_custkey").cast("string")).otherwise("0"), F.lit("new"), F.when(k % 3 == 0, "1"), F.lit("gpu"), F.col("o_orderstatus"), F.lit("seed"), F.lit("7")), lambda _, v: v.isNotNull())
    changed = reports.changed_settings(config, {"lr": "0", "seed": "7"}, ["gpu"])
    text = lambda name: F.try_element_at(changed, F.lit(name))
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("job"), F.concat(F.coalesce(F.concat(F.lit("lr="), text("lr")), F.lit("")), F.coalesce(F.concat(F.lit(";new="), text("new")), F.lit(""))).alias("changed"))


def records(spark, sf):
    """Embeddings as choice records of 2 to 5 options."""
    k = (F.col("vec_id") % 4 + 2).cast("int")
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.concat(F.lit("o"), i.cast("string"))).alias("keys"), (F.col("label") % k).cast("int").alias("label"), "vec_id")
    return t.withColumn("weights", F.when(F.col("vec_id") % 3 == 0, F.transform("keys", lambda _, i: (i + 1.0).cast("double"))))


RECORDS = "rec AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, list_transform(range(vec_id % 4 + 2), lambda i: 'o' || i) AS keys, CAST(label % (vec_id % 4 + 2) AS INTEGER) AS label FROM embeddings)"


def _order(keys: str, seed: int) -> str:
    return f"list_transform(list_sort(list_transform({keys}, lambda k: md5('{seed}:' || id || ':' || k) || k)), lambda s: s[33:])"


@query("g01_augmented", f"""WITH {RECORDS}, u AS (SELECT *, keys[label + 1] AS gold, CAST('0x' || substr(md5('0:' || id), 1, 10) AS BIGINT) / pow(2, 40) AS u FROM rec),
v AS (SELECT *, CASE WHEN u < 0.1 AND len(keys) > 2 THEN 'none' WHEN u >= 0.1 AND u < 0.22 THEN 'none_distractor' WHEN u >= 0.22 AND u < 0.37 THEN 'distractor' ELSE 'permuted' END AS variant FROM u),
o AS (SELECT *, CASE variant WHEN 'none' THEN list_append(list_filter(keys, lambda k: k <> gold), 'none') WHEN 'none_distractor' THEN list_append(keys, 'none') WHEN 'distractor' THEN list_append(keys, 'something else') ELSE keys END AS options FROM v),
p AS (SELECT *, {_order('options', 1)} AS perm FROM o) SELECT id, array_to_string(perm, '|') AS keys, CAST(list_position(perm, CASE WHEN variant = 'none' THEN 'none' ELSE gold END) - 1 AS INTEGER) AS label, variant FROM p""")
def augmented(spark, sf):
    return generate.augmented(records(spark, sf)).select("id", F.array_join("keys", "|").alias("keys"), "label", "variant")


@query("g02_none_pairs", f"""WITH {RECORDS}, p AS (SELECT id, keys[label + 1] AS gold, {_order("list_append(keys, 'none')", 0)} AS perm FROM rec)
SELECT id AS pair_id, 'a' AS sibling, array_to_string(perm, '|') AS keys, CAST(list_position(perm, gold) - 1 AS INTEGER) AS label FROM p UNION ALL
SELECT id, 'b', array_to_string(list_filter(perm, lambda k: k <> gold), '|'), CAST(list_position(list_filter(perm, lambda k: k <> gold), 'none') - 1 AS INTEGER) FROM p""")
def none_pairs(spark, sf):
    return generate.none_pairs(records(spark, sf)).select("pair_id", "sibling", F.array_join("keys", "|").alias("keys"), "label")


@query("g03_targets", f"WITH {RECORDS} SELECT id, array_to_string(list_transform(keys, lambda k, i: CAST(CAST(round(1000000 * CASE WHEN vec_id % 3 = 0 THEN i / (len(keys) * (len(keys) + 1) / 2) WHEN i = label + 1 THEN 1 ELSE 0 END) AS BIGINT) AS VARCHAR)), ' ') AS target FROM rec")
def targets(spark, sf):
    return generate.targets(records(spark, sf)).select("id", F.array_join(F.transform("target", lambda x: F.round(1_000_000 * x).cast("long").cast("string")), " ").alias("target"))


@query("o18_fitting_prefix", r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_transform(parts, lambda p: len(regexp_extract_all(p, '[^\x20\x09-\x0D]+'))) AS w FROM d),
n AS (SELECT doc_id, parts, len(list_filter(range(1, len(parts) + 1), lambda k: list_sum(w[1:k]) <= 100)) AS n FROM w)
SELECT doc_id, CASE WHEN n > 0 THEN sha256(array_to_string(parts[1:n], chr(10))) END AS prefix FROM n""")
def fitting_prefix(spark, sf):
    """Each document's longest run of whole lines with at most 100 words."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    return d.select("doc_id", F.sha2(T.fitting_prefix(F.col("text"), 100, "\n"), 256).alias("prefix"))
