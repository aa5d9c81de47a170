"""Review files of a wanted length: a target document among others, whole but for the last, at a wanted depth.

All documents lie on a ring in the order of a hash, each at the sum of tokens before it. A draw begins at a place of the ring and takes what follows, so its others are a stretch of running sums: the ring is cut into blocks of
tokens, a draw meets the two or three blocks that its stretch touches, and no draw meets the whole table. Lengths, depth and slot are arithmetic on counts; texts join only what was taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.operators.packing import numbered
from gaugeworks.operators.suite import capped

#: The share of a bucket's size that a draw aims at, less SPARE at the upper end; the share that a file may have; tokens that a block's frame is taken for, of the target and of others; the least room worth an excerpt.
AIM, SHARE, SPARE, FRAME_TARGET, FRAME, ROOM = (0.86, 0.93), (0.80, 0.93), 64, 40, 30, 300
#: Tokens of a block of the ring; places summed up by one task.
STRETCH, BLOCK = 1 << 16, 1 << 16
EXCERPT = " (excerpt; the rest is not in this file)"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _unit(seed: str, *parts: str) -> Column:
    """A number from 0 to below 1 by a hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def draws(docs: DataFrame, sizes: Sequence[tuple[int, int]], n: int, depths: Sequence[float], seed: str, count: Callable[[Column], Column] = words) -> DataFrame:
    """draw, id, bucket, depth: of each (bucket, most tokens of a target) the first n documents of at most so many tokens, in order of a hash; depths in turn."""
    t = docs.select("id", count(F.coalesce("text", F.lit(""))).alias("_n"), F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("bucket"), F.lit(m).alias("most")) for b, m in sizes])).alias("_s")).where("_n > 0 and _n <= _s.most")
    t = t.select("id", "_s.bucket", F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")), 256).alias("_by"))
    t = capped(t, ["bucket"], n, ["_by", "id"]).withColumn("_k", F.row_number().over(W.partitionBy("bucket").orderBy("_by", "id")) - 1)
    depth = F.get(F.array(*map(F.lit, depths)), (F.col("_k") % len(depths)).cast("int"))
    return t.select(F.concat_ws("/", F.col("bucket").cast("string"), F.lpad(F.col("_k").cast("string"), 6, "0")).alias("draw"), "id", "bucket", depth.alias("depth"))


def ring(docs: DataFrame, seed: str, count: Callable[[Column], Column] = words) -> DataFrame:
    """docs (id, title, company) with tokens, chars, n (tokens with a frame), and at: the n of all before in the order of a hash. Summed in two steps."""
    text = F.coalesce("text", F.lit(""))
    t = docs.select("id", F.coalesce("title", F.lit("")).alias("title"), "company", count(text).cast("long").alias("tokens"), F.char_length(text).cast("long").alias("chars"), F.sha2(F.concat_ws("|", F.lit(seed), F.lit("ring"), F.col("id").cast("string")), 256).alias("_by"))
    t = numbered(t.withColumn("n", F.col("tokens") + FRAME), [], ["_by", "id"]).withColumn("_block", F.floor(F.col("place") / BLOCK))
    sums = t.groupBy("_block").agg(F.sum("n").alias("_n"))  # a row a block
    sums = sums.select("_block", F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("_block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("_in", within).join(sums, "_block").select("id", "title", "company", "tokens", "chars", "n", (F.col("_in") + F.col("_before")).alias("at"))


def cut(texts: DataFrame, keys: Sequence[str], count: Callable[[Column], Column] = words) -> DataFrame:
    """keys, paragraphs, chars: the most first paragraphs (parted by an empty line) of text that hold at most room tokens; nothing where none do or they are empty. count must add up over paragraphs, as words do."""
    p = texts.select(*keys, "room", F.posexplode(F.split("text", "\n\n")).alias("_p", "_t"))
    w = W.partitionBy(*keys).orderBy("_p")
    p = p.select(*keys, "room", "_p", F.sum(count(F.col("_t"))).over(w).alias("_n"), (F.sum(F.char_length("_t")).over(w) + 2 * F.col("_p")).alias("_c"))
    return p.where("_n <= room").groupBy(*keys).agg((F.max("_p") + 1).alias("paragraphs"), F.max("_c").alias("chars")).where("chars > 0")


def _taken(docs: DataFrame, placed: DataFrame, draws: DataFrame, seed: str, reach: float, count: Callable[[Column], Column]) -> DataFrame:
    """draw, i (from 0), id, title, chars, paragraphs (null: whole): the others of every draw."""
    total = placed.agg(F.sum("n")).first()[0] or 1
    start = F.floor(_unit(seed, "draw") * total)
    span = F.least((F.col("bucket") * reach).cast("long"), F.lit(total))
    d = draws.withColumn("_start", start).withColumn("_span", span)
    end = F.col("_start") + F.col("_span") - 1
    over = F.when(end >= total, F.sequence(F.lit(0).cast("long"), F.floor((end - total) / STRETCH))).otherwise(F.array().cast("array<bigint>"))
    blocks = F.array_distinct(F.concat(F.sequence(F.floor(F.col("_start") / STRETCH), F.floor(F.least(end, F.lit(total - 1)) / STRETCH)), over))
    d = d.withColumn("_block", F.explode(blocks))
    o = placed.select(F.floor(F.col("at") / STRETCH).alias("_block"), F.col("id").alias("_id"), F.col("title").alias("_title"), F.col("company").alias("_company"), "n", F.col("chars").alias("_chars"), "at")
    met = d.join(o, "_block").withColumn("_rel", F.pmod(F.col("at") - F.col("_start"), F.lit(total)))
    met = met.where((F.col("_rel") < F.col("_span")) & (F.col("_id") != F.col("id")) & ~F.col("_company").eqNullSafe(F.col("company")))
    w = W.partitionBy("draw").orderBy("_rel", "_id")
    met = met.withColumn("_run", F.sum("n").over(w)).withColumn("_left", F.col("fill") - F.col("tokens") - FRAME_TARGET - F.col("_run") + F.col("n"))
    fits = F.col("n") <= F.col("_left")
    met = met.withColumn("_k", F.row_number().over(w)).where((fits & ((F.col("_k") == 1) | (F.col("_left") >= ROOM))) | (~fits & (F.col("_left") >= ROOM)))
    met = met.select("draw", "_k", F.col("_id").alias("id"), F.col("_title").alias("title"), "_chars", (F.col("_left") - FRAME).alias("room"), fits.alias("_fits"))
    part = cut(met.where("not _fits").select("draw", "id", "room").join(docs.select("id", "text"), "id"), ["draw"], count)
    both = met.join(part, "draw", "left").where("_fits or paragraphs is not null")
    return both.select("draw", (F.col("_k") - 1).alias("i"), "id", "title", F.when(F.col("_fits"), F.col("_chars")).otherwise(F.col("chars")).alias("chars"), F.when(~F.col("_fits"), F.col("paragraphs")).alias("paragraphs"))


def _digits(k: Column) -> Column:
    return F.char_length(k.cast("string")).cast("long")


def _digits_to(k: Column) -> Column:
    """Digits of all numbers from 1 to k."""
    d = _digits(k)
    return (k + 1) * d - ((F.pow(F.lit(10.0), d) - 1) / 9).cast("long")


def bundles(docs: DataFrame, draws: DataFrame, seed: str, reach: float = 4.0, count: Callable[[Column], Column] = words) -> DataFrame:
    """draw, id, bucket, depth, documents, excerpts, state, state_tokens, target_depth, accepted.

    docs (id: one row an id, title, company, text) are the pool; draws (draw, id, bucket, depth) name targets among them. Others are of other companies (null is a company); the last one is cut at a paragraph where at least ROOM tokens
    are left. The target's slot is the one whose middle, by characters, is nearest to depth, the first of equals; target_depth is the share of tokens before that middle, at four digits. A draw is accepted where its tokens are within
    SHARE of its bucket. A draw looks at ``reach`` times its bucket of the ring: where that holds too little of other companies, the file is too short and not accepted, as the rule has it; draw again under another name. A draw with no other document is left out.
    """
    placed = ring(docs, seed, count)
    low, high = AIM
    aim = F.floor(F.col("bucket") * low + _unit(seed, "draw", "id") * (F.col("bucket") * high - SPARE - F.col("bucket") * low))
    d = draws.join(placed.select("id", "title", "company", "tokens", "chars"), "id").withColumn("fill", aim)
    taken = _taken(docs, placed, d, seed, reach, count)
    number = lambda c: F.char_length(c).cast("long")
    frame = len("=====  of :  =====\n") + len("Document ") + len("\n===== End of document  =====\n\n")  # but for numbers and title
    unit = F.col("chars") + number(F.col("title")) + F.when(F.col("paragraphs").isNotNull(), len(EXCERPT)).otherwise(0) + frame
    w = W.partitionBy("draw").orderBy("i")
    slots = taken.select("draw", (F.col("i") + 1).cast("long").alias("j"), F.sum(unit).over(w).alias("before")).union(taken.select("draw").distinct().select("draw", F.lit(0).cast("long"), F.lit(0).cast("long")))
    whole = taken.groupBy("draw").agg((F.count("*") + 1).alias("documents"), F.count("paragraphs").alias("excerpts"), F.sum(unit).alias("_units"))
    s = slots.join(whole, "draw").join(d, "draw")
    n = F.col("documents")
    preface = len("Review file:  documents, in no particular order.\n\n") + _digits(n)
    head = len("===== Document  of :  =====\n") + _digits(F.col("j") + 1) + _digits(n) + number(F.col("title"))
    start = preface + F.col("before") + 2 * _digits_to(F.col("j")) + F.col("j") * _digits(n) + head
    size = preface + F.col("_units") + F.col("chars") + number(F.col("title")) + frame + 2 * _digits_to(n) + n * _digits(n) - 1
    away = F.abs((start + F.col("chars") / 2) / size - F.col("depth"))
    best = s.groupBy("draw").agg(F.min(F.struct(away.alias("a"), F.col("j").alias("j"), start.alias("start"))).alias("_b"), F.first("documents").alias("documents"), F.first("excerpts").alias("excerpts"))
    best = best.select("draw", "documents", "excerpts", F.col("_b.j").alias("slot"), F.col("_b.start").alias("start"))
    rows = taken.join(best, "draw").select("draw", "documents", (F.col("i") + F.when(F.col("i") < F.col("slot"), 1).otherwise(2)).cast("long").alias("k"), "id", "title", "paragraphs")
    rows = rows.union(d.join(best, "draw").select("draw", "documents", (F.col("slot") + 1).cast("long"), "id", "title", F.lit(None).cast("int")))
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("paragraphs").isNull(), text).otherwise(F.array_join(F.slice(F.split(text, "\n\n"), 1, F.coalesce("paragraphs", F.lit(1))), "\n\n"))
    k = F.col("k").cast("string")
    block = F.concat(F.lit("===== Document "), k, F.lit(" of "), n.cast("string"), F.lit(": "), F.col("title"), F.when(F.col("paragraphs").isNotNull(), EXCERPT).otherwise(""), F.lit(" =====\n"), text, F.lit("\n===== End of document "), k, F.lit(" =====\n\n"))
    blocks = rows.join(docs.select("id", "text"), "id").select("draw", F.struct("k", block.alias("t")).alias("b")).groupBy("draw").agg(F.array_sort(F.collect_list("b")).alias("_blocks"))  # as long as a bucket, no longer
    out = blocks.join(best, "draw").join(d.select("draw", "id", "bucket", "depth", "chars"), "draw")
    state = F.concat(F.lit("Review file: "), n.cast("string"), F.lit(" documents, in no particular order.\n\n"), F.array_join(F.col("_blocks.t"), ""))
    out = out.withColumn("state", F.substring(state, F.lit(1), F.char_length(state) - 1)).withColumn("state_tokens", count(F.col("state")).cast("long"))
    middle = F.substring("state", F.lit(1), (F.col("start") + F.floor(F.col("chars") / 2)).cast("int"))
    share_low, share_high = (F.floor(F.col("bucket") * x) for x in SHARE)
    return out.select("draw", "id", "bucket", "depth", "documents", "excerpts", "state", "state_tokens", F.round(count(middle) / F.col("state_tokens"), 4).alias("target_depth"), F.col("state_tokens").between(share_low, share_high).alias("accepted"))
