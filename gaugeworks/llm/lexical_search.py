"""Ranked lexical search (12): Fagin's threshold algorithm over impact-sorted lists, shard by shard.

Terms are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered. The score of a document for an item is a sum of impacts, one for
each distinct term of the item: weight of the term (from how many documents hold it) times a saturating share of its occurrences, in integers.

1. One pass over the documents counts the terms of each and keeps, as its forward list, those that any item has, with their occurrences. It is written to the shared folder.
2. From the forward lists come how many documents hold each term, how many documents have terms, and all terms with repeats; weights are a small table, written too.
3. A task takes forward lists, about ``shard_postings`` entries at a time, as a shard: it sorts each term's list by falling impact and keeps the forward lists by document. For each
   item it reads the lists of the item's terms round-robin (in rounds of a growing depth), looks up the whole score of each document that it meets first in the
   forward lists, and stops as soon as the threshold, the sum of the impacts at the depth reached, lies strictly below the k-th best score: no document not yet met can then tie with it.
4. The best of all shards are merged in two steps, so no task sees the rows of more than a share of the shards.

Every document's score is looked at or bounded from above, nothing is sampled or cut, so the result is exact. Items come in blocks of about ``block_chars`` characters,
each of which takes the three passes; tasks read the items and the weights of a block from the shared folder.

Nulls and empty texts (documents or items) have no terms: such a document is no document of the statistics, such an item has no result. A null doc_id ranks after all others of
equal score; a null item_id is kept. Repeated rows of documents are documents of their own, repeated rows of items are items of their own. Other columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.llm.bytescan import WORDS
from gaugeworks.llm.shared import give_back, new_folder, written

TOP = 50
BLOCK_CHARS = 8 << 20
SHARD_POSTINGS = 4_000_000
#: Documents met in the first round from each list, and most of a later round.
FIRST_DEPTH, MOST_DEPTH = 64, 4096
#: Forward entries that are looked up at once.
AT_ONCE = 1 << 20


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0]-1, lo[1] .. hi[1]-1 and so on."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's weight times its share: tf occurrences in a document of n terms."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Shard:
    """Impact-sorted lists of terms 0 .. n_terms-1 and forward lists of documents 0 .. n_docs-1. tie ranks documents of equal score."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int, tie: np.ndarray):
        keep = impact > 0
        doc, term, impact = doc[keep], term[keep], impact[keep]  # doc rises: forward order
        self.tie, self.n_docs = tie, n_docs
        self.forward = np.searchsorted(doc, np.arange(n_docs + 1))
        self.forward_term, self.forward_impact = term, impact
        order = np.lexsort((tie[doc], -impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.lists = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.wanted, self.met = np.zeros(n_terms, bool), np.zeros(n_docs, bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random access: the forward lists of docs, summed over the wanted terms."""
        lo, hi = self.forward[docs], self.forward[docs + 1]
        out = np.zeros(len(docs), np.int64)
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(docs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            f = ranges(lo[at:to], hi[at:to])
            sums = np.concatenate([[0], np.cumsum(np.where(self.wanted[self.forward_term[f]], self.forward_impact[f], 0))])
            n = np.concatenate([[0], np.cumsum(hi[at:to] - lo[at:to])])
            out[at:to] = sums[n[1:]] - sums[n[:-1]]
            at = to
        return out

    def top(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for distinct terms, and their scores, best first."""
        terms = terms[self.lists[terms] < self.lists[terms + 1]]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return best, score
        lo, end = self.lists[terms], self.lists[terms + 1]
        self.wanted[terms] = True
        touched, depth = [], FIRST_DEPTH
        while True:
            hi = np.minimum(lo + depth, end)
            docs = np.unique(self.list_doc[ranges(lo, hi)])
            docs = docs[~self.met[docs]]
            self.met[docs] = True
            touched.append(docs)
            best, score = np.concatenate([best, docs]), np.concatenate([score, self.scores(docs)])
            order = np.lexsort((self.tie[best], -score))[:k]
            best, score = best[order], score[order]
            threshold = int(np.where(hi < end, self.list_impact[hi - 1], 0).sum())
            if bool((hi == end).all()) or len(best) == k and threshold < score[-1]:
                break
            lo, depth = hi, min(MOST_DEPTH, 2 * depth)
        self.wanted[terms] = False
        self.met[np.concatenate(touched)] = False
        return best, score


def _read(path: str) -> pa.Table:
    """A table that Spark wrote to the shared folder. Runs on executors."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return pq.read_table(at, filesystem=store)


def _vocabulary(items: pa.Table) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Number of each term of the items (by order of bytes), and each item's distinct terms."""
    words = [sorted(set(terms_of(t))) for t in items.column("text").to_pylist()]
    number = {w: k for k, w in enumerate(sorted(set().union(*words)))}
    return number, [np.array([number[w] for w in ws], np.int64) for ws in words]


def _forward(path: str):
    """A mapInArrow function: doc_id, n and the forward list (term, tf) of every document with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, _ = _vocabulary(_read(path))
        get, many = number.get, len(number) + 1
        for batch in batches:
            lengths, found = [], []
            for k, text in enumerate(batch.column("text")):
                words = terms_of(text.as_py())
                lengths.append(len(words))
                found.append(np.fromiter(map(get, words, [many - 1] * len(words)), np.int64, len(words)) + k * many)
            keys, tf = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            known = keys % many < many - 1
            keys, tf = keys[known], tf[known]
            at = np.searchsorted(keys, np.arange(len(lengths) + 1) * many).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((keys % many).astype(np.int32), tf.astype(np.int64))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])
            yield out.filter(pc.greater(out.column("n"), 0))
        give_back()

    return run


def _searcher(items_path: str, weights_path: str, n_docs: int, n_terms: int, top: int, shard_postings: int):
    """A mapInArrow function over forward lists: item, doc_id, score of the best of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = _read(items_path), _read(weights_path)
        number, terms = _vocabulary(items)
        names = items.column("item").to_numpy()
        weight = np.zeros(len(number) + 1, np.int64)
        weight[weights.column("term").to_numpy()] = weights.column("weight").to_numpy()

        def searched(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids = t.column("doc_id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            lists = t.column("term").combine_chunks()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            term, tf = pc.list_flatten(lists).to_numpy(), pc.list_flatten(t.column("tf").combine_chunks()).to_numpy()
            doc = np.repeat(np.arange(len(size)), size)
            tie = np.empty(len(size), np.int64)
            tie[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(size))
            n = t.column("n").to_numpy()[doc]
            shard = Shard(doc, term, impacts(weight[term], tf, n, n_docs, n_terms), len(size), len(number), tie)
            for k, of in enumerate(terms):
                best, score = shard.top(of, top)
                if len(best):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), names[k])), ids.take(pa.array(best)), pa.array(score)], ["item", "doc_id", "score"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(pc.list_flatten(batch.column("term")))
            if size >= shard_postings:
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)
        give_back()

    return run


def _block(docs: DataFrame, items: DataFrame, top: int, shard_postings: int) -> DataFrame:
    """item, doc_id, score: the best documents of each shard for a block of items (item, text)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    items_path, weights_path = new_folder(spark, "search-items"), new_folder(spark, "search-weights")
    items.write.parquet(items_path)
    forward = written(docs.mapInArrow(_forward(items_path), f"doc_id {kind}, n long, term array<int>, tf array<long>"), "search-forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ratio = F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)
    held = forward.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    held.select("term", F.floor(1000 * F.ln(ratio)).cast("long").alias("weight")).write.parquet(weights_path)
    return forward.mapInArrow(_searcher(items_path, weights_path, n_docs, n_terms, top, shard_postings), f"item long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents (all with a score above 0, if fewer than top) of every row of items."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")), "search-all-items")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    found = None
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else items
        part = _block(docs, own.select("item", "text"), top, shard_postings)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # a share of each item's rows at a time, then the best of these
    found = found.withColumn("_share", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    found = found.withColumn("_best", F.row_number().over(W.partitionBy("item", "_share").orderBy(*order))).where(F.col("_best") <= top)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", F.col("doc_id").cast("long"), "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
t AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, nd),
x AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l)))) AS impact FROM p JOIN t USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY item_id, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
