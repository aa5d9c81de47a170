"""Benchmark decontamination (9): one Aho-Corasick automaton over the normalised windows of all items.

A word is a run of ASCII letters and digits and of any non-ASCII characters, A-Z lowered. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window. Texts are normalised to their words,
parted by single spaces, and scanned once, whole; offsets of a match map back to words and to characters of the original.

Null and empty texts have no words and no hits. Items without words, or a null item_id, never match (a null item_id is
left out). Items that share a window are all reported. Repeated rows give repeated results; other columns are ignored
or, in ``without_contaminated``, passed through; an empty table of documents gives an empty result, an empty benchmark no hit.

Tasks write the items to the shared folder, in blocks of about ``block_chars`` characters, and other tasks read them there: neither the driver nor
a plan ever holds the benchmark. A benchmark of up to one block is one automaton and one scan; a larger one is
scanned block by block, with one automaton in memory at a time, and gives the same rows.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.bytescan import WORDS
from gaugeworks.llm.shared import new_folder, open_file, put_file, written

WINDOW = 10
BLOCK_CHARS = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


def windows_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[str, list[str]]:
    """Normalised window (with a space at both ends, bytes as latin-1) to the ids of its items."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(f" {b' '.join(w[k : k + window]).decode('latin-1')} ", set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


def automaton(windows: dict[str, list[str]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, items in windows.items():
        a.add_word(k, (k.count(" ") - 1, items))
    if windows:
        a.make_automaton()
    return a


def scan(text: str | None, a) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word spans (from, to) and the items with windows that occur."""
    w = words_of(text)
    hits, items = [], set()
    if w and len(a):
        line = f" {b' '.join(w).decode('latin-1')} "
        seen, spaces = 0, 0
        for end, (n, of) in a.iter(line):
            spaces += line.count(" ", seen, end)  # the words up to the match's last one
            seen = end
            hits.append((spaces - n, spaces))
            items.update(of)
    return len(w), hits, items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of characters of the original text."""
    if not spans:
        return []
    raw = text.encode("utf-8", "replace")
    norm = np.frombuffer(raw.translate(WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], norm, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in spans]


def item_blocks(benchmark: DataFrame, block_chars: int) -> list[str]:
    """Files of the items in the shared folder; each of about block_chars characters, the most that one automaton takes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    folder, n = new_folder(benchmark.sparkSession, "items"), max(1, -(-chars // block_chars))

    def write(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist()))
        return pa.table({"path": [put_file(folder, f"{uuid.uuid4().hex}.items", pickle.dumps(rows))]})

    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).groupBy("block").applyInArrow(write, "path string")
    return [r[0] for r in written(blocks, "item-blocks").collect()]


SPAN = ("from_word", "to_word", "from_char", "to_char")
RESULT = "n_words long, spans array<struct<from_word: int, to_word: int, from_char: int, to_char: int>>, items array<string>"


def _scanner(paths: list[str], window: int, only_clean: bool):
    """A mapInArrow function over rows with a text: what contamination() returns, or the clean rows as they came.

    One automaton is built once; of many blocks, one automaton at a time goes over a batch, and a row's hits are joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build(path: str):
            with open_file(path) as file:
                return automaton(windows_of(pickle.loads(file.read()), window))

        only = build(paths[0]) if len(paths) == 1 else None
        for batch in batches:
            texts = batch.column("text")
            found: list[tuple[int, list[tuple[int, int]], set[str]]] = [(0, [], set())] * len(texts)
            for path in paths:
                a = only if only is not None else build(path)
                for k, t in enumerate(texts):
                    n, hits, items = scan(t.as_py(), a)
                    found[k] = (n, found[k][1] + hits, found[k][2] | items)
            if only_clean:
                yield batch.filter(pa.array([not hits for _, hits, _ in found], pa.bool_()))
                continue
            spans = [[dict(zip(SPAN, (*s, *c))) for s, c in zip(w, char_spans(t.as_py(), w))] if (w := joined(hits)) else [] for t, (_, hits, _) in zip(texts, found)]
            columns = [batch.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, pa.list_(pa.struct([(k, pa.int32()) for k in SPAN]))), pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, spans (word and character offsets of maximal hit runs), items, for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scanner(item_blocks(benchmark, block_chars), window, False), f"doc_id {kind}, {RESULT}")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, that hold no window of any item. No shuffle: each row is judged where it lies."""
    return docs.mapInArrow(_scanner(item_blocks(benchmark, block_chars), window, True), docs.schema)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["to_word"] - s["from_word"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
        FROM item, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM doc, lens, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k) WHERE len(w) >= n),
hit AS (SELECT DISTINCT p.doc_id, p.k, p.n, win.item_id FROM places p JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
