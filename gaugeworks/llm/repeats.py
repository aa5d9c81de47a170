"""Suffix-array dedup (6): every byte that is covered by a ``span``-byte string which also starts elsewhere goes.

All distinct texts are covered, whole; equal texts are one unit, known by their md5 (a text of ``span`` bytes or more that has a copy goes wholly).

1. Each window of ``span`` bytes is tied to its anchor, the k-gram of least hash in it (the leftmost of equals), so equal windows have equal anchors at the same
   offset. The windows of one anchor are consecutive: a stretch. One pass finds stretches and deals out, by the anchor's hash, two hashes (of anchor and stretch), no text.
2. Where an anchor occurs once, none of its windows repeats. Of stretches with equal hashes (a kind) two go on, of others each one; their bytes are fetched. Further members of a kind
   are known by it.
3. There suffixes are sorted: a mergesort whose comparisons find the common extension of two suffixes by binary search on prefix
   polynomial hashes, so a comparison takes a logarithm of the length. It runs over all pairs of a merge step at once in numpy. Suffixes from the
   anchor on and, reversed, prefixes up to it are sorted; common extensions of neighbours are verified on the bytes, and a hash collision makes the step sort by
   bytes. A window repeats when another has the same class in both orders, for its two parts' lengths. So each kind of repeated bytes passes the sort and its verification.
4. The removed ranges are joined back to the documents by md5. AQE splits the join where one text is very common.

That a third and further stretch is of a kind rests on two 64-bit hashes, of the anchor and of the stretch with its place; all else is verified on bytes.
A close look takes the stretches of one anchor in parts of ``AT_ONCE``: each part of them sorted against each other part, so what is held is bounded.

Null and empty texts have no bytes; a null doc_id is kept as it is. Repeated rows are copies. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.bytescan import BASE, INVERSE, by_bucket, joined, mixed, powers, runs, text_buffer
from gaugeworks.llm.shared import written

SPAN, GRAM = 200, 64
#: Text bytes of a numpy step; text bytes for each hash range; stretches compared at a time.
STEP, RANGE_BYTES, AT_ONCE = 1 << 20, 16 << 20, 40_000


def stretches(data: np.ndarray, at: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: row, anchor (from the text's start), its distance from the first and last window, hash of the anchor and of the stretch."""
    n, wide = len(data), span - gram + 1
    empty = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < span:
        return empty
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    back = powers(INVERSE, n + 1)
    hashes = mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    bits = np.uint64(int(n).bit_length())
    value = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.full(-(-len(value) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(value)] = value
    blocks = blocks.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    windows = n - span + 1
    least = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
    inside = np.zeros(windows + 1, np.int32)
    full = np.flatnonzero(np.diff(at) >= span)
    np.add.at(inside, at[full], 1)
    np.add.at(inside, at[full + 1] - span + 1, -1)
    p = np.flatnonzero(np.cumsum(inside[:windows]))
    if not len(p):
        return empty
    anchor = (least[p] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)]))
    p0, p1, anchor = p[new], p[np.append(new[1:], len(p)) - 1], anchor[new]
    row = np.searchsorted(at, anchor, "right") - 1
    whole = mixed((sums[p1 + span] - sums[p0]) * back[p0] + ((anchor - p0) * 1024 + (anchor - p1)).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return row, anchor - at[row], anchor - p0, anchor - p1, hashes[anchor], whole


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def _first_rows(keys: np.ndarray) -> np.ndarray:
    """Which rows are the first with their key."""
    o = np.lexsort((np.arange(len(keys)), keys[:, 1], keys[:, 0]))
    k = keys[o]
    out = np.zeros(len(keys), bool)
    out[o[np.concatenate([[True], (k[1:] != k[:-1]).any(1)])]] = True
    return out


def _deal(span: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(_first_rows(_keys(batch.column("key")))))
            data, at = text_buffer(batch.column("text"))
            keys = _keys(batch.column("key"))
            for lo, hi in runs(at, STEP, 65535):
                row, place, left, right, h, whole = stretches(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], span, gram)
                rows = [(b, keys[lo + d].tobytes(), n.astype("<u4").tobytes(), place[e].astype("<u4").tobytes(), left[e].astype("<u2").tobytes(), right[e].astype("<u2").tobytes(), h[e].tobytes(), whole[e].tobytes()) for b, d, n, e in by_bucket((h % np.uint64(buckets)).astype(np.int64), row, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 7)], ["bucket", "keys", "counts", "place", "left", "right", "h", "whole"])

    return run


def _marks(buckets: int):
    """A range of anchors: stretches that repeat wholly (1), and those to look at closer (2), dealt out by text."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = joined(table.column("keys"), "<u8").reshape(-1, 2), joined(table.column("counts"), "<u4")
        place, left, right, h, whole = (joined(table.column(c), k) for c, k in (("place", "<u4"), ("left", "<u2"), ("right", "<u2"), ("h", "<u8"), ("whole", "<u8")))
        doc = np.repeat(np.arange(len(keys)), counts)
        # copies of a text, and pieces of one text that came in several parts, differ in nothing here: keep one of each (key, place)
        o = np.lexsort((place, keys[doc, 1], keys[doc, 0]))
        k, at = keys[doc[o]], place[o]
        again = np.concatenate([[False], (k[1:] == k[:-1]).all(1) & (at[1:] == at[:-1])])
        mine = o[~again]
        mine = mine[np.lexsort((whole[mine], h[mine]))]
        hs, ws = h[mine], whole[mine]
        new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
        new_w = new_h | np.concatenate([[True], ws[1:] != ws[:-1]])
        of_h, of_w = np.cumsum(new_h) - 1, np.cumsum(new_w) - 1
        repeats = np.bincount(of_w)[of_w] > 1
        shared = np.bincount(of_h)[of_h] > 1  # stretches whose anchor another one has
        nth = np.arange(len(of_w)) - np.flatnonzero(new_w)[of_w] if len(of_w) else of_w  # within its kind
        look = shared & (nth < 2)
        mark = (repeats & ~look).astype(np.uint8) + 2 * look.astype(np.uint8)
        keep = mark > 0
        mine, mark = mine[keep], mark[keep]
        # one number for each text, so that its marks come together
        names, of = np.unique(keys[doc[mine]], axis=0, return_inverse=True)
        of = of.reshape(-1)
        o = np.argsort(of, kind="stable")
        mine, mark, of = mine[o], mark[o], of[o]
        group = (mixed(names[:, 0] ^ names[:, 1]) % np.uint64(buckets)).astype(np.int64) if len(names) else np.zeros(0, np.int64)
        rows = [(g, names[d].tobytes(), n.astype("<u4").tobytes(), place[mine[e]].tobytes(), left[mine[e]].tobytes(), right[mine[e]].tobytes(), mark[e].tobytes()) for g, d, n, e in by_bucket(group[of], of, buckets)]
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 6)], ["bucket", "keys", "counts", "place", "left", "right", "mark"])

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch become one."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.append(np.flatnonzero(new)[1:], len(s)) - 1]


def _by_text(span: int):
    """Marks of a group of texts, a row for each: ranges that repeat, and stretches to look at closer."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = joined(table.column("keys"), "<u8").reshape(-1, 2), joined(table.column("counts"), "<u4")
        place, left, right, mark = (joined(table.column(c), k) for c, k in (("place", "<u4"), ("left", "<u2"), ("right", "<u2"), ("mark", "u1")))
        names, of = np.unique(keys, axis=0, return_inverse=True)
        entry = np.repeat(of.reshape(-1), counts)
        o = np.argsort(entry, kind="stable")
        edge = np.searchsorted(entry[o], np.arange(len(names) + 1))
        rows = []
        for k in range(len(names)):
            e = o[edge[k] : edge[k + 1]]
            sure, look = e[(mark[e] & 1) > 0], e[(mark[e] & 2) > 0]
            s, t = merged(place[sure].astype(np.int64) - left[sure], place[sure].astype(np.int64) - right[sure] + span)
            rows.append((names[k].tobytes(), s.astype("<i8").tobytes(), t.astype("<i8").tobytes(), place[look].tobytes(), left[look].tobytes(), right[look].tobytes()))
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(c, pa.binary()) for c in columns], ["key", "starts", "ends", "place", "left", "right"])

    return run


def _fetch(span: int, gram: int, buckets: int):
    """The bytes of stretches to look at closer, dealt out by their anchor; a text is fetched once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for key, text, place, left, right in zip(*(batch.column(c) for c in ("key", "text", "place", "left", "right"))):
                key = key.as_py()
                if key in seen:
                    continue
                seen.add(key)
                raw = text.as_py().encode("utf-8")
                for a, lo, hi in zip(*(np.frombuffer(x.as_py(), k).tolist() for x, k in ((place, "<u4"), (left, "<u2"), (right, "<u2")))):
                    h = xxhash.xxh64_intdigest(raw[a : a + gram])
                    out.append((h % buckets, h - (1 << 63), key, a, lo, hi, raw[a - lo : a - hi + span]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "h", "key", "place", "left", "right", "bytes"])

    return run


def common_extension(sums: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many leading bytes the suffixes i and j share, by binary search on their prefix hashes (a row of sums for each suffix)."""
    lo, hi = np.zeros(len(i), np.int64), np.full(len(i), sums.shape[1] - 1)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = sums[i, mid] == sums[j, mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of bytes) within groups, and the extension that each shares with the one before it (-1: another group).

    A bottom-up mergesort; all comparisons of a step are done at once, each by the common extension of two prefix hashes.
    """
    n, width = text.shape
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(BASE, width), 1, out=sums[:, 1:])

    def less(i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        out = group[i] < group[j]
        same = np.flatnonzero(group[i] == group[j])
        if len(same):
            i, j = i[same], j[same]
            k = common_extension(sums, i, j)
            at = np.minimum(k, width - 1)
            out[same] = (text[i, at] < text[j, at]) | ((k == width) & or_equal)
        return out

    order, run = np.argsort(group, kind="stable"), 1
    while run < n:
        place = np.arange(n)
        mine = place // run
        other = np.where(mine % 2 == 0, mine + 1, mine - 1) * run
        lo = np.minimum(other, n)
        hi = np.minimum(other + run, n)
        start = lo.copy()
        left = mine % 2 == 0
        while True:  # how many of the other run come before each
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            them, me = order[mid], order[open_]
            before = np.empty(len(open_), bool)
            for side in (True, False):
                of = np.flatnonzero(left[open_] == side)
                before[of] = less(them[of], me[of], not side)
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        new = np.empty_like(order)
        new[(mine // 2) * 2 * run + place % run + (lo - start)] = order
        order, run = new, 2 * run
    shared = np.full(n, -1, np.int64)
    if n > 1:
        i, j = order[:-1], order[1:]
        same = group[i] == group[j]
        k = common_extension(sums, i, j)
        # verification: the bytes themselves
        differ = text[i] != text[j]
        exact = np.where(differ.any(1), differ.argmax(1), width)
        if (exact[same] != k[same]).any() or (same & (exact < width) & (text[i, np.minimum(exact, width - 1)] > text[j, np.minimum(exact, width - 1)])).any():
            order = np.array(sorted(range(n), key=lambda r: (group[r], text[r].tobytes())))
            i, j = order[:-1], order[1:]
            same = group[i] == group[j]
            differ = text[i] != text[j]
            exact = np.where(differ.any(1), differ.argmax(1), width)
        shared[1:] = np.where(same, exact, -1)
    return order, shared


def repeated_windows(group: np.ndarray, parts: list[bytes], left: np.ndarray, right: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """For each stretch and each distance of a window from its anchor: whether another stretch of the group has the same window."""
    n, wide = len(parts), span - gram
    ahead, behind = np.zeros((n, span), np.uint8), np.zeros((n, max(1, wide)), np.uint8)
    for k, raw in enumerate(parts):
        b = np.frombuffer(raw, np.uint8)
        a = int(left[k])
        ahead[k, : len(b) - a] = b[a:]
        behind[k, :a] = b[:a][::-1]
    out = np.zeros((n, wide + 1), bool)
    (order_a, shared_a), (order_b, shared_b) = suffix_sort(group, ahead), suffix_sort(group, behind)
    for d in range(wide + 1):
        valid = np.flatnonzero((right <= d) & (d <= left))
        if len(valid) < 2:
            continue
        # classes of stretches with the same span - d bytes from the anchor on and the same d bytes before it
        of_a, of_b = np.empty(n, np.int64), np.empty(n, np.int64)
        of_a[order_a] = np.cumsum(shared_a < span - d)
        of_b[order_b] = np.cumsum(shared_b < d)
        _, of, count = np.unique(of_a[valid] * (n + 1) + of_b[valid], return_inverse=True, return_counts=True)
        out[valid[count[of] > 1], d] = True
    return out


def _pairs_of_parts(n: int, at_once: int) -> Iterator[np.ndarray]:
    """Places 0 .. n - 1 whole, or, of more than at_once, each two halves of that size together, so that any two places meet."""
    if n <= at_once:
        yield np.arange(n)
        return
    parts = np.array_split(np.arange(n), -(-n // max(1, at_once // 2)))
    for a in range(len(parts)):
        for b in range(a + 1, len(parts)):
            yield np.concatenate([parts[a], parts[b]])


def _look(span: int, gram: int, at_once: int):
    def run(table: pa.Table) -> pa.Table:
        h, place, left, right = (np.array(table.column(c)) for c in ("h", "place", "left", "right"))
        keys, parts = table.column("key").to_pylist(), table.column("bytes").to_pylist()
        o = np.argsort(h, kind="stable")
        edge = np.append(np.flatnonzero(np.concatenate([[True], h[o][1:] != h[o][:-1]])), len(o))
        rows, k = [], 0
        while k < len(edge) - 1:  # so many whole anchors at a time
            end = max(k + 1, int(np.searchsorted(edge, edge[k] + at_once, "right")) - 1)
            mine = o[edge[k] : edge[end]]
            # the same stretch may have come twice, from two tasks that saw copies of its text
            kept, seen = [], set()
            for e in mine.tolist():
                if (keys[e], int(place[e])) not in seen:
                    seen.add((keys[e], int(place[e])))
                    kept.append(e)
            mine = np.array(kept)
            got = np.zeros((len(mine), span - gram + 1), bool)
            for at in _pairs_of_parts(len(mine), at_once):
                got[at] |= repeated_windows(h[mine[at]], [parts[e] for e in mine[at].tolist()], left[mine[at]], right[mine[at]], span, gram)
            for e, at in zip(kept, got):
                d = np.flatnonzero(at)
                if len(d):
                    s, t = merged(int(place[e]) - d[::-1], int(place[e]) - d[::-1] + span)
                    rows += [(keys[e], int(a), int(b)) for a, b in zip(s, t)]
            k = end
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()))], ["key", "start", "end"])

    return run


def repeated_ranges(docs: DataFrame, span: int = SPAN, gram: int = GRAM, range_bytes: int = RANGE_BYTES, at_once: int = AT_ONCE) -> DataFrame:
    """key (md5) of each distinct text with repeats, whole (it has a copy), and its ranges: starts and ends (packed 64-bit, may overlap)."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text"))).where(F.octet_length("text") >= span)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, total // range_bytes)
    copies = written(rows.groupBy("key").count().where("count > 1").select("key"), "repeats-copies")
    dealt = rows.mapInArrow(_deal(span, gram, buckets), "bucket int, keys binary, counts binary, place binary, left binary, right binary, h binary, whole binary")
    marks = dealt.groupBy("bucket").applyInArrow(_marks(buckets), "bucket int, keys binary, counts binary, place binary, left binary, right binary, mark binary")
    marks = written(marks.groupBy("bucket").applyInArrow(_by_text(span), "key binary, starts binary, ends binary, place binary, left binary, right binary"), "repeats-marks")
    look = marks.where(F.length("place") > 0).select(F.col("key").alias("of"), "place", "left", "right")
    texts = rows.join(look, rows["key"] == look["of"]).select("key", "text", "place", "left", "right")
    close = texts.mapInArrow(_fetch(span, gram, buckets), "bucket int, h long, key binary, place long, left int, right int, bytes binary")
    found = close.groupBy("bucket").applyInArrow(_look(span, gram, at_once), "key binary, start long, end long")
    sure = marks.where(F.length("starts") > 0).select("key", F.array(F.struct("starts", "ends")).alias("sure"))
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined_ = sure.join(found, "key", "full_outer").join(copies.withColumn("whole", F.lit(True)), "key", "full_outer")
    return written(joined_.select("key", F.coalesce("whole", F.lit(False)).alias("whole"), F.get("sure", F.lit(0))["starts"].alias("starts"), F.get("sure", F.lit(0))["ends"].alias("ends"), "found"), "repeats-ranges")


def _cut(with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [span, pa.binary()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, whole, starts, ends, found in zip(*(batch.column(c) for c in ("text", "whole", "starts", "ends", "found"))):
                raw = text.as_py().encode("utf-8")
                if whole.as_py():
                    s, t = np.array([0]), np.array([len(raw)])
                else:
                    more = found.as_py() or []
                    s = np.concatenate([np.frombuffer(starts.as_py() or b"", "<i8"), np.array([x["start"] for x in more], np.int64)])
                    t = np.concatenate([np.frombuffer(ends.as_py() or b"", "<i8"), np.array([x["end"] for x in more], np.int64)])
                    s, t = merged(s, t)
                cuts = [0, *(int(x) for pair in zip(s, t) for x in pair), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if len(s) else raw
                rows.append((len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(s, t)], kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, with_text: bool = True, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) the removed spans and the kept bytes, for each row of docs."""
    ranges = repeated_ranges(docs, span, gram, at_once=at_once).withColumnRenamed("key", "of")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    rows = rows.join(ranges, rows["key"] == ranges["of"], "left").select("doc_id", "text", "whole", "starts", "ends", "found")
    return rows.mapInArrow(_cut(with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: bigint, end: bigint>>, kept binary" * with_text)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
