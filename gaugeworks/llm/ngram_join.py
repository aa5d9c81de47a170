"""N-gram Jaccard join (4): a prefix-tree join of globally ordered word n-gram sets, exact, and the groups it links.

A document's set holds its distinct ``size``-word shingles (words: runs of characters that are not white space, A-Z lowered);
with fewer words the whole sequence is the one shingle. Two documents link when 100 * intersection >= 100 * threshold * union.

1. One pass over the texts gives a row for each document: its number of shingles and a key of its set (two hashes, 128 bits). Documents with equal sets are one class.
2. A second pass deals out shingle hashes of each set (copies within a batch are dropped before the shuffle) by ranges of the hash, as packed arrays. A range
   counts in how many sets each shingle occurs, and sends back, by set, only shingles that two sets share. A set in which these are fewer than the threshold needs is alone.
   Ranges grow in number with the text. A shingle that holds more of a range than its share (the first pass counts those that many texts of a batch have) is
   known to be shared: it skips its range and goes to the sets at once, last in the order.
3. The global order is (number of sets, hash). Sets that link share one of their first c - a + 1 shared shingles (c shared ones, a needed), so
   sets are tied to the smallest document of each such prefix shingle (within a batch first, so a frequent one sends a row a batch), and connected components of these ties (families) hold all links.
4. Each family is joined on its own: its sets, most frequent shingle first, form a path-compressed trie. A set is held against those that share a prefix
   shingle with it; they are followed along the trie, overlaps of shared paths are counted once, and a subtree goes when what is left on both sides can't
   reach the overlap that its lengths need. Sets that are already in one group aren't compared, so a group of near copies costs about a comparison a member.
   Small families are packed together; a large one is cut into blocks, see _links().
5. Links of all families make the groups (components).

Shingle hashes have 52 bits at any size: a wrong match within a pair of documents has odds of |A| |B| / 2**52.

Null and empty texts and texts without words have an empty set and link with nothing. A null doc_id is given its n_shingles and a null component_id,
and takes no part. Rows that repeat a doc_id are one document of the groups; each of their texts is compared as a set of its own. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.llm.bytescan import by_bucket, joined, mixed, runs, text_buffer, word_hashes
from gaugeworks.llm.shared import SPACE, components, give_back, lowered, spare, written

SIZE, THRESHOLD = 5, 80
#: Text bytes of a numpy step; shingles of a hash range; shingles of a family task.
STEP, RANGE, FAMILY = 1 << 20, 2_500_000, 300_000
#: Bits of a shingle's hash, and texts of a step (their number takes the other bits of a word).
BITS, ROWS = 52, 4096
_C = 0xD1342543DE82EF95


def shingles(data: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle tokens (BITS wide, ascending within each row), their number and the key of the set (two numbers), by row. At most ROWS rows."""
    bits = BITS
    n = len(at) - 1
    words, per_row = word_hashes(data, at)
    first = np.concatenate([[0], np.cumsum(per_row)])
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = h * np.uint64(_C) + words[k : k + len(h)]
    row = np.repeat(np.arange(n, dtype=np.uint64), per_row)[: len(h)]
    whole = np.arange(len(h)) + size <= first[1:][row.astype(np.int64)]
    h, row = mixed(h[whole]), row[whole]
    few = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(few):
        extra = []
        for k in few:
            x = int(per_row[k])
            for w in words[first[k] : first[k + 1]].tolist():
                x = (x * _C + w) % (1 << 64)
            extra.append(x)
        h, row = np.concatenate([h, mixed(np.array(extra, np.uint64) ^ np.uint64(_C))]), np.concatenate([row, few.astype(np.uint64)])
    both = np.sort((row << np.uint64(bits)) | (h >> np.uint64(64 - bits)))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    tokens = both & np.uint64((1 << bits) - 1)
    edge = np.searchsorted(both >> np.uint64(bits), np.arange(n + 1, dtype=np.uint64))
    counts = np.diff(edge)
    keys = []
    for salt in (_C, _C * 3 % (1 << 64)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens + np.uint64(salt)))])
        keys.append(mixed(sums[edge[1:]] - sums[edge[:-1]] + counts.astype(np.uint64)))
    return tokens, counts, np.stack(keys, 1)


def _packed(tokens: np.ndarray) -> bytes:
    """The low 6 bytes of each: a range's number needs no place, as there are 16 ranges at least."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def _short(keys: np.ndarray) -> np.ndarray:
    """The first 10 bytes (80 bits) of each set key: enough to tell sets apart on the way, and rows that are sent very often stay small."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 16)[:, :10]


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows come first with their key (10 bytes), and each row's first row."""
    _, first, of = np.unique(np.ascontiguousarray(keys).view("V10").reshape(-1), return_index=True, return_inverse=True)
    keep = np.zeros(len(keys), bool)
    keep[first] = True
    return keep, first[of.reshape(-1)]


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    return (np.ascontiguousarray(keys[:, :8]).view("<u8").reshape(-1) % np.uint64(groups)).astype(np.int64)


BLOB = "keys binary, sizes binary, counts binary, tokens binary"
NAMES = ["bucket", "keys", "sizes", "counts", "tokens"]


def _blobs(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32()] + [pa.binary()] * 4)]


def _set_rows(size: int):
    """doc_id, n_shingles, key, also of each row; on the first row of a step the shingles that a 64th of its sets have, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            for lo, hi in runs(at, STEP, ROWS):
                tokens, counts, keys = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], size)
                keep, _ = _first_of(_short(keys))
                of = np.sort(tokens[keep[np.repeat(np.arange(hi - lo), counts)]])
                start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
                n = np.diff(np.append(start, len(of)))
                often = n >= max(2, keep.sum() // 64)
                hot = [np.stack([of[start[often]], n[often].astype(np.uint64)], 1).astype("<u8").tobytes() if often.any() else None] + [None] * (hi - lo - 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(counts, pa.int64()), *(pa.array(k.view(np.int64)) for k in np.ascontiguousarray(keys.T)), pa.array(hot, pa.binary())], ["doc_id", "n_shingles", "key", "also", "hot"])
        give_back()

    return run


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            pairs = np.frombuffer(x.as_py(), "<u8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["token", "n"])


def _deal(low: int, size: int, hot: np.ndarray, groups: int, only_hot: bool):
    """Rows (bucket, packed arrays) of the shingles of all distinct sets of each step: by range without the hot ones, or the hot ones by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            for lo, hi in runs(at, STEP, ROWS):
                tokens, counts, keys = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], size)
                keys = _short(keys)
                sizes, doc_of = counts.astype("<u4"), np.repeat(np.arange(hi - lo, dtype=np.int32), counts)
                chosen = _first_of(keys)[0][doc_of]
                if len(hot):
                    chosen &= np.isin(tokens, hot) == only_hot
                tokens, doc_of = tokens[chosen], doc_of[chosen]
                bucket = (_group(keys, groups)[doc_of] if only_hot else tokens >> np.uint64(low)).astype(np.int64)
                pack = (lambda t: (np.uint64(4095 << BITS) | t).astype("<u8").tobytes()) if only_hot else _packed
                rows = [(b, keys[d].tobytes(), sizes[d].tobytes(), n.astype("<u4").tobytes(), pack(tokens[e])) for b, d, n, e in by_bucket(bucket, doc_of, groups)]
                if rows:
                    yield pa.RecordBatch.from_arrays(_blobs(rows), NAMES)
        give_back()

    return run


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return joined(table.column("keys"), "u1").reshape(-1, 10), joined(table.column("sizes"), "<u4"), joined(table.column("counts"), "<u4")


def _shared_shingles(low: int, groups: int):
    """A hash range: of the shingles that two or more sets have, (set, order key) dealt out by set."""

    def run(table: pa.Table) -> pa.Table:
        keys, sizes, counts = _sets(table)
        tokens = np.concatenate([_unpacked(x.as_py()) for x in table.column("tokens")])
        top = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(low)
        tokens = (tokens & np.uint64((1 << low) - 1)) | top
        doc_of = np.repeat(np.arange(len(keys)), counts)
        chosen = _first_of(keys)[0][doc_of]
        tokens, doc_of = tokens[chosen], doc_of[chosen]
        o = np.argsort(tokens)
        tokens, doc_of = tokens[o], doc_of[o]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        n = np.diff(np.append(start, len(tokens)))
        df = np.repeat(n, n)
        shared = df > 1
        order_key = (np.minimum(df[shared], 4095).astype(np.uint64) << np.uint64(BITS)) | tokens[shared]
        doc_of = doc_of[shared]
        o = np.argsort(doc_of, kind="stable")
        doc_of, order_key = doc_of[o], order_key[o]
        group = _group(keys, groups)
        rows = [(g, keys[d].tobytes(), sizes[d].tobytes(), n.astype("<u4").tobytes(), order_key[e].tobytes()) for g, d, n, e in by_bucket(group[doc_of], doc_of, groups)]
        del tokens, doc_of, order_key, df, shared, o
        give_back()
        return pa.table(_blobs(rows), NAMES)

    return run


def _candidates(threshold: int):
    """A group of sets: those with enough shared shingles: key (its 8 and 2 bytes), n, how many of the first ones are prefix, order keys ascending."""

    def run(table: pa.Table) -> pa.Table:
        keys, sizes, counts = _sets(table)
        tokens = joined(table.column("tokens"), "<u8")
        first, of = np.unique(_first_of(keys)[1], return_inverse=True)
        entry = np.repeat(of.reshape(-1), counts)
        o = np.lexsort((tokens, entry))
        tokens, entry = tokens[o], entry[o]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (entry[1:] != entry[:-1])]) if len(tokens) else np.zeros(0, bool)
        tokens, entry = tokens[new], entry[new]
        edge = np.searchsorted(entry, np.arange(len(first) + 1))
        size_of = sizes[first].astype(np.int64)
        shared, needed = np.diff(edge), -(-threshold * size_of // 100)
        key, rest = np.ascontiguousarray(keys[first, :8]).view("<i8").reshape(-1).tolist(), np.ascontiguousarray(keys[first, 8:]).view("<u2").reshape(-1).tolist()
        rows = [(key[k], rest[k], int(size_of[k]), int(shared[k] - needed[k] + 1), tokens[edge[k] : edge[k + 1]].tobytes()) for k in np.flatnonzero(shared >= needed)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])], ["key", "rest", "n", "prefix", "tokens"])

    return run


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct document ids of a batch, and prefix tokens with the places of their documents among them, by token, then document."""
    ids, of = np.unique(np.array(batch.column("doc_id"), np.int64), return_inverse=True)
    parts = [np.frombuffer(t.as_py(), "<u8")[: p.as_py()] for t, p in zip(batch.column("tokens"), batch.column("prefix"))]
    tokens, doc_of = np.concatenate(parts), np.repeat(of.reshape(-1), [len(p) for p in parts])
    o = np.lexsort((doc_of, tokens))
    return ids, tokens[o], doc_of[o]


def _tied(names: np.ndarray, tokens: np.ndarray, doc_of: np.ndarray) -> pa.RecordBatch:
    """Documents that share a token, each tied to the smallest one that it reaches by these; sorted by token, then document."""
    start = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    least = doc_of[np.flatnonzero(start)][np.cumsum(start) - 1]
    a, b = doc_of[~start], least[~start]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[label[tied]]), pa.array(names[tied])], ["a", "b"])


def _ties_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _tied(*_prefixes(batch))


def _deal_prefixes(buckets: int):
    """By token the smallest document of a batch that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, tokens, doc_of = _prefixes(batch)
                start = np.concatenate([[True], tokens[1:] != tokens[:-1]])
                tokens, doc_of = tokens[start], doc_of[start]
                rows = [(b, ids[d].tobytes(), n.astype("<u4").tobytes(), tokens[at].tobytes()) for b, d, n, at in by_bucket((mixed(tokens) % np.uint64(buckets)).astype(np.int64), doc_of, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 3)], ["bucket", "ids", "counts", "tokens"])

    return run


def _ties(table: pa.Table) -> pa.Table:
    ids, counts, tokens = (joined(table.column(c), k) for c, k in (("ids", "<i8"), ("counts", "<u4"), ("tokens", "<u8")))
    names, of = np.unique(ids, return_inverse=True)
    doc_of = np.repeat(of.reshape(-1), counts)
    o = np.lexsort((doc_of, tokens))
    return pa.Table.from_batches([_tied(names, tokens[o], doc_of[o])])


class _Groups:
    """Group labels of the sets of a family; the smaller group takes the larger one's label."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), [[k] for k in range(n)]

    def join(self, x: int, y: int) -> None:
        a, b = int(self.label[x]), int(self.label[y])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []


class Trie:
    """A static path-compressed trie of ascending rank sequences."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        self.parent, self.segment, self.depth = [-1], [sequences[0][:0] if sequences else np.zeros(0, np.int64)], [0]
        self.deepest, self.least, self.most = [0], [1 << 60], [0]
        self.leaf = [0] * len(sequences)
        path, before = [0], None
        for k in sorted(range(len(sequences)), key=lambda k: sequences[k].astype(">u4").tobytes()):
            s, common = sequences[k], 0
            if before is not None:
                m = min(len(before), len(s))
                differ = np.flatnonzero(before[:m] != s[:m])
                common = int(differ[0]) if len(differ) else m
            last = -1
            while self.depth[path[-1]] > common:
                last = path.pop()
            if self.depth[path[-1]] < common:  # split the edge to last
                cut = common - self.depth[path[-1]]
                mid = self._node(path[-1], self.segment[last][:cut])
                self.deepest[mid], self.least[mid], self.most[mid] = self.deepest[last], self.least[last], self.most[last]
                self.parent[last], self.segment[last] = mid, self.segment[last][cut:]
                path.append(mid)
            if common < len(s):
                path.append(self._node(path[-1], s[common:]))
            self.leaf[k] = path[-1]
            for node in path:
                self.deepest[node] = max(self.deepest[node], len(s))
                self.least[node], self.most[node] = min(self.least[node], int(sizes[k])), max(self.most[node], int(sizes[k]))
            before = s

    def _node(self, parent: int, segment: np.ndarray) -> int:
        self.parent.append(parent)
        self.segment.append(segment)
        self.depth.append(self.depth[parent] + len(segment))
        self.deepest.append(0)
        self.least.append(1 << 60)
        self.most.append(0)
        return len(self.parent) - 1

    def overlaps(self, mine: np.ndarray, n: int, mark: np.ndarray, threshold: int):
        """A function from a leaf to the overlap of its path with the set that mark shows, or -1 where a bound rules its subtree out."""
        known = {0: 0}
        least_size, most_size = -(-threshold * n // 100), 100 * n // threshold

        def overlap(leaf: int) -> int:
            todo = []
            while leaf not in known:
                todo.append(leaf)
                leaf = self.parent[leaf]
            got = known[leaf]
            for node in reversed(todo):
                if got >= 0:
                    s = self.segment[node]
                    got += int(np.count_nonzero(mark[s]))
                    needed = -(-threshold * (n + max(self.least[node], least_size)) // (100 + threshold))
                    left = min(self.deepest[node] - self.depth[node], len(mine) - int(np.searchsorted(mine, s[-1], "right")))
                    if self.most[node] < least_size or self.least[node] > most_size or got + left < needed:
                        got = -1
                known[node] = got
            return got

        return overlap


def join_family(ids: list[int], sizes: np.ndarray, prefixes: list[int], keys: list[np.ndarray], side: np.ndarray | None, threshold: int = THRESHOLD, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (smallest id of a linked group, member) of a family. With side (0 or 1), only sets of different sides are compared.

    Sets of one known group count as linked, and are not compared.
    """
    n = len(ids)
    values, flat = np.unique(np.concatenate(keys), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    rank = len(values) - 1 - flat  # most frequent first
    sequences = [rank[edge[k] : edge[k + 1]][::-1] for k in range(n)]
    trie = Trie(sequences, sizes)
    order = np.lexsort((np.array(ids), sizes))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # postings of prefix shingles: place in order of the sets that have them
    entry_doc = np.repeat(np.arange(n), prefixes)
    entry_rank = np.concatenate([rank[edge[k] : edge[k] + prefixes[k]] for k in range(n)])
    o = np.lexsort((place[entry_doc], entry_rank))
    posting, at = entry_doc[o], np.searchsorted(entry_rank[o], np.arange(len(values) + 1))
    groups, mark = _Groups(n), np.zeros(len(values), bool)
    if known is not None:
        o = np.argsort(known, kind="stable")
        for same in np.split(o, np.flatnonzero(known[o][1:] != known[o][:-1]) + 1):
            groups.label[same] = same[0]
            for k in same.tolist():
                groups.members[k] = []
            groups.members[int(same[0])] = same.tolist()
    for x in order.tolist():
        mine = rank[edge[x] : edge[x] + prefixes[x]]
        found = np.unique(np.concatenate([posting[at[r] : at[r + 1]] for r in mine.tolist()]))
        fits = (place[found] < place[x]) & (groups.label[found] != groups.label[x]) & (100 * sizes[found] >= threshold * sizes[x])
        if side is not None:
            fits &= side[found] != side[x]
        found = found[fits]
        if not len(found):
            continue
        mark[sequences[x]] = True
        overlap = trie.overlaps(sequences[x], int(sizes[x]), mark, threshold)
        for y in found.tolist():
            if groups.label[y] == groups.label[x]:
                continue
            got = overlap(trie.leaf[y])
            if got >= 0 and (100 + threshold) * got >= threshold * int(sizes[x] + sizes[y]):
                groups.join(x, y)
        mark[sequences[x]] = False
    out = []
    for members in groups.members:
        if len(members) > 1:
            low = min(ids[k] for k in members)
            out += [(low, ids[k]) for k in members if ids[k] != low]
    return out


def _family_task(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        family = np.array(table.column("family"))
        o = np.argsort(family, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], family[o][1:] != family[o][:-1]]))
        ids, sizes, prefix, side, known = (np.array(table.column(c)) for c in ("doc_id", "n", "prefix", "side", "known"))
        tokens, links = table.column("tokens").combine_chunks(), []
        for mine in np.split(o, cut[1:]):
            if len(mine) > 1:
                keys = [np.frombuffer(tokens[int(k)].as_py(), "<u8") for k in mine]
                links += join_family(ids[mine].tolist(), sizes[mine].astype(np.int64), prefix[mine].tolist(), keys, side[mine] if side[mine[0]] >= 0 else None, threshold, known[mine])
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


def _links(members: DataFrame, in_family: int, threshold: int) -> DataFrame:
    """a, b: links of families (family, doc_id, n, prefix, tokens), enough to connect each group.

    Families of up to in_family shingles are packed together, some to a task. A larger one is cut into blocks by a hash of doc_id:

    - each block is joined on its own;
    - two documents of each group that holds a 16th of its block stand for it and are joined across blocks, by this same function;
    - what is then outside the family's largest group is held against all of the family, block by block. Documents of that group are not compared
      with each other again, so a family of near copies, however large, takes work in proportion to its size.
    """
    weight = members.groupBy("family").agg((F.sum(F.length("tokens")) / 8).alias("weight"))
    cut = weight.select(F.col("family").alias("of"), F.ceil(F.col("weight") / in_family).cast("int").alias("blocks")).where("blocks > 1")
    cut = written(cut, "jaccard-large")
    packs = max(64, int((weight.agg(F.sum("weight")).first()[0] or 0) / in_family * 4))
    task = lambda df: df.groupBy("pack", "lo", "hi").applyInArrow(_family_task(threshold), "a long, b long")
    columns = ["family", "doc_id", "n", "prefix", "tokens"]
    placed = members.join(cut, members["family"] == cut["of"], "left").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    first = placed.select(*columns, F.lit(-1).alias("side"), F.col("doc_id").alias("known"), F.col("block").alias("lo"), F.lit(0).alias("hi"), F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(-1 - F.col("family")).alias("pack"))
    links = written(task(first), "jaccard-links")
    if not cut.limit(1).count():
        return links
    large = placed.where(F.col("blocks").isNotNull())

    def grouped(links: DataFrame) -> DataFrame:
        now = components(links, "jaccard-blocks").select(F.col("node").alias("doc_id"), "component")
        return large.join(now, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    now = grouped(links)
    in_block, in_group = W.partitionBy("family", "block"), W.partitionBy("family", "block", "component")
    stand = now.withColumn("_all", F.count("*").over(in_block)).withColumn("_same", F.count("*").over(in_group)).withColumn("_k", F.row_number().over(in_group.orderBy("doc_id")))
    stand = written(stand.where("_k <= 2 and 16 * _same >= _all and _same > 2").select(*columns), "jaccard-standing")
    fewer = members.count() > 2 * stand.count()
    if fewer and stand.limit(1).count():
        links = written(links.union(_links(stand, in_family, threshold)), "jaccard-links")
        now = grouped(links)
    now = written(now.select(*columns, "block", "blocks", "component"), "jaccard-grouped")
    sizes = now.groupBy("family", "component").agg(F.count("*").alias("n"), (F.sum(F.length("tokens")) / 8).alias("weight"))
    main = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("weight").alias("all"), F.max_by("weight", F.struct("n", "component")).alias("own"))
    main = written(main.where("all > own").select(F.col("family").alias("of"), "main", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("own")) / in_family)).cast("int").alias("parts")), "jaccard-main")
    left = now.join(main, now["family"] == main["of"])
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int")
    outside = left.where("component <> main").select(*columns, F.lit(0).alias("side"), "component", part.alias("lo"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("hi"))
    all_ = left.select(*columns, F.lit(1).alias("side"), "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("lo"), F.col("block").alias("hi"))
    rest = outside.union(all_).withColumnRenamed("component", "known").withColumn("pack", -1 - F.col("family"))
    return links.union(written(task(rest), "jaccard-rest"))


def _sets_and_groups(docs: DataFrame, size: int, threshold: int, in_range: int, in_family: int, hot: int | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, key, also) of each row, and (key, also, component) of each set that is not empty."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    letters, texts = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = max(4, math.ceil(math.log2(max(1, (letters or 0) / 5.5 / in_range))))
    buckets, low = 1 << ranges, BITS - ranges
    sets = written(rows.mapInArrow(_set_rows(size), "doc_id long, n_shingles long, key long, also long, hot binary"), "jaccard-sets")
    often = sets.where("hot is not null").select("hot").mapInArrow(_hot_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # a shingle in a 256th of all texts, and in many for a range: there are at most 256 times as many of these as shingles in a mean text
    most = max(in_range // 8, texts // 256) if hot is None else hot
    often = np.sort(np.array([r[0] for r in often.where(F.col("n") >= most).select("token").collect()], np.uint64))
    texts_ = rows.where("doc_id is not null and text is not null")
    dealt = texts_.mapInArrow(_deal(low, size, often, buckets, False), f"bucket int, {BLOB}")
    shared = dealt.groupBy("bucket").applyInArrow(_shared_shingles(low, buckets), f"bucket int, {BLOB}")
    if len(often):
        shared = shared.union(texts_.mapInArrow(_deal(low, size, often, buckets, True), f"bucket int, {BLOB}"))
    found = shared.groupBy("bucket").applyInArrow(_candidates(threshold), "key long, rest int, n int, prefix int, tokens binary")
    classes = written(sets.where("n_shingles > 0 and doc_id is not null").groupBy("key", "also").agg(F.min("doc_id").alias("class")), "jaccard-classes")
    found = written(found.join(classes.withColumn("rest", F.col("also").bitwiseAND(F.lit(0xFFFF)).cast("int")), ["key", "rest"]).select(F.col("class").alias("doc_id"), "n", "prefix", "tokens"), "jaccard-candidates")
    ties = found.mapInArrow(_deal_prefixes(buckets), "bucket int, ids binary, counts binary, tokens binary").groupBy("bucket").applyInArrow(_ties, "a long, b long")
    families = components(ties.union(found.mapInArrow(_ties_in_batch, "a long, b long")), "jaccard-families")
    found = found.join(families.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("component", "family")
    groups = components(_links(written(found, "jaccard-members"), in_family, threshold), "jaccard-groups")
    classes = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").select("key", "also", F.coalesce("component", "class").alias("component"))
    return sets.drop("hot"), written(classes, "jaccard-components")


def jaccard_groups(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, in_range: int = RANGE, in_family: int = FAMILY, hot: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. hot: a shingle in so many sets skips its range (None: by in_range and the number of texts)."""
    sets, classes = _sets_and_groups(docs, size, threshold, in_range, in_family, hot)
    classes = classes.select(F.col("key").alias("_key"), F.col("also").alias("_also"), "component")
    out = sets.join(classes, (sets["key"] == classes["_key"]) & (sets["also"] == classes["_also"]) & (sets["n_shingles"] > 0) & sets["doc_id"].isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, in_range: int = RANGE, in_family: int = FAMILY, hot: int | None = None) -> DataFrame:
    """The rows of docs, all columns, less those of each group but its smallest doc_id's.

    Rows that repeat that doc_id with texts of different sets all stay (a doc_id is one document); of those with equal words the first by a hash of its text stays.
    Null doc_ids stay. The ids to keep are found on light rows; the texts are joined with them once.
    """
    sets, classes = _sets_and_groups(docs, size, threshold, in_range, in_family, hot)
    labelled = sets.join(classes, ["key", "also"], "left").where("doc_id is not null").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    keep = written(labelled.where("doc_id = component").groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_rows")), "jaccard-kept")
    twin, rank, word = (spare(docs.columns, c) for c in ("twin", "rank", "set"))
    # the same join at every size: a small table of ids would else be broadcast
    got = docs.join(keep.hint("merge"), docs["doc_id"] == keep["_keep"]).select(*[docs[c] for c in docs.columns], keep["_rows"].alias(twin))
    out = got.where(F.col(twin) == 1).drop(twin)
    if keep.where("_rows > 1").limit(1).count():
        # few rows as a rule: those of ids that occur more than once
        words = F.array_join(F.filter(F.split(lowered(F.col("text")), SPACE), lambda w: w != ""), " ")
        some = got.where(F.col(twin) > 1).withColumn(word, F.xxhash64(words)).withColumn(rank, F.row_number().over(W.partitionBy("doc_id", word).orderBy(F.xxhash64("text"))))
        out = out.unionByName(some.where(F.col(rank) == 1).select(*docs.columns))
    return out.unionByName(docs.where("doc_id is null"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 4))) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
overlap_of AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM overlap_of JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
