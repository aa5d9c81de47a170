"""Vectorised scans of the UTF-8 bytes of Arrow text columns with numpy: words, word hashes, rolling prefix hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd base of the prefix hashes (taken modulo 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Tables of bytes: A-Z to a-z; and that with all but 0-9, a-z and bytes of non-ASCII characters as a space.
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
IS_SPACE = np.array([x == 32 or 9 <= x <= 13 for x in range(256)])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the entropy of a polynomial hash over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def runs(at: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes (a longer row comes alone) and rows each."""
    k, n = 0, len(at) - 1
    while k < n:
        end = min(n, k + rows, max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1))
        yield k, end
        k = end


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes that are not white space, A-Z lowered; none crosses a row), and each row's word count."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    low = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    inside = ~IS_SPACE[low]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[firsts[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(INVERSE, n)[starts]
    per_row = np.searchsorted(starts, at[1:]) - np.searchsorted(starts, at[:-1])
    return mixed(hashes), per_row


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The packed arrays of a binary column, end to end."""
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def by_bucket(bucket_of: np.ndarray, doc_of: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket that has entries: its number, its documents, the number of entries of each and the entries' places, grouped by document."""
    order = np.argsort(bucket_of.astype(np.uint16) if buckets <= 1 << 16 else bucket_of, kind="stable")
    edge = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)):
        mine = order[edge[b] : edge[b + 1]]
        d = doc_of[mine]
        start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        yield int(b), d[start], np.diff(np.append(start, len(d))), mine
