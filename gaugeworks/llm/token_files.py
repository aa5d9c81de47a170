"""Token-ID / binary output (1): fixed-width bit packing with block offsets.

One file (a shard) holds the ids of a run of documents in ascending doc_id order::

    32 bytes   magic b"GWIDS001", then little-endian u32: bits an id, ids a block, documents, blocks; u64: ids
    u64 x (blocks + 1)      byte offset of each block from the file's start; the last is the end of the data
    u8  x documents         1 where the doc_id is null, then padding to 8 bytes
    i64 x documents         doc_id
    u64 x (documents + 1)   place of each document's first id in this file; the last is the number of ids
    data       block after block: ids in ``bits`` bits each, the first in the lowest bits of little-endian 64-bit words

``bits`` is the least number that holds the largest id of the vocabulary. 64 ids fill exactly ``bits`` words, so numpy packs and unpacks 64
strided columns at a time, and any id, document or block is read by itself (``Shard``).

Documents are range-partitioned by doc_id (null first; rows with one doc_id stand in the order of their text); a task
encodes one range and writes shards of about ``shard_ids`` ids, one after the other: it holds the ids of one shard, whatever the range's
size, and rows of one doc_id may lie over several. Shards are ordered by range and by their number within it. A null text is an empty one: only the end id. Ids over the vocabulary are an
error. Repeated rows are written again. An empty table gives no shard and an empty result. Columns other than doc_id and text
are ignored. A retried task writes a new file under another name; only files of tasks that ended are listed.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.llm.shared import give_back, new_folder, open_file, put_file, written

MAGIC, BLOCK, END_ID = b"GWIDS001", 1 << 14, 1
TOKENIZER = "word_bpe_49k.json"
#: Ids of a shard; bytes of kept words (two generations of so many).
SHARD_IDS, KEPT_BYTES = 4 << 20, 44 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    n = -(-len(ids) // 64) * 64
    v = np.zeros(n, np.uint64)
    v[: len(ids)] = ids
    v = v.reshape(-1, 64)
    out = np.zeros((len(v), bits), "<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= v[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= v[:, k] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    w = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(w), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        x = w[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (w[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = x & mask
    return out.reshape(-1)[:n]


def shard_bytes(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """block is a multiple of 64."""
    if block % 64:
        raise ValueError("block must be a multiple of 64")
    starts = np.zeros(len(docs) + 1, "<u8")
    np.cumsum([len(x) for x in docs], out=starts[1:])
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} does not fit in {bits} bits")
    data = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    nulls = bytes(x is None for x in doc_ids)
    nulls += bytes(-len(nulls) % 8)
    first = 32 + 8 * (len(data) + 1) + len(nulls) + 8 * len(doc_ids) + 8 * len(starts)
    at = np.cumsum([first, *map(len, data)]).astype("<u8")
    head = MAGIC + struct.pack("<4IQ", bits, block, len(docs), len(data), len(ids))
    return b"".join([head, at.tobytes(), nulls, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), starts.tobytes(), *data])


class Shard:
    """Random access to one file: its directory is read at once, ids by block."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(32, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.n_docs, blocks, self.n_ids = struct.unpack("<4IQ", head[8:])
        self.at = np.frombuffer(file.read_at(8 * (blocks + 1), 32), "<u8")
        k = 32 + 8 * (blocks + 1)
        padded = self.n_docs + -self.n_docs % 8
        nulls, k = file.read_at(padded, k), k + padded
        ids, k = np.frombuffer(file.read_at(8 * self.n_docs, k), "<i8"), k + 8 * self.n_docs
        self.doc_ids = [None if nulls[j] else int(x) for j, x in enumerate(ids)]
        self.starts = np.frombuffer(file.read_at(8 * (self.n_docs + 1), k), "<u8").astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids from lo up to hi of this file; only their blocks are read."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        data = memoryview(self.file.read_at(int(self.at[b] - self.at[a]), int(self.at[a])))
        got = [unpack(data[int(self.at[k] - self.at[a]) : int(self.at[k + 1] - self.at[a])], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(a, b)]
        return np.concatenate(got)[lo - a * self.block : hi - a * self.block]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, by way of the ids of their words.

    Only for a tokenizer whose pre-tokens never hold white space and which drops it: then the ids of a text are those of its
    white-space words, one after the other; for other tokenizers every text is encoded as it is. Ids of words are kept in two
    generations: when the young one holds KEPT_BYTES it becomes the old one, and a word found in the old one moves back, so
    frequent words stay and memory is bounded. Lower-casing and parting a final full stop or comma off letters is what such a
    tokenizer does by itself; the model alone has the ids of a run of letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        probe = [" One two,\n three. 4th\t it's  ", "Äb cd. x"]
        self.by_word = all(self._plain(t) == [i for w in t.split() for i in self._plain(w)] for t in probe) and self._plain("Ab.") == self._plain("ab") + self._plain(".")
        spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        # what Python parts words at and the tokenizer does not: texts with such a character are encoded as they are
        self.odd = re.compile("|".join(re.escape(c) for c in spaces if self._plain(f"ab{c}cd") != self._plain("ab") + self._plain("cd")) or "(?!)")
        letters = ["a", "zq", "the", "inthe", "tionandering", "abcdefghijklmnopqrstuvwxyz"]
        self.by_model = all([x.id for x in self.tokenizer.model.tokenize(w)] == self._plain(w) for w in letters)
        self.tails = {x: self._bytes(self._plain(x)) for x in ("", ".", ",")}
        # a byte-level tokenizer shows the model each byte as a character: printable ones as they are, the others from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in shown]
        self.bytes_shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}
        self.by_bytes = self.by_model and all(self._by_model(w) == self._plain(w) for w in ["é", "straße", "Ñandú", "êtreÉau", "日本", "Привет", "ǅ"])

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _by_model(self, letters: str) -> list[int]:
        """The ids of a run of letters, lowered, from the model alone."""
        if letters.isascii():
            return [t.id for t in self.tokenizer.model.tokenize(letters.lower())]
        shown = letters.lower().encode("utf-8").decode("latin-1").translate(self.bytes_shown)
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes()

    def _keep(self, word: str, ids: bytes) -> bytes:
        self.young[word] = ids
        self.held += 200 + 2 * len(word) + len(ids)
        return ids

    def _learn(self, word: str) -> bytes:
        """The ids of a word that the young generation lacks, kept there."""
        ids = self.old.get(word)
        if ids is not None:
            return self._keep(word, ids)
        body, tail = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
        # the model alone has the ids of a run of letters that case and composition leave no choice about
        if body.isalpha() and (self.by_model if body.isascii() else self.by_bytes and "\u03a3" not in body and "\u0130" not in body and unicodedata.is_normalized("NFC", body)):
            low = body.lower()
            if low == word:
                return self._keep(word, self._bytes(self._by_model(word)))
            return self._keep(word, (self.young.get(low) or self._learn(low)) + self.tails[tail])
        return self._keep(word, self._bytes(self._plain(word)))

    def __call__(self, text: str) -> np.ndarray:
        """Ids, 16 bits wide where the vocabulary fits, else 32."""
        if not self.by_word or self.odd.search(text):
            return np.array(self._plain(text), self.kind)
        words, out = text.split(), []
        for lo in range(0, len(words), 1 << 16):  # a very long text is taken in steps, so that what is held stays bounded
            part = words[lo : lo + (1 << 16)] if len(words) > 1 << 16 else words
            got = list(map(self.young.get, part))
            if None in got:
                young, learn = self.young, self._learn
                got = [young.get(w) or learn(w) if g is None else g for w, g in zip(part, got)]
                if self.held > KEPT_BYTES:
                    self.old, self.young, self.held = young, {}, 0
            out.append(b"".join(got))
        return np.frombuffer(b"".join(out), self.kind)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


FILES = "path string, range int, number int, n_docs long, n_ids long"


def _writer(folder: str, find_path: Callable[[], str], end_id: int, block: int, shard_ids: int):
    schema = pa.schema([("path", pa.string()), ("range", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(find_path())
        bits = max(1, max(encode.vocabulary - 1, end_id).bit_length())
        end = np.array([end_id], "<u2" if bits <= 16 else "<u4")
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        number = held = 0

        def shard() -> pa.RecordBatch:
            path = put_file(folder, f"{uuid.uuid4().hex}.ids", shard_bytes(keys, parts, bits, block))
            return pa.RecordBatch.from_pydict({"path": [path], "range": [TaskContext.get().partitionId()], "number": [number], "n_docs": [len(keys)], "n_ids": [held]}, schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                keys.append(key)
                parts.append(ids)
                held += len(ids)
                if held >= shard_ids:
                    yield shard()
                    keys, parts, number, held = [], [], number + 1, 0
        if keys:
            yield shard()
        encode.old = {}  # between tasks a worker keeps one generation
        give_back()

    return run


def write_shards(docs: DataFrame, tokenizer: Callable[[], str] = tokenizer_path, end_id: int = END_ID, block: int = BLOCK, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all documents; the list of files: FILES and start (ids in the files before it).

    tokenizer is called on the executors and gives the path of a tokenizer file there. The list has a row for each file; starts are
    running sums over ranges (a row for each task), then within a range.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = written(dealt.mapInArrow(_writer(new_folder(docs.sparkSession, "ids"), tokenizer, end_id, block, shard_ids), FILES), "id-files")
    before = W.rowsBetween(W.unboundedPreceding, -1)
    ranges = files.groupBy(F.col("range").alias("of")).agg(F.sum("n_ids").alias("ids"))
    ranges = ranges.select("of", F.coalesce(F.sum("ids").over(before.orderBy("of")), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("n_ids").over(before.partitionBy("range").orderBy("number")), F.lit(0))
    return written(files.withColumn("within", within).join(ranges, F.col("range") == F.col("of")).select(*files.columns, (F.col("earlier") + F.col("within")).alias("start")), "id-places")


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (unsigned 32-bit, little-endian) of each document, read back from the files."""
    return _read(files, lambda ids: ids.astype("<u4").tobytes(), pa.binary(), "ids binary")


def _read(files: DataFrame, digest: Callable[[np.ndarray], object], kind: pa.DataType, column: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (column.split()[0], kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(path) as file:
                    s = Shard(file)
                    step, lo = 16 * s.block, 0  # documents of about 16 blocks at a time
                    while lo < s.n_docs:
                        hi = min(s.n_docs, max(lo + 1, int(np.searchsorted(s.starts, s.starts[lo] + step))))
                        a, b = int(s.starts[lo]), int(s.starts[hi])
                        ids = s.ids(a, b)
                        cut = [ids[int(s.starts[k]) - a : int(s.starts[k + 1]) - a] for k in range(lo, hi)]
                        yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[lo:hi], pa.int64()), pa.array(s.starts[lo:hi] + start), pa.array(np.diff(s.starts[lo : hi + 1])), pa.array([digest(x) for x in cut], kind)], schema=schema)
                        lo = hi

    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """What op1 returns: the files are written and read back, and each document's ids summed up by their crc32."""
    return _read(write_shards(docs, **options), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
