"""WARC (2): a dictionary-compressed writer and its reader.

An archive is a ``.warc.zst`` file: a leading skippable frame (magic 0x184D2A5D) with a Zstandard dictionary, then each
record compressed as a frame of its own with that dictionary, so that a record is read alone by its offset. The dictionary
is trained on records of the archive itself: up to ``sample_bytes`` of them, taken evenly from all the task's records, and of each at most
its first ``SAMPLE_PIECE`` bytes, the most that the trainer looks at (documented bounds of the training alone: every record is archived whole). Where too few records are there to train on, the frame holds an empty dictionary.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is the response and the
others are revisits, which carry its id and no payload; smaller ones are all responses. A null html is an empty payload.
A null page_id is never the largest: such a record is a revisit when another has an id, else a response. Rows that tie on
the largest page_id are all responses. A null url leaves WARC-Target-URI out; control characters in a url are percent-encoded. An
empty table gives no archive and an empty result. Other columns are ignored.

Only payload digests of pages travel to find equal ones; the join back is on the digest, and adaptive execution splits it when one payload is
very common (the grouped side is read from a written table, so both sides of the join are plain exchanges).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import new_folder, open_file, put_file, written

SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
LEAST_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 1000, 64 << 10, 4 << 20, 3
ARCHIVE_BYTES, SAMPLE_PIECE = 64 << 20, 128 << 10
DATE = "2024-01-01T00:00:00Z"


def _uri(url: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) for b in url.encode("utf-8")) if url.isascii() else "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with refers_to, a revisit without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_uri(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"] + ([f"WARC-Page-ID: {page_id}"] if page_id is not None else [])
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES):
    """A dictionary from records of the archive, or None where they are too few."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    sample = [r[:SAMPLE_PIECE] for r in records[::step]]
    total = sum(map(len, sample))
    if len(sample) < 16 or total < 16 << 10:
        return None
    try:
        return zstandard.train_dictionary(min(dictionary_bytes, total // 8), sample, k=200, d=8)
    except zstandard.ZstdError:
        return None


def archive_bytes(records: list[bytes], level: int = LEVEL) -> tuple[bytes, list[int]]:
    """The file and each record's offset."""
    import zstandard

    d = trained(records)
    raw = d.as_bytes() if d else b""
    c = zstandard.ZstdCompressor(level=level, dict_data=d) if d else zstandard.ZstdCompressor(level=level)
    out = [SKIPPABLE + len(raw).to_bytes(4, "little") + raw]
    at, offsets = len(out[0]), []
    for r in records:
        out.append(c.compress(r))
        offsets.append(at)
        at += len(out[-1])
    return b"".join(out), offsets


def read_archive(file) -> Iterator[bytes]:
    """The records of an archive, one after the other; memory holds one frame's worth and a read buffer."""
    import zstandard

    head = file.read(8)
    if head[:4] != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    raw = file.read(int.from_bytes(head[4:], "little"))
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        if not rest:
            rest = file.read(1 << 20)
            if not rest:
                return
        o, parts = d.decompressobj(), []
        while True:
            parts.append(o.decompress(rest))
            if o.eof:
                rest = o.unused_data
                break
            rest = file.read(1 << 20)
            if not rest:
                raise ValueError("archive ends within a record")
        yield b"".join(parts)


def parsed(record: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and (of a response) payload; digests are verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("WARC-Page-ID"), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "payload_digest": digest, "payload_bytes": length, "payload": None if revisit else payload}


def _writer(folder: str, archive_bytes_at_most: int):
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def save(records: list[bytes]) -> pa.RecordBatch:
        data, _ = archive_bytes(records)
        path = put_file(folder, f"{uuid.uuid4().hex}.warc.zst", data)
        return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(records)], "n_bytes": [len(data)]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for page, url, html, digest, to in zip(*(batch.column(k) for k in range(5))):
                records.append(record_bytes(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), digest.as_py(), to.as_py()))
                size += len(records[-1])
                if size >= archive_bytes_at_most:
                    yield save(records)
                    records, size = [], 0
        if records:
            yield save(records)

    return run


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, archive_bytes_at_most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; the list of files: path, n_records, n_bytes."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    shared = written(shared.select(F.col("digest").alias("of"), "response"), "warc-shared")
    joined = rows.join(shared, (rows["digest"] == shared["of"]) & (F.octet_length("html") >= least_bytes), "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    joined = joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("response")).alias("refers_to"))
    return written(joined.mapInArrow(_writer(new_folder(pages.sparkSession, "warc"), archive_bytes_at_most), "path string, n_records long, n_bytes long"), "warc-files")


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if payloads else []))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                with open_file(path) as file:
                    for r in read_archive(file):
                        rows.append(parsed(r))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""
