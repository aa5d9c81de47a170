"""License scans (3): an exact set-similarity join of license templates with text blocks.

Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z lowered. The blocks of a template of m words with threshold t are all runs of
ceil(m / t) consecutive words of a text (the whole text where it is shorter). A block is found when it holds at least the share t of the template's
distinct words. The threshold stands beside each template: notices that differ from another in a single word, as in a version, need all their words.

The words of templates are put in one global order, rarest first by the number of documents that hold them, counted over all documents; other words can't
match and are left out of blocks. With a words of a template T needed, a block

1. must hold one of the first |T| - a + 1 words of T (prefix filter): only runs around such a word are looked at;
2. must have a template words in all (length filter, a difference of two running counts, before any set is made);
3. sorted in the global order, from its first word of T on, must leave enough words on both sides (positional filter, before the overlap is counted).

What passes is counted exactly, so the join finds every block that reaches its threshold. Base phrases are templates with threshold 1; in their blocks the words
must then stand one after the other (an exact check that follows). Templates are few and fixed, so they go to every task; documents are never shuffled.

Null and empty texts have no words, no labels and score 0. A null doc_id is kept as it is. Repeated rows give repeated results. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.bytescan import WORDS

THRESHOLD = 0.8
#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Wording of public license notices and their labels; a threshold where it is not THRESHOLD.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl-3"),
    ("licensed under the GNU General Public License, version 3", "gpl-3", 1.0),
    ("licensed under the GNU General Public License, version 2", "gpl-2", 1.0),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2", 1.0),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by", 1.0),
    ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa", 1.0),
)


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    base: bool
    threshold: float

    @property
    def tokens(self) -> frozenset[bytes]:
        return frozenset(self.words)

    @property
    def needed(self) -> int:
        """The least number of common tokens."""
        n = len(self.tokens)
        return max(1, next(k for k in range(n + 1) if k >= self.threshold * n - 1e-9))

    @property
    def block(self) -> int:
        """The words of a block."""
        return int(-(-len(self.words) // self.threshold))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


def template_set(base: Sequence[tuple] = BASE, notices: Sequence[tuple] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    return [Template(tuple(words_of(t)), label, True, 1.0) for t, label in base] + [Template(tuple(words_of(t)), label, False, own[0] if own else threshold) for t, label, *own in notices]


def token_order(docs: DataFrame, templates: Sequence[Template]) -> dict[bytes, tuple[int, bytes]]:
    """The global order: (number of documents, token) of each template token. One row for each of them comes to the driver."""
    vocabulary = frozenset().union(*(t.tokens for t in templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                n.update(vocabulary.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_pydict({"token": list(n), "n": list(n.values())}, pa.schema([("token", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["token"]): r["n"] for r in rows}
    return {t: (found.get(t, 0), t) for t in vocabulary}


class Join:
    """The templates, as ascending places of their words in the global order, and the index of prefix words."""

    def __init__(self, templates: Sequence[Template], order: dict[bytes, tuple[int, bytes]]):
        self.templates = list(templates)
        self.place = {w: k for k, w in enumerate(sorted(frozenset().union(*(t.tokens for t in templates)), key=order.__getitem__))}
        self.ordered = [sorted(self.place[w] for w in t.tokens) for t in templates]
        self.sets = [frozenset(x) for x in self.ordered]
        self.index: dict[int, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in self.ordered[k][: len(t.tokens) - t.needed + 1]:
                self.index.setdefault(w, []).append(k)

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(template, first word of a block, containment) of every block that reaches its template's threshold."""
        hits = [(at, w) for at, w in enumerate(map(self.place.get, words)) if w is not None]
        if not hits:
            return
        starts: dict[int, list[tuple[int, int]]] = {}  # by template, ranges of first words of blocks around a prefix word
        for at, w in hits:
            for k in self.index.get(w, ()):
                last = max(0, len(words) - self.templates[k].block)
                lo, hi = min(last, max(0, at - self.templates[k].block + 1)), min(last, at)
                mine = starts.setdefault(k, [])
                if mine and lo <= mine[-1][1] + 1:
                    mine[-1] = (mine[-1][0], max(hi, mine[-1][1]))
                else:
                    mine.append((lo, hi))
        for k, ranges in sorted(starts.items()):
            t, mine, all_ = self.templates[k], self.ordered[k], self.sets[k]
            n, needed = len(mine), t.needed
            first = end = 0  # the hits of a block
            for lo, hi in ranges:
                for at in range(lo, hi + 1):
                    while first < len(hits) and hits[first][0] < at:
                        first += 1
                    end = max(end, first)
                    while end < len(hits) and hits[end][0] < at + t.block:
                        end += 1
                    if end - first < needed:  # length filter
                        continue
                    block = sorted({w for _, w in hits[first:end]})
                    if len(block) < needed:
                        continue
                    j = next((j for j, w in enumerate(block) if w in all_), None)
                    # positional filter: what is left of both from the first common word on
                    if j is None or min(n - bisect_left(mine, block[j]), len(block) - j) < needed:
                        continue
                    common = sum(w in all_ for w in block[j:])
                    if common >= needed:
                        yield k, at, common / n

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        """n_words, n_base, first_word, last_word, base labels, all labels, score."""
        words = words_of(text)
        places: set[tuple[int, int]] = set()
        base, labels, score = set(), set(), 0.0
        for k, at, share in self.matches(words):
            t = self.templates[k]
            if not t.base:
                labels.add(t.label)
                score = max(score, share)
                continue
            if tuple(words[at : at + len(t.words)]) == t.words:
                places.add((at, k))
                base.add(t.label)
                score = 1.0
        at = [p for p, _ in places]
        return len(words), len(places), min(at, default=None), max(at, default=None), sorted(base), sorted(base | labels), score


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"


def license_scan(docs: DataFrame, templates: Sequence[Template] | None = None) -> DataFrame:
    """doc_id and COLUMNS for each row of docs."""
    templates = templates or template_set()
    order = token_order(docs, templates)
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Join(templates, order)
        for batch in batches:
            found = [join.scan(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in found], t) for k, t in enumerate(kinds))], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
