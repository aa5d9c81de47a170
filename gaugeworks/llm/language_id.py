"""Language ID (5): the language family first, then one-versus-one linear support vector machines within the family.

Features are hashed byte n-grams (1 to 3) of the whole text, A-Z lowered and all ASCII that is no letter made a space; a
text's vector is the square roots of its counts, scaled to length 1. Both steps are one-versus-one linear machines (squared hinge loss,
accelerated gradient descent in numpy); votes decide, then the sum of margins, then the name.

The machines are fitted on about ``per_language`` labelled rows a language (a documented bound; rows are taken by a hash of doc_id and text, evenly over
all rows, repeated ones once), fewer where there are so many languages that this would be over ``most_rows`` in all; every language is learned. A machine sees at most
``per_machine`` rows of each of its two classes. Only text and label of rows that are not held out are learned from. Everything else covers all rows.

A null text or one without any letter is ``und`` with score 0. Null labels are not learned from. A language outside FAMILIES is a family
of its own. With no labelled rows every prediction is ``und``, and ``accepted`` keeps each text that has a letter. A null doc_id counts as not held out but is never learned
from. Repeated rows give repeated results, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.bytescan import runs, text_buffer
from gaugeworks.llm.shared import give_back, written

BITS, PER_LANGUAGE, MOST_ROWS, PER_MACHINE, STEPS, RIDGE = 13, 600, 20_000, 1500, 150, 1e-4
UNKNOWN = "und"
#: Families of closely related languages.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "nb", "nn", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("zh",),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
ASCII_LETTER = np.array([65 <= x <= 90 or 97 <= x <= 122 for x in range(256)])


def vectors(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A row of 2**bits float32 for each text."""
    n, size = len(at) - 1, 1 << bits
    out = np.zeros(n * size)
    b = np.frombuffer(data.tobytes().translate(LETTERS), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * size, np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(b))  # bytes from here to the end of the text
    gram = np.zeros(len(b), np.uint32)
    for k in range(min(3, len(b))):
        gram[: len(b) - k] = gram[: len(b) - k] * np.uint32(257) + b[k:] + np.uint32(1)
        whole = left > k
        index = ((gram * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64) + row
        out += np.bincount(index[whole], minlength=n * size)
    x = np.sqrt(out.astype(np.float32)).reshape(n, size)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return x


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_ = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    found = ascii_[at[1:]] > ascii_[at[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def machine(x: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """A linear machine for y in {-1, 1}: squared hinge, both classes of equal weight, Nesterov's accelerated descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c, rate = w.copy(), 0.0, 1 / (4 + ridge)
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * weight * y
        new_w, new_b = v - rate * (ridge * v - 2 * (slack @ x)), c + rate * 2 * float(slack.sum())
        momentum = (t - 1) / (t + 2)
        v, c = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    return w.astype(np.float32), float(b)


@dataclass
class Sparse:
    """Rows of float32: places of what is not 0, and values."""

    at: list[np.ndarray]
    value: list[np.ndarray]
    width: int

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width), np.float32)
        for k, r in enumerate(rows.tolist()):
            out[k, self.at[r]] = self.value[r]
        return out

    def part(self, rows: np.ndarray) -> Sparse:
        return Sparse([self.at[r] for r in rows.tolist()], [self.value[r] for r in rows.tolist()], self.width)


@dataclass
class OneVersusOne:
    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    @classmethod
    def fit(cls, x: Sparse, labels: np.ndarray, steps: int = STEPS, per_machine: int = PER_MACHINE) -> OneVersusOne:
        """Rows are made dense for one pair of classes at a time."""
        self = cls(sorted(set(labels.tolist())))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows, got = [np.flatnonzero(labels == c) for c in self.classes], []
        rows = [r[np.linspace(0, len(r) - 1, min(len(r), per_machine)).astype(int)] for r in rows]
        for a, b in self.pairs:
            y = np.repeat(np.array([1, -1], np.float32), [len(rows[a]), len(rows[b])])
            got.append(machine(x.dense(np.concatenate([rows[a], rows[b]])), y, steps))
        if got:
            self.weights, self.bias = np.stack([w for w, _ in got], 1), np.array([b for _, b in got])
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class number and a confidence between 0 and 1 of each row."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margins = x @ self.weights + self.bias
        votes, total = np.zeros((n, k)), np.zeros((n, k))
        closest = np.full((n, k), np.inf)
        for p, (a, b) in enumerate(self.pairs):
            m = margins[:, p]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            total[:, a] += np.clip(m, -1, 1)
            total[:, b] -= np.clip(m, -1, 1)
            closest[:, a] = np.minimum(closest[:, a], m)
            closest[:, b] = np.minimum(closest[:, b], -m)
        best = np.argmax(votes * 4 * k + total, 1)
        return best, 1 / (1 + np.exp(-4 * closest[np.arange(n), best].clip(-10, 10)))


@dataclass
class LanguageModel:
    families: OneVersusOne
    within: dict[str, OneVersusOne]
    bits: int = BITS

    @classmethod
    def fit(cls, x: Sparse, langs: np.ndarray, bits: int = BITS) -> LanguageModel:
        family = np.array([FAMILY_OF.get(s, f"own:{s}") for s in langs])
        return cls(OneVersusOne.fit(x, family), {f: OneVersusOne.fit(x.part(np.flatnonzero(family == f)), langs[family == f]) for f in sorted(set(family.tolist()))}, bits)

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(at) - 1
        langs, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for lo, hi in runs(at, 1 << 18, 64):
            part = at[lo : hi + 1] - at[lo]
            bytes_ = data[at[lo] : at[hi]]
            known = has_letter(bytes_, part)
            x = vectors(bytes_, part, self.bits)
            f, sure = self.families.predict(x)
            for k, name in enumerate(self.families.classes):
                mine = np.flatnonzero((f == k) & known)
                if len(mine):
                    best, also = self.within[name].predict(x[mine])
                    langs[lo + mine] = np.array(self.within[name].classes, object)[best]
                    score[lo + mine] = sure[mine] * also
        return langs.tolist(), score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(rows: DataFrame, label: str, per_label: int, most_rows: int) -> DataFrame:
    """Of rows (doc_id, label, text) about per_label of each label, fewer where that were over most_rows in all; repeated rows once."""
    counts = written(rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")), "label-counts")  # of known size, so Spark broadcasts it only where it is small
    labels = counts.count()
    share = max(1, min(per_label, most_rows // max(1, labels))) / F.col("_n")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(counts, rows[label] == counts["_label"]).where(draw < share).select("doc_id", label, "text").dropDuplicates()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, bits: int = BITS, most_rows: int = MOST_ROWS) -> LanguageModel | None:
    """A model from the rows that are not held out; features of the bounded sample come to the driver."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sample = labelled_sample(rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), "lang", per_language, most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            for lo, hi in runs(at, 1 << 18, 64):
                part = at[lo : hi + 1] - at[lo]
                x = vectors(data[at[lo] : at[hi]], part, bits)
                ok = has_letter(data[at[lo] : at[hi]], part)
                sparse = [(np.flatnonzero(r).astype("<u2").tobytes(), r[r != 0].astype("<f4").tobytes()) for r in x[ok]]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo).filter(pa.array(ok)), pa.array([s[0] for s in sparse], pa.binary()), pa.array([s[1] for s in sparse], pa.binary())], ["lang", "at", "value"])

    got = sample.mapInArrow(run, "lang string, at binary, value binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    x = Sparse([np.frombuffer(r["at"], "<u2") for r in got], [np.frombuffer(r["value"], "<f4") for r in got], 1 << bits)
    return LanguageModel.fit(x, np.array([r["lang"] for r in got], object), bits)


def _predictor(model: LanguageModel | None, keep: tuple[str, ...] | None, least_score: float):
    """Rows of predictions, or (keep: the columns) the rows that are not rejected, as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                langs, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                if keep is not None:
                    yield batch.filter(pa.array(has_letter(*text_buffer(batch.column("text")))))
                    continue
            else:
                langs, score = model.predict(*text_buffer(batch.column("text")))
            if keep is not None:
                yield batch.filter(pa.array([lang != UNKNOWN and s >= least_score for lang, s in zip(langs, score)], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
        give_back()

    return run


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score for each row; one pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_predictor(model, None, 0), f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel | None, least_score: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, with a language, and a score of least_score or more."""
    return docs.mapInArrow(_predictor(model, tuple(docs.columns), least_score), docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
