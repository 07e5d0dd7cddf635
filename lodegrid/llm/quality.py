"""Quality classifier: naive Bayes log-count ratios under a linear support vector machine.

Features are indicators of n-grams, hashed into ``WIDTH`` places: lower-cased words, and runs of one to three word
shapes (case, digits, marks inside and at the end, length, whether the word repeats the one before). Each indicator is
scaled by the log ratio of its smoothed counts in the two classes; on these a hinge-loss model is fitted by dual
coordinate descent; margins become probabilities by a logistic curve fitted on a fifth held back from a first fit.

The classifier is fitted on a bounded sample: ``SAMPLE`` labelled rows, the first by hash of their id, whole texts.
Only their ids are broadcast. The fit runs in one task, whose input is bounded by the sample; scoring is one pass.

Defined results: null and empty texts have the constant feature only and get its probability; equal texts get equal
scores; without a label of either class every score is 0.5; a doc_id with several labels counts once, with the lowest, and one
with several texts is learned from the first by hash; a column ``quality_score`` of the input is replaced, other extra columns pass through ``score``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodegrid.llm import text as T

WIDTH = 1 << 18
SAMPLE = 12_000
COST, EPOCHS, SMOOTHING = 1.0, 20, 1.0
_CASED = T.separators(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)
_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((_BYTES >= a) & (_BYTES <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~(_UPPER | _LOWER | _DIGIT)


def shapes(words: T.Words, hashes: np.ndarray) -> np.ndarray:
    """A number for the looks of each word."""
    data, starts, ends = np.frombuffer(words.blob, np.uint8), words.starts, words.ends

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return total[ends] - total[starts]

    upper, lower, marks = count(_UPPER), count(_LOWER), count(_MARK)
    case = np.select([upper == 0, lower == 0, (upper == 1) & _UPPER[data[starts]]], [0, 1, 2], 3)
    last = data[ends - 1].astype(np.int64)
    last = np.where(_MARK[last], last, 0)
    inner = np.minimum(marks - (last > 0), 2)
    size = np.searchsorted([2, 4, 8, 16, 32], ends - starts, "right")
    again = np.zeros(len(starts), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    code = (((case * 2 + (count(_DIGIT) > 0)) * 128 + last) * 3 + inner) * 6 + size
    return T.mix((code * 2 + again).astype(np.uint64) + np.uint64(1))


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts in a row, text by text, and how many each text has. Place 0 is in every text."""
    words = T.words_of(texts, _CASED)
    looks = shapes(words, words.hashes()) if len(words.starts) else np.zeros(0, np.uint64)
    small = T.Words(words.blob.lower(), words.starts, words.ends, words.doc, words.per_doc)
    doc, found = [np.arange(len(texts)), words.doc], [np.zeros(len(texts), np.int64), _place(small.hashes())]
    for n in (1, 2, 3):
        runs = T.runs_of(looks, n)
        whole = words.doc[:len(runs)] == words.doc[n - 1:n - 1 + len(runs)]
        doc.append(words.doc[:len(runs)][whole])
        found.append(_place(runs[whole]))
    keys = np.unique(np.concatenate(doc) * WIDTH + np.concatenate(found))
    return (keys % WIDTH).astype(np.int32), np.bincount(keys // WIDTH, minlength=len(texts))


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(WIDTH - 1)).astype(np.int64) + 1


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of each feature in class 1 over that in class 0."""
    share = []
    for label in (1, 0):
        own = [r for r, y in zip(rows, labels, strict=True) if y == label]
        counts = np.bincount(np.concatenate(own), minlength=WIDTH) + SMOOTHING
        share.append(counts / counts.sum())
    ratio = np.log(share[0] / share[1])
    ratio[0] = 1.0
    return ratio


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights of the hinge-loss model with L2 penalty, one dual variable at a time; rows have unit length."""
    rng, weights, alpha = np.random.default_rng(seed), np.zeros(WIDTH), np.zeros(len(rows))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * weights[rows[i]].dot(values[i]) - 1
            new = min(max(alpha[i] - gradient, 0.0), COST)
            if new != alpha[i]:
                weights[rows[i]] += (new - alpha[i]) * signs[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margin to probability, by Newton steps on smoothed targets."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, theta = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (target - p))
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """Ratios and weights by feature, and the curve from margin to probability."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, slope: float, offset: float):
        self.ratios, self.product, self.slope, self.offset = ratios, ratios * weights, slope, offset

    def margins(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(counts)), counts)
        length = np.sqrt(np.bincount(doc, self.ratios[found] ** 2, len(counts)))
        return np.bincount(doc, self.product[found], len(counts)) / np.maximum(length, 1e-12)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        z = self.slope * self.margins(*features(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on four fifths, place the curve on the rest, fit again on all."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0)

    def trained(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [rows[i] for i in part]
        ratios = log_ratios(own, labels[part])
        values = [ratios[r] / max(np.linalg.norm(ratios[r]), 1e-12) for r in own]
        return ratios, descend(own, values, np.where(labels[part] == 1, 1.0, -1.0))

    everything = np.arange(len(rows))
    back = everything % 5 == 4
    slope, offset = 4.0, 0.0
    if len(set(labels[back].tolist())) == 2 and len(set(labels[~back].tolist())) == 2:
        first = Model(*trained(everything[~back]), 1.0, 0.0)
        counts = np.array([len(rows[i]) for i in everything[back]])
        slope, offset = logistic(first.margins(np.concatenate([rows[i] for i in everything[back]]), counts), labels[back])
    return Model(*trained(everything), slope, offset)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``."""
    chosen = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_doc"), F.col("label").cast("int"))
    # At most ``sample`` ids are broadcast. An id stands for one text, the first by hash, however many rows have it, so the fit
    # sees no more rows than ids.
    plain = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    named = plain.join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))
    rows = named.groupBy("_doc", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in T.chunks(texts):
                found, counts = features(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("_doc"), part.column("label"), T.int_lists(found, counts, pa.int32())],
                                                 ["_doc", "label", "found"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((d, y, np.array(f, np.int32)) for batch in batches for d, y, f in zip(
            batch.column("_doc").to_pylist(), batch.column("label").to_pylist(), _lists(batch.column("found")), strict=True)),
            key=lambda r: (r[0], r[1], r[2].tobytes()))
        rng = np.random.default_rng(5)
        rows = [rows[i] for i in rng.permutation(len(rows))]
        model = fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.ratios.tobytes()]), pa.array([model.product.tobytes()]),
                                          pa.array([model.slope]), pa.array([model.offset])], ["ratios", "product", "slope", "offset"])

    found = rows.mapInArrow(extract, "_doc bigint, label int, found array<int>").repartition(1)
    row = found.mapInArrow(train, "ratios binary, product binary, slope double, offset double").first()
    if row is None:  # nothing runs over an empty table
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0)
    model = Model(np.frombuffer(bytes(row["ratios"])), np.zeros(WIDTH), row["slope"], row["offset"])
    model.product = np.frombuffer(bytes(row["product"]))
    return model


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in T.chunks(texts):
                part = batch.slice(a, b - a)
                columns = [part.column(c).cast(pa.string()) if c == "text" else part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(shared.value.scores(texts[a:b]))], [*keep, "quality_score"])

    binary = docs.select(*[F.col(c).cast("binary").alias(c) if c == "text" else F.col(f"`{c}`") for c in keep])
    return binary.mapInArrow(run, S.StructType([docs.schema[c] for c in keep]).add("quality_score", "double"))
