"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound by permuting each letter's vector by its place
and multiplying; a text is the bundle (sum) of its n-grams, with one space between words and at both ends. A language's
prototype is the bundle of its learning texts, each at unit length. A text gets the language of the nearest
prototype by cosine; the score is the softmax of the cosines, so it also tells how far the others are.

Prototypes are summed in every task first (as integers, so that the sum does not depend on the order) and then per
language and place; a language with a third of all rows costs one short vector per task. The result, one vector per
language, is all that reaches the driver.

Defined results: ``und`` with score 0 for a null text, a text without letters, or where nothing was learned; equal
texts get equal results; ties go to the language that sorts first; rows with a null language teach nothing; extra
columns pass through ``identify``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodegrid.llm import text as T
from lodegrid.llm.bpe import code_point_classes

DIMENSIONS = 512
GRAM = 3
SHARPNESS = 30.0
UNKNOWN = "und"
#: Letters share this many vectors (by code point); place 0 is the space between words.
LETTERS = 1024
_BLOCK = 128
_SCALE = 1 << 20
_SIGNS = np.random.default_rng(7).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * np.int8(2) - np.int8(1)
_PLACED = [np.roll(_SIGNS, GRAM - 1 - i, axis=1) for i in range(GRAM)]


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code of every letter n-gram of a chunk, and the text it belongs to."""
    plain = [(t or b"").decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer("".join(f"\n{t}\n" for t in plain).encode("utf-32-le"), "<u4")
    doc = np.repeat(np.arange(len(plain)), [len(t) + 2 for t in plain])
    letters = code_point_classes()[points] == 1
    symbols = np.where(letters, 1 + points % (LETTERS - 1), 0).astype(np.int64)
    keep = np.ones(len(symbols), bool)
    keep[1:] = letters[1:] | letters[:-1] | (doc[1:] != doc[:-1])
    symbols, doc = symbols[keep], doc[keep]
    n = len(symbols) - GRAM + 1
    codes = np.zeros(max(n, 0), np.int64)
    for j in range(GRAM):
        codes = codes * LETTERS + symbols[j:j + n]
    whole = doc[:n] == doc[GRAM - 1:] if n > 0 else np.zeros(0, bool)
    return codes[whole], doc[:max(n, 0)][whole]


def bundles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundle of each text and its number of n-grams."""
    codes, doc = _grams(texts)
    out, sizes = np.zeros((len(texts), DIMENSIONS), np.float32), np.bincount(doc, minlength=len(texts))
    if not len(codes):
        return out, sizes
    places = codes // LETTERS**2, codes // LETTERS % LETTERS, codes % LETTERS
    # Number the symbols that occur, then the n-grams that occur, by counting; sorting is left to rich scripts.
    used = np.flatnonzero(sum(np.bincount(p, minlength=LETTERS) for p in places))
    base = len(used)
    if base**GRAM <= 1 << 22:
        number = np.zeros(LETTERS, np.int64)
        number[used] = np.arange(base)
        small = (number[places[0]] * base + number[places[1]]) * base + number[places[2]]
        there = np.flatnonzero(np.bincount(small, minlength=base**GRAM))
        slot = np.zeros(base**GRAM, np.int64)
        slot[there] = np.arange(len(there))
        which = slot[small]
        parts = used[there // base**2], used[there // base % base], used[there % base]
    else:
        there, which = np.unique(codes, return_inverse=True)
        parts = there // LETTERS**2, there // LETTERS % LETTERS, there % LETTERS
    bound = _PLACED[0][parts[0]] * _PLACED[1][parts[1]] * _PLACED[2][parts[2]]
    vectors, width = bound.astype(np.float32), len(there)
    for a in range(0, len(texts), _BLOCK):
        b = min(a + _BLOCK, len(texts))
        i, j = np.searchsorted(doc, [a, b])
        counts = np.bincount((doc[i:j] - a) * width + which[i:j], minlength=(b - a) * width)
        out[a:b] = counts.reshape(b - a, width).astype(np.float32) @ vectors
    return out, sizes


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def learn(docs: DataFrame, where: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from ``text`` and ``lang`` of the rows of ``docs`` (those that meet ``where``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in T.chunks(texts):
                units = np.rint(_unit(bundles(texts[a:b])[0]) * _SCALE).astype(np.int64)
                for lang in set(langs[a:b]):
                    mine = units[[x == lang for x in langs[a:b]]].sum(axis=0)
                    sums[lang] = sums.get(lang, 0) + mine
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(total)], ["lang", "place", "value"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if where is None else where))
    parts = rows.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, place bigint, value bigint")
    total = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in total})
    vectors, at = np.zeros((len(langs), DIMENSIONS)), {x: i for i, x in enumerate(langs)}
    for r in total:
        vectors[at[r["lang"]], r["place"]] = r["value"]
    return langs, _unit(vectors).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in T.chunks(texts):
                vectors, sizes = bundles(texts[a:b])
                part = batch.slice(a, b - a)
                columns = [part.column(c).cast(pa.string()) if c == "text" else part.column(c) for c in keep]
                names, scores = [UNKNOWN] * (b - a), np.zeros(b - a)
                if langs:
                    cosines = (_unit(vectors) @ prototypes.T).astype(np.float64)
                    best = cosines.argmax(axis=1)
                    weight = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
                    scores = np.where(sizes > 0, 1 / weight.sum(axis=1), 0.0)
                    names = [langs[k] if n else UNKNOWN for k, n in zip(best, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(names, pa.string()), pa.array(scores)], [*keep, "lang_pred", "lang_score"])

    schema = S.StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("lang_score", "double")
    binary = docs.select(*[F.col(c).cast("binary").alias(c) if c == "text" else F.col(f"`{c}`") for c in keep])
    return binary.mapInArrow(run, schema)
