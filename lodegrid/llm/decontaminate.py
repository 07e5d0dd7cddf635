"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over every document.

Words are runs of ASCII letters and digits and of anything beyond ASCII, after lower-casing A-Z. A window is ``size``
consecutive words of an item; an item of fewer words, but at least one, is a single window. Windows of documents are
hashed for all lengths at once and looked up in the sorted hashes of the windows; every hit is then compared word for
word. Documents are read once per block of windows and never shuffled.

The benchmark reaches the tasks in blocks of about ``BLOCK`` windows (some 40 MB), one at a time: a pass over the
documents is stored before the next block is sent, which bounds what is broadcast and held however large the
benchmark is. Windows go by number; the items that hold them are joined to the hits afterwards, so a window that every
item has is one number too. With more than one block, hits are united per document.

Defined results: null or empty texts have no words and are clean; an item without words matches nothing; equal item
texts under several ids count for each id; every row of a repeated document gets the same answer; extra columns pass
through ``decontaminate``.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodegrid.llm import text as T
from lodegrid.session import materialise, spread_join

SIZE = 10
BLOCK = 200_000


class Windows:
    """Windows of one block: sorted hashes by length, and the number of each exact window."""

    def __init__(self, rows: list[tuple[bytes, int, int]]):
        self.numbers = {window: number for window, _, number in rows}
        self.hashes = {}
        for n in sorted({n for _, n, _ in rows}):
            words = T.words_of([w for w, k, _ in rows if k == n], T.ALPHANUMERIC)
            self.hashes[n] = np.unique(T.runs_of(words.hashes(), n)[::n])

    def hits(self, words: T.Words) -> Iterator[tuple[int, int, int]]:
        """(first word, number of words, window) of each occurrence; words are numbered over the chunk."""
        hashes = words.hashes()
        for n, known in self.hashes.items():
            if len(hashes) < n:
                continue
            runs = T.runs_of(hashes, n)
            whole = words.doc[:len(runs)] == words.doc[n - 1:]
            at = np.searchsorted(known, runs)
            at[at == len(known)] = 0
            for i in np.flatnonzero(whole & (known[at] == runs)).tolist():
                number = self.numbers.get(b" ".join(
                    words.blob[a:b] for a, b in zip(words.starts[i:i + n].tolist(), words.ends[i:i + n].tolist(), strict=True)))
                if number is not None:
                    yield i, n, number


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Windows of ``benchmark`` (item_id, text): gram, its number of words n, and item; each once per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in T.chunks(texts):
                words = T.words_of(texts[a:b], T.ALPHANUMERIC)
                each = [words.blob[i:j] for i, j in zip(words.starts, words.ends, strict=True)]
                firsts, out = words.firsts(), []
                for k, item in enumerate(batch.column("item_id").slice(a, b - a).to_pylist()):
                    own = each[firsts[k]:firsts[k + 1]]
                    for w in {tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1))} - {()}:
                        out.append((b" ".join(w), len(w), item))
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[i] for o in out], t) for i, t in ((0, pa.binary()), (1, pa.int32()), (2, pa.string()))
                ], ["gram", "n", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return items.mapInArrow(run, "gram binary, n int, item string")


def numbered(benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, gram, n) and the items of each (window, item)."""
    found = materialise(windows(benchmark, size), "item-windows")
    distinct = found.groupBy("gram", "n").agg(F.count("*")).select(F.monotonically_increasing_id().alias("window"), "gram", "n")
    distinct = materialise(distinct, "windows")
    return distinct, found.join(distinct, ["gram", "n"]).select("window", "item").distinct()


def _scan(docs: DataFrame, known: DataFrame, finish: Callable, keep: list[str], schema: S.StructType) -> DataFrame:
    """One stored pass per block; passes hand on spans and windows found so far, and the last one runs ``finish`` on each chunk."""
    spark, found = docs.sparkSession, ["_spans", "_windows"]
    middle = S.StructType([docs.schema[c] for c in keep]).add("_spans", S.ArrayType(S.LongType())).add("_windows", S.ArrayType(S.LongType()))
    blocks = max(1, -(-known.count() // BLOCK))
    part = F.pmod(F.xxhash64("gram"), F.lit(blocks))
    for place in range(blocks):
        last, first = place == blocks - 1, place == 0
        shared = spark.sparkContext.broadcast(Windows([(bytes(r.gram), r.n, r.window) for r in known.where(part == place).collect()]))

        def run(batches, shared=shared, last=last, first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for a, b in T.chunks(texts):
                    own, words = batch.slice(a, b - a), T.words_of(texts[a:b], T.ALPHANUMERIC)
                    spans = [[] for _ in range(a, b)] if first else own.column("_spans").to_pylist()
                    hit = [set() for _ in range(a, b)] if first else [set(x) for x in own.column("_windows").to_pylist()]
                    firsts = words.firsts().tolist()
                    for i, n, window in shared.value.hits(words):
                        d = words.doc[i]
                        spans[d] += [i - firsts[d], n]
                        hit[d].add(window)
                    if last:
                        yield finish(own, texts[a:b], words, _hit(words, spans), hit)
                    else:
                        columns = [own.column(c).cast(pa.string()) if c == "text" else own.column(c) for c in keep]
                        columns += [pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in hit], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(columns, keep + found)

        have = keep if first else keep + found
        binary = docs.select(*[F.col(f"`{c}`").cast("binary").alias(c) if c == "text" else F.col(f"`{c}`") for c in have])
        docs = binary.mapInArrow(run, schema if last else middle)
        if not last:
            docs = materialise(docs, "scanned")
            shared.unpersist()
    return docs


def _hit(words: T.Words, spans: list[list[int]]) -> np.ndarray:
    """Which words of the chunk lie in a span."""
    marks, firsts = np.zeros(len(words.doc) + 1, np.int64), words.firsts()
    for d, own in enumerate(spans):
        for i, n in zip(own[::2], own[1::2], strict=True):
            marks[firsts[d] + i] += 1
            marks[firsts[d] + i + n] -= 1
    return np.cumsum(marks[:-1]) > 0


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def finish(part, texts, words, hit, found) -> pa.RecordBatch:
        n_hit = np.bincount(words.doc[hit], minlength=len(texts))
        return pa.RecordBatch.from_arrays([
            part.column("row"), part.column("doc_id"), pa.array(words.per_doc, pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], schema.names)

    schema = S.StructType().add("row", "long").add("doc_id", "long").add("n_words", "long").add("n_hit", "long").add("windows", S.ArrayType(S.LongType()))
    known, held = numbered(benchmark, size)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scanned = materialise(_scan(rows, known, finish, ["row", "doc_id", "text"], schema), "hits")
    met = spread_join(scanned.where("n_hit > 0").select("row", F.explode("windows").alias("window")), held, ["window"], salts=8)
    # The list of a document's items is part of its result.
    items = met.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items = items.select("row", F.size("items").cast("bigint").alias("_n"), F.sha2(F.array_join("items", ","), 256).alias("_sha"))
    out = scanned.drop("windows").join(items, "row", "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("_n", F.lit(0)).alias("n_items"),
                      F.coalesce("_sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) without the words that were hit.

    A removed span runs from its first hit word to its last and leaves the marks around it; the other columns stay.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    keep = list(docs.columns)

    def finish(part, texts, words, hit, items) -> pa.RecordBatch:
        n_hit = np.bincount(words.doc[hit], minlength=len(texts))
        if remove == "documents":
            part, texts = part.filter(pa.array(n_hit == 0)), [t for t, n in zip(texts, n_hit, strict=True) if not n]
        else:
            texts = _without(texts, words, hit, n_hit)
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else part.column(c) for c in keep]
        return pa.RecordBatch.from_arrays(columns, keep)

    return _scan(docs, numbered(benchmark, size)[0], finish, keep, docs.schema)


def _without(texts: list[bytes | None], words: T.Words, hit: np.ndarray, n_hit: np.ndarray) -> list[bytes | None]:
    begin = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    firsts, out = words.firsts(), list(texts)
    for d in np.flatnonzero(n_hit).tolist():
        a, b, at, parts = firsts[d], firsts[d + 1], 0, []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
        for i, j in zip(edges[::2], edges[1::2], strict=True):
            parts.append(texts[d][at:words.starts[a + i] - begin[d]])
            at = words.ends[a + j - 1] - begin[d]
        out[d] = b"".join([*parts, texts[d][at:]])
    return out
