"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Texts are split into pre-tokens at once for a whole chunk, on arrays of code points and their classes. Encoding has
two tiers. A minimal perfect hash (hash and displace: one slot per vocabulary entry, no empty slot) resolves every
pre-token that is itself in the vocabulary, for all distinct pre-tokens of a chunk in a few array operations; the
bytes are then compared, so a stranger that falls on a slot is not taken for its owner. Misses are merged with a
heap of candidate pairs over linked bytes: lowest rank first, leftmost among equals, which gives the same ids as
merging pair by pair. Ids come out as flat arrays with a count per text, so memory is bounded by the chunk.

The vocabulary has a fixed size and is broadcast; the texts are never moved.

Defined results: null and empty texts have no ids; special-token strings inside a text are ordinary text; bytes
that are not UTF-8 are read as U+FFFD; repeated rows are encoded each; other columns pass through ``encode``.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodegrid.llm import text as T

#: Merged pre-tokens that a worker remembers before it starts afresh; this bounds memory and changes no result.
REMEMBERED = 400_000
_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE = range(5)
#: Endings that the public pattern splits off after an apostrophe.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Tokens by id, their ranks, and a minimal perfect hash over them. ``size`` keeps the first ranks only."""

    def __init__(self, path: str, size: int | None = None):
        lines = (line.split() for line in open(path, "rb") if line.strip())
        by_rank = sorted(((int(rank), base64.b64decode(token)) for token, rank in lines))
        self.tokens = [token for _, token in by_rank][:size]
        if [r for r, _ in by_rank] != list(range(len(by_rank))):
            raise ValueError(f"the ranks in {path} have gaps")
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.blob = b"".join(self.tokens)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self._displace(T.span_hashes(self.blob, self.starts, self.ends))

    def _displace(self, hashes: np.ndarray) -> None:
        """A displacement for each bucket that sends its tokens to slots of their own; lone tokens name theirs."""
        n = len(hashes)
        self.buckets = max(1, n // 3)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots = np.full(n, -1, np.int32)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[bounds[b]:bounds[b + 1]]
            if len(members) < 2:
                break
            self.shift[b], at = next(self._places(hashes[members]))
            self.slots[at] = members
        free = iter(np.flatnonzero(self.slots < 0))
        for b in np.flatnonzero(sizes == 1):
            at = next(free)
            self.slots[at], self.shift[b] = order[bounds[b]], -1 - at

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Displacements that send all of ``hashes`` to different free slots, with those slots; 64 are tried at a time."""
        for base in range(0, 1 << 40, 64):
            tries = np.arange(base, base + 64, dtype=np.uint64)
            at = self._slot(hashes[None, :], tries[:, None])
            for d in np.flatnonzero((self.slots[at] < 0).all(axis=1)):
                if len(set(at[d].tolist())) == len(hashes):
                    yield base + int(d), at[d]

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (T.mix(hashes ^ ((shift + np.uint64(1)) * _STEP)) % np.uint64(len(self.slots))).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The only id that each hash can have; the caller compares bytes."""
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        spread = self._slot(hashes, np.maximum(shift, 0).astype(np.uint64))
        return self.slots[np.where(shift < 0, -1 - shift, spread)]


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    table = np.zeros(0x110000, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    places = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[places[m.start():m.end()]] = kind
    return table


def pre_tokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of the chunk, byte starts and ends of its pre-tokens, and the text each belongs to.

    The rules of the public pattern, on runs of one class: a single space before letters, numbers or other marks
    belongs to them; of a longer run of white space the last character is split off unless the text ends there; an
    apostrophe on its own takes a contraction ending with it.
    """
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kinds = code_point_classes()[points]
    edges = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds[edges] = _EDGE
    begins = np.ones(len(points), bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    begins[edges] = True
    # The last of each run of white space that something other than the end follows.
    last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & (kinds[1:] != _EDGE))
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & begins[:-1] & (kinds[1:] == _LETTER))
    for i in quote[begins[quote + 1]]:
        for ending in _CONTRACTIONS:
            if joined.startswith(ending, i + 1):
                begins[i + 1] = False
                begins[i + 1 + len(ending)] = True
                break
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    real = kinds[starts] != _EDGE
    starts, ends = starts[real], ends[real]
    widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    bytes_at = np.concatenate([[0], np.cumsum(widths)])
    return joined.encode(), bytes_at[starts], bytes_at[ends], np.searchsorted(edges, starts, "right")


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token. A heap holds adjacent pairs; parts are linked by where each ends and where the one before begins."""
    n, width = len(piece), len(piece).bit_length()
    mask, get = (1 << width) - 1, ranks.get
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [((r << width | i) << width) | i + 2 for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        item = heappop(heap)
        end, left = item & mask, item >> width & mask
        right = ends[left]
        if right <= 0 or right >= end or ends[right] != end:
            continue  # one of the two parts has changed since
        ends[left], ends[right] = end, 0
        if end < n:
            before[end] = left
            if (r := get(piece[left:ends[end]])) is not None:
                heappush(heap, ((r << width | left) << width) | ends[end])
        if left:
            first = before[left]
            if (r := get(piece[first:end])) is not None:
                heappush(heap, ((r << width | first) << width) | end)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:ends[at]]])
        at = ends[at]
    return out


class Codec:
    """Encodes and decodes chunks of texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
        self.names = np.array([str(i) for i in range(len(vocabulary.tokens))], object)
        self.merged: dict[bytes, list[int]] = {}

    def _ids(self, piece: bytes) -> list[int]:
        ids = self.merged.get(piece)
        if ids is None:
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            ids = self.merged[piece] = merge(piece, self.ranks)
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        blob, starts, ends, doc = pre_tokens(texts)
        hashes = T.span_hashes(blob, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        ids = self.vocabulary.find(distinct).tolist()
        tokens, flat, lengths = self.vocabulary.tokens, [], np.ones(len(distinct), np.int64)
        for i, (a, b, k) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), ids, strict=True)):
            piece = blob[a:b]
            if tokens[k] == piece:
                flat.append(k)
            else:
                parts = self._ids(piece)
                flat += parts
                lengths[i] = len(parts)
        out = gather(np.array(flat, np.int32), np.cumsum(lengths) - lengths, lengths, which)
        counts = np.bincount(doc, weights=lengths[which], minlength=len(texts)).astype(np.int64)
        return out, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        v = self.vocabulary
        lengths = v.ends - v.starts
        data = gather(np.frombuffer(v.blob, np.uint8), v.starts, lengths, ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``values`` (run i: ``lengths[i]`` from ``starts[i]``), one after the other."""
    n = lengths[which]
    shift = np.repeat(starts[which] - (np.cumsum(n) - n), n)
    return values[shift + np.arange(len(shift))]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    raw = batch.column("text").to_pylist()
    for a, b in T.chunks(raw):
        yield a, b, [(t or b"").decode("utf-8", "replace") for t in raw[a:b]]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens``. The text column is read as ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    keep = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for a, b, texts in _texts(batch):
                ids, counts = codec.encode(texts)
                part = batch.slice(a, b - a)
                columns = [part.column(c).cast(pa.string()) if c == "text" else part.column(c) for c in keep]
                columns += [T.int_lists(ids, counts, pa.int32()), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "token_ids", "n_tokens"])

    schema = S.StructType([docs.schema[c] for c in keep])
    schema = schema.add("token_ids", S.ArrayType(S.IntegerType())).add("n_tokens", "long")
    binary = docs.select(*[F.col(c).cast("binary").alias(c) if c == "text" else F.col(f"`{c}`") for c in keep])
    return binary.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids (decimal, comma-joined) and of the bytes decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for a, b, texts in _texts(batch):
                ids, counts = codec.encode(texts)
                names, ends = codec.names[ids].tolist(), np.cumsum(counts).tolist()
                joined = [",".join(names[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                decoded = codec.decode(ids, counts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(counts),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for s in joined], pa.string()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in decoded], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
