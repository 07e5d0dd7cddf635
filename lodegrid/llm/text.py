"""Vectorised words and hashes over batches of texts, for use inside tasks.

Texts come as UTF-8 bytes (a string column cast to binary), so no text is decoded and bytes that are not
valid UTF-8 do no harm. A null text counts as empty. Batches are cut into chunks of about ``CHUNK`` bytes (one
longer text makes a chunk of its own), which bounds the memory of a task by the chunk and not by the batch.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
_LONG = 256
_SPACE = 0x20
_UPPER = bytes(range(0x41, 0x5B))
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def separators(which: bytes, lower: bool = True) -> bytes:
    """Translation table: bytes in ``which`` become spaces, A-Z become a-z."""
    table = bytearray(range(256))
    if lower:
        for c in _UPPER:
            table[c] = c + 32
    for c in which:
        table[c] = _SPACE
    return bytes(table)


#: Words are everything but white space: [^\x20\x09-\x0D]+ after lower-casing A-Z.
BLANK_SEPARATED = separators(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are letters and digits of ASCII and everything beyond it: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALPHANUMERIC = separators(bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or c in _UPPER)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit changes every output bit."""
    h = (h ^ (h >> np.uint64(33))) * _K2
    h = (h ^ (h >> np.uint64(29))) * _K3
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a chunk: byte places in ``blob``, the text each belongs to, and words per text."""

    blob: bytes
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.blob, self.starts, self.ends)

    def firsts(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.per_doc)])


def words_of(texts: list[bytes | None], table: bytes) -> Words:
    parts = [t or b"" for t in texts]
    blob = b" ".join(parts).translate(table)
    data = np.frombuffer(blob, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != _SPACE
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.cumsum([len(p) + 1 for p in parts])
    doc = np.searchsorted(offsets, starts, "right")
    return Words(blob, starts, ends, doc, np.bincount(doc, minlength=len(parts)))


def span_hashes(blob: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time over all spans at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = blob + bytes(8)
    eights = np.ndarray((len(blob) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64) * _K1
    live, at, left = np.arange(len(starts)), starts, length
    for _ in range(_LONG // 8):
        piece = eights[at]
        keep = np.minimum(left, 8)
        piece = piece & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - keep).astype(np.uint64) * np.uint64(8)))
        h[live] = mix((h[live] ^ piece) * _K1)
        more = left > 8
        if not more.any():
            return h
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in live:  # spans of over 256 bytes
        h[i] = int.from_bytes(hashlib.blake2b(blob[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return h


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` consecutive words; runs across texts are left to the caller."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * _K1 + words[j:j + n]
        return mix(out)


def chunks(texts: list[bytes | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Slices of about ``limit`` bytes; every text is in exactly one."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


def int_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
