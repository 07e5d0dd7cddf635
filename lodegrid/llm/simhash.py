"""Near-duplicate groups by similarity fingerprints, found through pigeonhole blocks.

A fingerprint has one bit per bit of the shingle hashes: 1 where over half of the hashes have it set, repeated
shingles counted each time. Fingerprints link where at most ``APART`` of the 64 bits differ.

Pigeonhole: cut 64 bits into ``BLOCKS`` blocks; ``APART`` differing bits touch at most ``APART`` of them, so two
linked fingerprints agree on all the others. Every choice of ``BLOCKS - APART`` blocks is a mask, a bucket is a
mask and the bits under it, and a link is in some bucket, with certainty. With six blocks a bucket fixes 32 bits.
Candidates are verified by their Hamming distance.

No group is collected or expanded into pairs:

- Equal fingerprints are one node, whatever their number; most copies end here.
- Each member of a bucket is compared with the bucket's lowest fingerprint, then with its highest. What is linked so
  is grouped by distributed connected components, and buckets that hold one group only need nothing more.
- In the buckets left, members of different groups are compared with each other, in buckets of ``LARGE`` at most.
  A larger bucket is dealt to finer ones by the same principle, applied to the bits that it leaves free (8 blocks of
  4 bits, then 6 of 2). The last kind leaves 6 bits free, so it holds 64 fingerprints at most, however the
  data lie: work in a bucket is bounded, and no link is given up for it.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; a
text of fewer words than a shingle is one shingle; rows are kept as they come, and repeated rows have one
fingerprint; a row without doc_id gets a fingerprint and no component. Columns beside ``doc_id`` and ``text`` are not
looked at. Long texts are hashed piece by piece.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.llm.neardup import components
from lodegrid.session import materialise, spread_join

SHINGLE = 3
SEED = 42
APART = 3
BLOCKS = 6
#: Blocks of the free bits, level by level, for buckets of more than ``LARGE`` members.
FINER = (8, 6)
LARGE = 64
_ALL = (1 << 64) - 1
_PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of about a megabyte, cut at white space."""
    start = 0
    while len(text) - start > _PIECE and (cut := _BLANK.search(text, start + _PIECE)):
        yield text[start:cut.start()]
        start = cut.end()
    yield text[start:] if start else text


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of UTF-8 text."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    hash_of = xxhash.xxh64_intdigest
    for piece in _pieces(text or b""):
        words = carried + piece.lower().split()
        hashes = [hash_of(b" ".join(words[i:i + size]), SEED) for i in range(len(words) - size + 1)]
        if hashes:
            ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carried = words[max(0, len(words) - size + 1):]
    if not total and carried:
        ones, total = np.unpackbits(np.array([hash_of(b" ".join(carried), SEED)], ">u8").view(np.uint8)), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])


def masks(free: int, blocks: int, apart: int = APART) -> list[int]:
    """Every choice of all but ``apart`` of ``blocks`` blocks of the set bits of ``free``, as bits."""
    bits = [i for i in range(64) if free >> i & 1]
    size, more = divmod(len(bits), blocks)
    cuts = np.cumsum([0] + [size + (i < more) for i in range(blocks)])
    parts = [sum(1 << b for b in bits[cuts[i]:cuts[i + 1]]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - apart)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _long(value: int) -> Column:
    return F.lit(_signed(value)).cast("bigint")


def apart(one: str | Column, two: str | Column) -> Column:
    """Number of differing bits."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (one, two))
    return F.bit_count(a.bitwiseXOR(b))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(mask, key, fp) for every fingerprint and mask."""
    listed = F.array(*[F.struct(_long(m).alias("mask"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for m in masks(_ALL, BLOCKS)])
    return nodes.select("fp", F.explode(listed).alias("b")).select("b.mask", "b.key", "fp")


def _with_leader(members: DataFrame, leader: Column) -> DataFrame:
    """Links of members with the leader of their bucket."""
    leaders = members.groupBy("mask", "key").agg(leader.alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = members.join(leaders, ["mask", "key"]).where((F.col("fp") != F.col("leader")) & (apart("fp", "leader") <= APART))
    return met.select(F.least("fp", "leader").alias("a"), F.greatest("fp", "leader").alias("b")).distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """Members (mask, key, fp, root) of buckets that hold more than one group, with the size of the bucket."""
    sizes = members.groupBy("mask", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    return members.join(sizes.where("lo < hi").select("mask", "key", "n"), ["mask", "key"])


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    joined = members.join(roots, members["fp"] == roots["node"], "left")
    return joined.withColumn("root", F.coalesce("root", "fp")).drop("node")


def _across(members: DataFrame) -> DataFrame:
    """Links between members of one bucket that are in different groups."""
    other = members.select("mask", "key", F.col("fp").alias("fp_"), F.col("root").alias("root_"))
    near = (F.col("fp") < F.col("fp_")) & (F.col("root") != F.col("root_")) & (apart("fp", "fp_") <= APART)
    return members.join(other, ["mask", "key"]).where(near).select(F.col("fp").alias("a"), F.col("fp_").alias("b"))


def _finer(members: DataFrame, coarse: list[int], blocks: int) -> DataFrame:
    """The same members in buckets that fix more bits."""
    pairs = [(_signed(m), _signed(m | f)) for m in coarse for f in masks(_ALL & ~m, blocks)]
    table = members.sparkSession.createDataFrame(pairs, "mask bigint, finer bigint")
    dealt = members.join(table, "mask")
    return dealt.select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp", "root").distinct()


def groups(fingerprints: DataFrame, large: int = LARGE) -> DataFrame:
    """(node, root) of all fingerprints (column fp, distinct) that are not their group's smallest."""
    buckets = _buckets(fingerprints)
    roots = components(materialise(_with_leader(buckets, F.min("fp")), "links"))
    kept = buckets.join(buckets.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["mask", "key"])
    open_ = materialise(_mixed(_with_roots(kept, roots)), "mixed")
    links = _with_leader(open_.drop("n"), F.max("fp"))
    # The stars so far stand for the links that made them.
    roots = components(materialise(links.union(roots.select("root", "node")), "links"))

    level, coarse, found = open_.drop("n", "root"), masks(_ALL, BLOCKS), None
    for blocks in (*FINER, None):
        level = materialise(_mixed(_with_roots(level, roots)), "mixed")
        here = _across(level if blocks is None else level.where(F.col("n") <= large))
        found = here if found is None else found.union(here)
        if blocks is None or (rest := level.where(F.col("n") > large)).isEmpty():
            break
        level = _finer(rest, coarse, blocks).drop("root")
        coarse = sorted({m | f for m in coarse for f in masks(_ALL & ~m, blocks)})
    return components(materialise(found.distinct().union(roots.select("root", "node")), "links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = materialise(plain.mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "fingerprints")
    nodes = materialise(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = groups(nodes.select("fp"))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = spread_join(rooted.select("fp", "root"), smallest, ["root"], spread_on=[F.col("fp")]).select("fp", "component_id")
    out = spread_join(rows, classes, ["fp"], "left", spread_on=[F.col("doc_id")])
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
