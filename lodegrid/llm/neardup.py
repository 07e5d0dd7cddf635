"""Near-duplicate groups by min-max hashing.

Each document is the set of its distinct word shingles. Under every permutation both the smallest and the
largest value are kept, so ``PERMUTATIONS`` hash evaluations yield twice as many signature values; the two
estimate the resemblance without bias and with a lower variance than as many minima would for the same work.
Four values make a band; documents that agree on a band are candidates. With 48 bands a pair at the threshold
(0.75) shares none with probability (1 - 0.75^4)^48 = 1.2e-8. In short texts the two values of a permutation are not
independent, and it is up to 1.0e-6 (3 of 4 shingles shared). Candidates are confirmed on full sets.

No group is ever collected, and copies are not expanded into pairs:

- Equal sets are collapsed to one node before anything else.
- A bucket is first a star: each member is compared with one leader only, and groups are joined by distributed connected
  components. The first stars are those of ``FIRST`` bands; after them, members of a bucket that are in one group
  already need nothing more, and most buckets hold one group.
- Members of a bucket in different groups are met by a longer signature, one bit of each of ``2 * LONG`` values, made
  for these members only: first with another leader per bucket, then, in the buckets that are still mixed, with
  each other, once per pair, in the first bucket that they share. Both joins keep pairs whose differing bits are within
  ``DEVIATIONS`` standard deviations of what the threshold gives; these are compared in full too. A bit is taken from
  a full mix of its value with a constant of its own, so bits are independent in texts of any length, and a pair at
  the threshold is lost with probability 1.8e-6 at most (binomial tails: 1.2e-6 for the first 1,024 bits, 6e-7 for all).
- Full sets are made again from text for candidates only, picked by a bitmap of their ids where the texts are read: no
  text is shuffled, and sets are never stored for all documents.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; a text of
fewer words than a shingle is one shingle; rows are kept as they come, repeated rows are equal sets and so one
group; a row without doc_id gets no component and is kept. Columns beside ``doc_id`` and ``text`` pass through
``keep_one`` untouched.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.llm import text as T
from lodegrid.session import materialise, spread_join

SHINGLE = 5
PERMUTATIONS = 96
ROWS = 4
PERCENT = 75
LONG = 2048
DEVIATIONS = 5.0
#: Slices and most bits (16 MB) of the filter by which texts are picked.
SLICES, MOST_BITS = 64, 1 << 27
FIRST = 8
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]
_ODD = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
_LONG_XOR = _rng.integers(0, 1 << 32, LONG, dtype=np.uint32)[:, None]
_LONG_ODD = (_rng.integers(0, 1 << 32, LONG, dtype=np.uint32) | np.uint32(1))[:, None]
#: A bit differs with half the probability that its value does.
_DIFFER = (1 - PERCENT / 100) / 2
_WORDS, _HEAD = 2 * LONG // 64, 16


def most_bits(words: int) -> int:
    """Differing bits in so many 64-bit words that a pair at the threshold may still have."""
    n = 64 * words
    return int(n * _DIFFER + DEVIATIONS * (n * _DIFFER * (1 - _DIFFER)) ** 0.5)


_BAND = _rng.integers(0, 1 << 63, (PERMUTATIONS * 2 // ROWS, ROWS), dtype=np.uint64) | np.uint64(1)
_LONG_SALT = _rng.integers(0, 1 << 64, (LONG, 2), dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = T.words_of(texts, T.BLANK_SEPARATED)
    hashes, firsts = words.hashes(), words.firsts()
    runs = T.runs_of(hashes, size)
    out = []
    for i, n in enumerate(words.per_doc):
        a = firsts[i]
        if n >= size:
            out.append(np.unique(runs[a:a + n - size + 1]))
        else:
            out.append(T.runs_of(hashes[a:a + n], int(n)) if n else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, xor: np.ndarray = _XOR, odd: np.ndarray = _ODD) -> np.ndarray:
    """Minimum and maximum under each permutation, as rows (minimum, maximum)."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(xor), 0xFFFFFFFF, np.uint32), np.zeros(len(xor), np.uint32)
    step = max(1, (1 << 17) // len(xor))
    for i in range(0, len(short), step):
        h = (short[None, i:i + step] ^ xor) * odd
        low, high = np.minimum(low, h.min(axis=1)), np.maximum(high, h.max(axis=1))
    return np.stack([low, high], axis=1)


def long_bits(shingles: np.ndarray) -> np.ndarray:
    """The highest bit of every value of the long signature, mixed with a constant of its own, packed into 64-bit integers.

    A low bit of the value itself would be the same property of a shingle under every permutation, as their factors are odd.
    """
    mixed = T.mix(signature(shingles, _LONG_XOR, _LONG_ODD).astype(np.uint64) ^ _LONG_SALT)
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    values = sig.reshape(-1, ROWS).astype(np.uint64)
    keys = (values * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(len(values), dtype=np.uint64)
    return T.mix(keys ^ (np.arange(len(values), dtype=np.uint64) << np.uint64(56)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in T.chunks(texts):
            sets = shingle_sets(texts[a:b])
            keys = [bands(signature(s)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                T.int_lists(np.concatenate(keys), np.array([len(k) for k in keys])),
            ], ["doc_id", "n_shingles", "set_key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in T.chunks(texts):
            sets = shingle_sets(texts[a:b])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(a, b - a),
                T.int_lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets])),
            ], ["id", "shingles"])


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in T.chunks(texts):
            sets = shingle_sets(texts[a:b])
            bits, keys = [long_bits(s) for s in sets], [bands(signature(s)).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(a, b - a), T.int_lists(np.concatenate(bits), np.array([len(x) for x in bits])),
                T.int_lists(np.concatenate(keys), np.array([len(x) for x in keys])),
            ], ["id", "bits", "bands"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for name in ("left", "right"):
            column = batch.column(name)
            sides.append((column.values.to_numpy(), column.offsets.to_numpy()))
        (lv, lo), (rv, ro) = sides
        shared = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            both = np.concatenate([lv[lo[i]:lo[i + 1]], rv[ro[i]:ro[i + 1]]])
            both.sort()
            shared[i] = np.count_nonzero(both[1:] == both[:-1])
        union = np.diff(lo) + np.diff(ro) - shared
        keep = pa.array(100 * shared >= PERCENT * union)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _spots(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice and bit of each id in a filter of ``SLICES`` slices of ``size`` bits."""
    h = T.mix(ids.view(np.uint64))
    return (h % np.uint64(SLICES)).astype(np.int32), ((h >> np.uint64(16)) % np.uint64(size)).astype(np.int64)


def _filter_of(ids: DataFrame) -> tuple[int, Broadcast]:
    """A bitmap that holds all ``ids``, of ``MOST_BITS`` at most; others are in it rarely, unless there are very many ids."""
    size = max(1024, min(16 * ids.count(), MOST_BITS) // SLICES)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _spots(batch.column(0).to_numpy(), size)], ["slice", "bit"])

    def slice_of(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = ids.mapInArrow(spots, "slice int, bit bigint").groupBy("slice").applyInArrow(slice_of, "slice int, bits binary").collect()
    bits = np.zeros((SLICES, -(-size // 8)), np.uint8)
    for r in found:  # the bitmap, not the ids
        bits[r["slice"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return size, ids.sparkSession.sparkContext.broadcast(bits)


def _made_again(docs: DataFrame, ids: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make`` of the texts of the documents in ``ids`` (one column, distinct, no nulls), and of a few others.

    Texts are picked where they are read, by a bitmap of the ids, so that none is shuffled. What is made of the
    others meets nothing in the joins that follow.
    """
    size, shared = _filter_of(materialise(ids.toDF("id"), "ids"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("doc_id")
            part, bit = _spots(column.fill_null(0).to_numpy(), size)
            there = (shared.value[part, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(there & column.is_valid().to_numpy(zero_copy_only=False)))

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return materialise(texts.mapInArrow(lambda batches: make(picked(batches)), schema), "made-again")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a < b) whose full sets are alike enough. Sets are made for the documents in ``pairs`` only."""
    needed = pairs.select(F.explode(F.array("a", "b"))).distinct()
    sets = _made_again(docs, needed, _sets, "id bigint, shingles array<bigint>")
    left, right = sets.toDF("a", "left"), sets.toDF("b", "right")
    sized = pairs.join(right, "b").join(left, "a").where(
        F.least(F.size("left"), F.size("right")) * 100 >= F.greatest(F.size("left"), F.size("right")) * PERCENT
    )
    return materialise(sized.select("a", "b", "left", "right").mapInArrow(_confirm, "a bigint, b bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not its own root; root is the smallest node that can be reached.

    Alternates large-star and small-star steps on (node, smaller neighbour) until every node has one neighbour
    that has none itself. Every step is written to the shared folder.
    """
    stars = edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v")
    while True:
        both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # Each node takes its smallest neighbour; the neighbours it had are sent there as well.
        sent = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = materialise(sent.distinct(), "stars")
        marks = stars.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                               F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("m"))
        tangled = marks.groupBy("m.n").agg(F.sum("m.up").alias("up"), F.max("m.down").alias("down")).where("up + down > 1 AND up > 0")
        if tangled.isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _open_members(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (band, id, root and other columns) of buckets that hold more than one group."""
    members = buckets.join(roots, buckets["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    mixed = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return materialise(members.join(mixed.select("band"), "band"), "mixed")


def _close(one: str, two: str) -> Column:
    """Whether two long signatures can be those of texts above the threshold; a few words of them decide most pairs."""
    head = sum((F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i])) for i in range(_HEAD)), F.lit(0))
    words = F.zip_with(one, two, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return (head <= most_bits(_HEAD)) & (F.aggregate(words, F.lit(0), lambda total, n: total + n) <= most_bits(_WORDS))


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Each open member with the leader of its bucket, where that is in another group and may be alike."""
    leaders = members.groupBy("band").agg(F.min_by(F.struct("id", "root", "bits"), F.xxhash64("id")).alias("l"))
    met = members.join(leaders, "band").where(F.col("root") != F.col("l.root")).where(_close("bits", "l.bits"))
    return met.selectExpr("least(id, l.id) AS a", "greatest(id, l.id) AS b")


def _member_pairs(members: DataFrame) -> DataFrame:
    """Open members of one bucket with each other, where they are in different groups, may be alike and share no bucket before."""
    two = members.toDF(*[f"{c}_" for c in members.columns])
    before = F.zip_with(F.slice("bands", F.lit(1), F.col("place")), F.slice("bands_", F.lit(1), F.col("place")), lambda a, b: a == b)
    met = members.join(two, (F.col("band") == F.col("band_")) & (F.col("id") < F.col("id_")) & (F.col("root") != F.col("root_"))
                       & _close("bits", "bits_") & ~F.exists(before, lambda same: same))
    return met.selectExpr("id AS a", "id_ AS b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = plain.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _signed, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")
    signed = materialise(signed, "signatures")
    nodes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    banded = nodes.select("id", F.posexplode("bands").alias("place", "band"))
    leaders = banded.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = materialise(banded.join(leaders.drop("n"), "band"), "buckets")

    tested = materialise(buckets.where(f"place < {FIRST} AND id > leader").selectExpr("leader AS a", "id AS b").distinct(), "pairs")
    roots = components(confirmed(plain, tested))
    members = _open_members(buckets.select("band", "place", "id"), roots)
    bits = _made_again(plain, members.select("id").distinct(), _long, "id bigint, bits array<bigint>, bands array<bigint>")
    members = members.join(bits, "id")
    for pairs in (_leader_pairs, _member_pairs):
        fresh = materialise(pairs(members).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        # The stars so far stand for their links.
        roots = components(confirmed(plain, fresh).union(roots.select("root", "node")))
        tested = tested.union(fresh)
        if pairs is _leader_pairs:
            members = _open_members(members.drop("root"), roots)
    members = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    classes = members.join(roots, members["id"] == roots["node"], "left").select(
        "set_key", F.coalesce("root", "id").alias("root"))
    # A set may be that of a third of all rows.
    out = spread_join(signed.drop("bands"), classes, ["set_key"], "left", salts=8, spread_on=[F.col("doc_id")])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the rows of its smallest doc_id."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
