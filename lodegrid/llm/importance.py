"""Resampling documents towards a target distribution, by hashed n-gram importance weights and segment deduplication.

Features are the words of a text and its pairs of neighbouring words, hashed into ``BUCKETS`` buckets by crc32. A bucket's
gain is a thousand times the log ratio of its smoothed shares in the target and in the documents, a document's weight is
the mean gain of its features, and a draw without replacement keeps the highest weight plus Gumbel noise.

Segment deduplication: a newline ends a word, so it cuts a text into lines (segments) whose features stand alone. A
segment is known by its words only. Every distinct segment is met once, however often it occurs: its features are counted
once and enter the corpus totals multiplied by its occurrences, and its summed gain is taken once and sent to all places where
it stands. Word pairs across two lines belong to no segment and are added separately, per place.

Nothing is collected but the bucket counts (``BUCKETS`` numbers). A segment that holds over a thousandth of all places
can be one of a thousand at most, so these are broadcast and no key of the join holds more than that.

Defined results: a null or empty text, or one without words, has no features and weight 0; repeated rows are rows of
their own, each with its weight and its place in the draw; a row without doc_id gets a weight, but no score, and
takes no part in the draw. With an empty target or no documents all counts are 0 and the formula still holds. Ties go to
the smaller doc_id. Columns beside ``doc_id`` and ``text`` are not looked at. Segments are read one chunk of texts at a
time, so memory is bounded by the longest text.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.llm import text as T
from lodegrid.operators.ranking import numbered
from lodegrid.session import materialise

BUCKETS = 10_000
#: Places of which one in so many must be a segment's for it to be broadcast.
HOT = 1_000
_TABLE = T.ALPHANUMERIC[:10] + b"\n" + T.ALPHANUMERIC[11:]


def segments(text: bytes | None) -> Iterator[bytes]:
    """Lines of a text that hold words, as their words in lower case, joined by one space."""
    for line in (text or b"").translate(_TABLE).split(b"\n"):
        if words := line.split():
            yield b" ".join(words)


def _key(segment: bytes) -> tuple[int, int]:
    """128 bits in two signed halves."""
    digest = xxhash.xxh3_128_digest(segment)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def buckets_of(segment: bytes) -> list[int]:
    """Bucket of each word and of each pair of neighbouring words; a pair's crc goes on from that of its first word."""
    words = segment.split(b" ")
    one = [crc32(w) for w in words]
    return [c % BUCKETS for c in one] + [crc32(w, crc32(b" ", c)) % BUCKETS for c, w in zip(one, words[1:])]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in T.chunks(texts):
            found = Counter(s for t in texts[a:b] for s in segments(t))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["segment", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column("segment").to_pylist()
        for a, b in T.chunks(found):
            keys = [_key(s) for s in found[a:b]]
            lists = [buckets_of(s) for s in found[a:b]]
            flat = np.fromiter((x for each in lists for x in each), np.int16)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), batch.column("n").slice(a, b - a),
                T.int_lists(flat, np.array([len(x) for x in lists]), pa.int16())], ["hi", "lo", "n", "buckets"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment of a text, with the bucket of the pair that crosses to it; one without key for a text without words."""
    for batch in batches:
        texts, ids, rows = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for a, b in T.chunks(texts):
            out: list[tuple] = []
            for i in range(a, b):
                last, size = b"", len(out)
                for s in segments(texts[i]):
                    first, _, rest = s.partition(b" ")
                    cross = crc32(b"%b %b" % (last, first)) % BUCKETS if last else None
                    out.append((rows[i], ids[i], *_key(s), s.count(b" ") + 1, cross))
                    last = rest.rpartition(b" ")[2] or first
                if len(out) == size:
                    out.append((rows[i], ids[i], None, None, 0, None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "doc_id", "hi", "lo", "words", "bucket"])


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task per bucket, each feature counted as often as its segment occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        lists, n = batch.column("buckets"), batch.column("n").to_numpy()
        flat = lists.values.to_numpy()[lists.offsets[0].as_py():lists.offsets[-1].as_py()]
        total += np.bincount(flat, np.repeat(n, np.diff(lists.offsets.to_numpy())), BUCKETS).astype(np.int64)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "count"])


class Segments:
    """Distinct segments with their features, and the places where they stand; both stored, each made once."""

    def __init__(self, docs: DataFrame):
        plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        found = plain.select("text").mapInArrow(_distinct, "segment binary, n bigint").groupBy("segment").agg(F.sum("n").alias("n"))
        self.distinct = materialise(found.mapInArrow(_features, "hi bigint, lo bigint, n bigint, buckets array<smallint>"), "segments")
        self.places = materialise(plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            _places, "row bigint, doc_id bigint, hi bigint, lo bigint, words bigint, bucket int"), "places")

    def counts(self) -> np.ndarray:
        """Occurrences of each bucket in the corpus."""
        inside = self.distinct.select("n", "buckets").mapInArrow(_weighted, "bucket int, count bigint")
        across = self.places.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("count"))
        out = np.zeros(BUCKETS, np.int64)
        for r in inside.union(across).groupBy("bucket").agg(F.sum("count").alias("count")).collect():
            out[r["bucket"]] = r["count"]
        return out

    def summed(self, gains: np.ndarray) -> DataFrame:
        """row, doc_id, n_words, gain: the gains of all features of each text."""
        def per_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("buckets")
                offsets = lists.offsets.to_numpy()
                running = np.concatenate([[0], np.cumsum(gains[lists.values.to_numpy()[offsets[0]:offsets[-1]]])])
                sums = running[offsets[1:] - offsets[0]] - running[offsets[:-1] - offsets[0]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("hi"), batch.column("lo"), batch.column("n"), pa.array(sums, pa.int64())], ["hi", "lo", "n", "gain"])

        sums = materialise(self.distinct.mapInArrow(per_segment, "hi bigint, lo bigint, n bigint, gain bigint"), "gains")
        spark = sums.sparkSession
        total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        often = F.col("n") * HOT > total
        hot = F.broadcast(sums.where(often).drop("n"))
        cross = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(gains)], "bucket int, cross bigint"))
        places = self.places.join(cross, "bucket", "left").drop("bucket")
        both = places.join(hot, ["hi", "lo"]).unionByName(
            places.join(hot, ["hi", "lo"], "left_anti").join(sums.where(~often).drop("n"), ["hi", "lo"], "left"))
        gain = F.coalesce("gain", F.lit(0)) + F.coalesce("cross", F.lit(0))
        return both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("words").alias("n_words"), F.sum(gain).alias("gain"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log ratio of the smoothed shares, in thousandths, per bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = [(float(t) + 1) * s_all / ((float(s) + 1) * t_all) for s, t in zip(source, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for what is not drawn.

    ``percent`` of the documents with ``least_words`` words or more are drawn, rounded down.
    """
    ours = Segments(docs)
    table = gains(ours.counts(), Segments(target.select(F.lit(None).alias("doc_id"), "text")).counts())
    features = F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("bigint")
    weighed = ours.summed(table).withColumn("n_features", features)
    floored = F.expr("(gain - pmod(gain, n_features)) div n_features")
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    chance = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    weighed = weighed.withColumn("weight", F.when(F.col("n_features") > 0, floored).otherwise(0).cast("bigint"))
    weighed = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(chance))).cast("bigint"))
    weighed = materialise(weighed.select("row", "doc_id", "n_words", "n_features", "weight", "score"), "weights")
    within = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    order = [F.col("score").desc(), F.col("doc_id"), F.col("row")]
    placed = numbered(weighed.where(within), [], order, "place")
    rank = F.when(F.col("place") <= F.floor(percent * F.col("n") / 100), F.col("place")).cast("bigint")
    rest = weighed.where(~F.coalesce(within, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.withColumn("rank", rank).select(*out).unionByName(rest.select(*out))
