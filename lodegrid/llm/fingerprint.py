"""Threshold-scaled document fingerprints. DataFrame expressions only.

A fingerprint holds every shingle hash of a document below a fixed fraction of the hash range, so fingerprints of
parts merge into that of the whole, and a short document can be measured against a very long one: both kept the
same hashes of what they share. Shingles are five words; a document of fewer words is one shingle. As a fixed
fraction alone leaves most short documents with nothing, the ``AT_LEAST`` smallest hashes are kept as well; two
fingerprints are compared below the lower of their thresholds, where both are complete.

The next document of each one (ascending doc_id) comes from one shuffle into ranges of doc_id, cut at quantiles, in
which a window looks one row ahead; the first document of a range is sent to the range before it as well. No task
sees more than its range, and the cut points are all that reaches the driver.

Defined results: a null text is an empty text and has an empty fingerprint; two empty fingerprints have likeness 1,
an empty and another one 0; rows that share a doc_id are ordered by text among themselves; rows without doc_id come
before all others; a single document is its own next; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One hash of 2 ** FRACTION_BITS is kept.
FRACTION_BITS = 3
AT_LEAST = 32
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_CUT = _LOWEST + (1 << (64 - FRACTION_BITS))
#: Ranges of doc_id per shuffle partition.
RANGES = 4


def sketch(text: Column) -> Column:
    """Kept shingle hashes in ascending order. Words are split at white space, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))

    # A one-element array carries the words, so that they are split once.
    every = F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, hashes(w)).otherwise(F.array().cast("array<bigint>"))))
    return F.flatten(F.transform(F.array(F.sort_array(F.array_distinct(every))), lambda a: F.filter(a, lambda h, i: (h < _CUT) | (i < AT_LEAST))))


def threshold(kept: Column) -> Column:
    """Hashes below this are complete in the sketch."""
    return F.when(F.size(kept) < AT_LEAST, F.lit(_HIGHEST)).otherwise(F.greatest(F.lit(_CUT), F.element_at(kept, -1)))


def merged(a: Column, b: Column) -> Column:
    """Fingerprint of two documents as one: complete below the lower threshold of the two."""
    top = F.least(threshold(a), threshold(b))
    return F.filter(F.sort_array(F.array_union(a, b)), lambda h, i: (h <= top) | (i < AT_LEAST))


def _shared(a: Column, b: Column, measure) -> Column:
    both = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), F.least(threshold(a), threshold(b)).alias("t"))), lambda s: F.struct(
        F.filter(s["a"], lambda h: h <= s["t"]).alias("a"), F.filter(s["b"], lambda h: h <= s["t"]).alias("b")))
    return F.transform(both, lambda s: measure(F.size(F.array_intersect(s["a"], s["b"])), F.size(s["a"]), F.size(s["b"])))[0]


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: shared shingles over all shingles of the two."""
    return _shared(a, b, lambda n, p, q: F.when(p + q == 0, 1.0).otherwise(n / (p + q - n)))


def containment(a: Column, b: Column) -> Column:
    """Estimated part of ``a`` that is in ``b``; null where none of ``a`` lies where both are complete."""
    return F.when(F.size(a) == 0, 1.0).otherwise(_shared(a, b, lambda n, p, q: F.when(p > 0, n / p)))


def as_text(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _range_of(cuts: list[int], doc_id: Column) -> Column:
    """Number of cuts below ``doc_id``, found in two steps of about the root of their number each."""
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)
    heads = F.lit([g[0] for g in groups]).cast("array<bigint>")
    fine = F.array(*[F.lit(g).cast("array<bigint>") for g in groups])
    group = F.size(F.filter(heads, lambda c: c < doc_id))
    below = F.size(F.filter(F.element_at(fine, F.greatest(group, F.lit(1))), lambda c: c < doc_id))
    return F.when(group == 0, 0).otherwise((group - 1) * step + below)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id and ``columns``) with ``next_<column>`` of the next document, that of the first after the last."""
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_id", F.coalesce("doc_id", F.lit(_LOWEST)))
    cuts = keyed.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    keyed = keyed.withColumn("_range", _range_of(sorted(set(cuts)), F.col("_id")))
    firsts = sorted(keyed.groupBy("_range").agg(F.min("_id")).collect())
    at = {r: i for i, (r, _) in enumerate(firsts)}
    last = max(at, default=0)
    first_id = F.lit([firsts[at[r]][1] if r in at else None for r in range(last + 1)] or [None]).cast("array<bigint>")
    before = F.lit([firsts[at[r] - 1][0] if r in at else 0 for r in range(last + 1)] or [0]).cast("array<int>")
    # The first document of a range also goes, as a guard, to the end of the range before it.
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("guard"))
    guard = F.struct(F.element_at(before, F.col("_range") + 1).alias("r"), F.lit(True).alias("guard"))
    is_first = F.element_at(first_id, F.col("_range") + 1) == F.col("_id")
    sent = keyed.withColumn("_at", F.explode(F.when(is_first, F.array(own, guard)).otherwise(F.array(own))))
    ahead = Window.partitionBy("_at.r").orderBy("_at.guard", "_id", *columns[:1])
    found = sent.withColumns({f"next_{c}": F.lead(c).over(ahead) for c in columns})
    return found.where("NOT _at.guard").drop("_id", "_range", "_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of an edited text: its last quarter replaced by as much of the next document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(rows.withColumn("kept", sketch(F.col("text"))), ["text", "kept"])
    n = F.char_length("text")
    swap = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - swap), F.substring(F.col("next_text"), F.lit(1), swap))
    paired = paired.select("doc_id", n.cast("bigint").alias("n_chars"), "kept", "next_kept", edited.alias("edited"))
    paired = paired.withColumn("kept_edited", sketch(F.col("edited")))
    return paired.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("kept")).alias("fingerprint"),
        as_text(F.col("kept_edited")).alias("edited_fingerprint"), likeness(F.col("kept"), F.col("kept_edited")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"))
