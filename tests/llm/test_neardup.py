import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodegrid.llm import neardup as nd

SCHEMA = "doc_id bigint, text string"


def plain_sets(rows):
    out = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
        out[doc_id] = frozenset(runs)
    return out


def brute(rows):
    """Smallest reachable doc_id by comparing every pair."""
    sets = plain_sets(rows)
    root = {k: k for k in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return sets, root


def family(seed, members, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(members):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(words)] = f"e{rng.randrange(5000)}"
        yield " ".join(text)


def test_groups_match_comparing_every_pair(spark):
    rows = [(i, t) for i, t in enumerate(t for seed in range(6) for t in family(seed, 25))]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Only three words"), (1004, "only THREE words"), (1005, "É é ü x y z")]
    rows += [(2000 + i, "the very same text said many times over") for i in range(40)]
    random.Random(1).shuffle(rows)
    sets, root = brute(rows)
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        k: (len(sets[k]), root[k], root[k] == k) for k in sets}


def test_rows_without_words_or_id_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (8, None), (8, None)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (8, 8, True)]


def test_keep_one_passes_other_columns_and_empty_tables(spark):
    rows = [(1, "x y z u v w", "s", 3), (2, "x y z u v w", "s", 4), (3, "other words in here now", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, kept int")
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert nd.keep_one(docs.where("false")).count() == 0


def test_components_of_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(50, 80)] + [(90, 95), (95, 93), (93, 90), (93, 2)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 50 for i in range(51, 81)}, 90: 2, 93: 2, 95: 2}


def test_signatures_estimate_resemblance():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:857], np.unique(rng.integers(0, 1 << 63, 143).astype(np.uint64))])
    true = 857 / (len(a) + 143)
    assert abs((nd.signature(a) == nd.signature(b)).mean() - true) < 0.12
    differing = np.unpackbits((nd.long_bits(a) ^ nd.long_bits(b)).view(np.uint8)).sum() / (2 * nd.LONG)
    assert abs(differing - (1 - true) / 2) < 0.03


def test_long_cut_keeps_pairs_of_short_texts_above_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for shared, one, other in ((3, 1, 0), (4, 1, 0), (6, 1, 1), (9, 3, 0), (12, 2, 2), (15, 5, 0), (33, 11, 0), (45, 7, 8)):
        for _ in range(150):
            s = rng.integers(0, 1 << 63, shared + one + other, dtype=np.uint64)
            pair = s[:shared + one], np.concatenate([s[:shared], s[shared + one:]])
            rows.append((f"{shared}/+{one}/+{other}", *(nd.long_bits(x).tolist() for x in pair)))
    pairs = spark.createDataFrame(rows, "kind string, one array<bigint>, two array<bigint>")
    assert {r.kind: r["count"] for r in pairs.where(~nd._close("one", "two")).groupBy("kind").count().collect()} == {}


def test_links_between_groups_of_one_bucket_are_found(spark):
    """Members far from the bucket's smallest are still met: a chain of texts, each like the next only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i:8 * i + 100])) for i in range(30)]
    _, root = brute(rows)
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert len(set(root.values())) == 1


def test_texts_are_picked_by_a_bitmap_that_misses_none(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 50 = 49 THEN NULL ELSE id - 500 END AS doc_id", "concat('a b c d e f ', id) AS text")
    ids = docs.where("doc_id % 7 = 0").select("doc_id")
    for bits in (1 << 27, 4096):
        monkeypatch.setattr(nd, "MOST_BITS", bits)
        got = {r.id for r in nd._made_again(docs, ids, nd._sets, "id bigint, shingles array<bigint>").collect()}
        want = {r.doc_id for r in ids.collect()}
        assert want <= got and None not in got
        assert bits < 5000 or len(got) < 1.2 * len(want)
    assert nd._made_again(docs, ids.where("false"), nd._sets, "id bigint, shingles array<bigint>").count() == 0


def test_very_long_texts(spark):
    words = [f"w{i % 9973}x{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[60_000:])), (4, " ".join(words[:-30_100]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (119_996, 1), 2: (119_496, 1), 3: (59_996, 3), 4: (89_896, 1)}
