import random
import re

import numpy as np
import pytest
import xxhash

from lodegrid.llm import simhash as sh
from lodegrid.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string"


def plain_fingerprint(text):
    """Word by word and bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest reachable id by comparing every pair; prints: id to fingerprint."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(values[k + 1:] ^ values[k]) <= 3) + k + 1
        for j in near:
            a, b = top(i), top(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def check(spark, rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_groups(prints)
    got = sh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(got) == len(rows)
    return want


def test_fingerprints_and_groups_match_comparing_every_pair(spark):
    rng = random.Random(5)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for _ in range(15):
            text = list(words)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(300)] = f"e{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Two words"), (1004, "two WORDS"), (1005, "É é ü x y z"), (1006, "a a a a a a")]
    rows += [(2000 + i, "the same text said over and over") for i in range(50)]
    rng.shuffle(rows)
    want = check(spark, rows)
    assert want[1001] == want[1002] == 1000 and want[2049] == 2000
    assert any(want[i] != i for i in range(180))


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sh, "_PIECE", 50)
    rng = random.Random(2)
    for n in (1, 2, 3, 40, 900):
        text = "".join(f"Wort{rng.randrange(30)}é" + rng.choice(" \n\t") for _ in range(n))
        assert sh.fingerprint(text.encode()) == plain_fingerprint(text)
    assert sh.fingerprint(b"x" * 500) == plain_fingerprint("x" * 500)


def test_masks_hold_a_bucket_for_every_close_pair():
    rng = random.Random(9)
    for free, blocks in ((sh._ALL, sh.BLOCKS), (0xFFFF_FFFF, 8), (0xFFF0, 6)):
        bits = [i for i in range(64) if free >> i & 1]
        found = sh.masks(free, blocks)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(bits, 3))
            assert any(not m & flip for m in found)
    assert min(bin(m).count("1") for m in sh.masks(sh._ALL, sh.BLOCKS)) == 31


@pytest.mark.parametrize("large", [3, 64])
def test_crowded_buckets_go_to_finer_ones_and_lose_no_link(spark, large):
    """Fingerprints that all share 40 bits, so that the first buckets are as large as they get."""
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 24, 260).astype(np.uint64) & np.uint64(0x3FFFF))
    chain = np.cumsum(np.r_[0, np.full(6, 7)]).astype(np.uint64) << np.uint64(30)  # a chain of near neighbours beside them
    values = np.unique(np.concatenate([values, chain]))
    frame = spark.createDataFrame([(int(v),) for v in values], "fp bigint")
    root = {r.node: r.root for r in sh.groups(frame, large).collect()}
    want = plain_groups({int(v): int(v) for v in values})
    assert {int(v): root.get(int(v), int(v)) for v in values} == want


def test_rows_without_id_repeated_rows_and_empty_table(spark):
    rows = [(None, "one two three four"), (7, "one two three four"), (7, "one two three four"), (7, "something else there is"), (9, "something else there is")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS fp", "'x' AS root", "'y' AS fingerprint")
    got = sorted(sh.near_duplicates(docs).collect(), key=str)
    assert len(got) == 5 and [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.component_id for r in got if r.doc_id in (7, 9)} == {7}
    assert sh.near_duplicates(docs.where("false")).collect() == []


def test_registered_query_matches_comparing_every_pair(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = plain_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op11_simhash_blocks"](spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
