import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from lodegrid.llm import importance as im
from lodegrid.llm import text as T
from lodegrid.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string"


def plain_features(text):
    """Buckets of the whole text, without looking at its lines."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_rows(docs, target):
    s, t = Counter(), Counter()
    found = [(i, *plain_features(x)) for i, x in docs]
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    S, N = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (N + 10000)))) for b in range(10000)}
    out = []
    for i, n, f in found:
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[:25 * len(able) // 100])}
    return sorted((r[0], *r[2:], rank.get(id(r), 0)) for r in out)


def rows_of(df):
    return sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank or 0) for r in df.collect())


def corpus(seed=3):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "x1", "é", "don't", "e-mail"]) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    rows = [(i, rng.choice(["\n", "\n\n", " \n--\n"]).join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "one"), (104, "a\nb"), (105, "\n" + lines[0] + "\n"), (106, "word " * 5000), (107, "x\r\ny\tz")]
    return rows + [(200 + i, "the same line\nevery time " + "said again " * 12) for i in range(40)]


@pytest.mark.parametrize("hot", [1, 20, 1_000])
def test_matches_features_of_whole_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(im, "HOT", hot)
    docs, target = corpus(), ["alpha beta gamma\nalpha x1", "é é beta", None]
    got = im.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string"))
    assert rows_of(got) == plain_rows(docs, target)


def test_a_segment_is_counted_once_and_multiplied(spark):
    docs = spark.createDataFrame([(i, "Same line\nother line, " + "ab"[i % 2]) for i in range(50)], SCHEMA)
    found = im.Segments(docs)
    assert sorted(r.n for r in found.distinct.collect()) == [25, 25, 50]
    want = Counter(b for i in range(50) for b in plain_features("Same line\nother line, " + "ab"[i % 2])[1])
    assert {int(b): int(n) for b, n in enumerate(found.counts()) if n} == dict(want)
    assert found.places.where("bucket IS NOT NULL").count() == 50


def test_chunks_do_not_change_anything(monkeypatch):
    docs = corpus(8)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "row": [i for i, _ in docs], "text": [t and t.encode() for _, t in docs]})

    def made():
        places = [r for b in im._places(iter([batch])) for r in b.to_pylist()]
        found = Counter()
        for b in im._distinct(iter([batch])):
            found.update({r["segment"]: r["n"] for r in b.to_pylist()})
        return places, found

    whole = made()
    chunks = T.chunks
    monkeypatch.setattr(T, "chunks", lambda texts: chunks(texts, 64))
    assert made() == whole


def test_rows_without_id_repeated_rows_other_columns_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (5, "short"), (6, text), (7, text)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS row", "2 AS gain", "3 AS bucket", "'x' AS segment")
    empty = spark.createDataFrame([], SCHEMA)
    got = im.resample(docs, empty, percent=100).collect()
    assert len(got) == 6
    drawn = sorted((r.rank, r.doc_id) for r in got if r.rank)
    assert [k for k, _ in drawn] == [1, 2, 3, 4] and sorted(i for _, i in drawn) == [5, 5, 6, 7]
    none = [r for r in got if r.doc_id is None]
    assert [(r.n_features, r.score, r.rank) for r in none] == [(59, None, None)]
    assert im.resample(empty, docs).collect() == []


def test_gains_of_empty_counts():
    assert set(im.gains(np.zeros(im.BUCKETS, int), np.zeros(im.BUCKETS, int))) == {0}


def test_registered_query_matches_features_of_whole_texts(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op12_importance_resampling"](spark, sf)) == plain_rows(docs, target)
