import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrid.llm import hardneg as hn
from lodegrid.llm.queries import QUERIES

SCHEMA = "vec_id bigint, label int, embedding array<double>"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, is_anchor):
    """Every anchor with every row, in Python's own integers."""
    whole = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    for a, label, q in whole:
        if not is_anchor(a):
            continue
        met = [(-sum(x * y for x, y in zip(q, p)), i, m == label) for i, m, p in whole if i != a]
        positives = sorted(x[:2] for x in met if x[2])[:5]
        for ps, p in positives:
            fit = sorted(x[:2] for x in met if not x[2] and 50 * -ps <= 100 * -x[0] <= 95 * -ps)[:3]
            out += [(a, p, k + 1, i, -ps, -ns) for k, (ns, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every=50):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("shard", F.lit("x"))
    return sorted(tuple(r[c] for c in COLUMNS) for r in hn.mine(df, F.col("vec_id") % every == 0).collect())


def clustered(n=700, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    which = rng.integers(0, 12, n)
    points = centres[which] + rng.normal(size=(n, dim)) * 0.05
    return [(i, int(w % 4), [round(float(x), 3) for x in p]) for i, (w, p) in enumerate(zip(which, points))]


@pytest.mark.parametrize("shard,block", [((2_048, 65_536), 8_192), ((60, 60), 4)])
def test_matches_every_anchor_with_every_row(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hn, "SHARD", shard)
    monkeypatch.setattr(hn, "BLOCK", block)
    rows = clustered()
    rows += [(1000 + i, i % 3, [0.25] * 8) for i in range(150)]  # copies: many ties, and one cell with many rows
    assert mined(spark, rows) == plain(rows, lambda i: i % 50 == 0)


def test_bounds_hold_and_spare_cells(spark):
    """A search in clustered rows ends long before it has seen them all, and with the right answer."""
    rows = clustered(4000, seed=3)
    q = np.array([[math.floor(256 * x) for x in v] for _, _, v in rows])
    ids, labels = np.arange(len(rows)), np.array([r[1] for r in rows])
    books = hn.Codebooks(q[:500], 8)
    cells = hn.Cells(books, q, ids, labels)
    anchor = q[17]
    first, second = books.bounds(anchor[None], cells.radii)
    seen, scores = 0, cells.q @ anchor
    place = {int(i): k for k, i in enumerate(cells.ids)}
    visited = set()
    for some, left in cells.visit(first[0], second[0]):
        visited |= set(some.tolist())
        rest = np.setdiff1d(np.arange(len(q)), np.fromiter(visited, int))
        assert not len(rest) or scores[rest].max() <= left
        seen += 1
    assert len(visited) == len(q) == len(place) and seen > 3
    used = []
    visit = cells.visit

    def counted(*halves):
        for some, left in visit(*halves):
            used.append(len(some))
            yield some, left

    cells.visit = counted
    found, names = hn.positives_in(cells, cells.q, anchor, 17, int(labels[17]), (first[0], second[0]), None)
    every = [(-int(s), int(i)) for s, i in zip(scores, cells.ids) if labels[i] == labels[17] and i != 17]
    assert list(zip((-found).tolist(), names.tolist())) == sorted(every)[:5]
    assert sum(used) < len(q) / 2


def test_rows_that_take_no_part_repeats_and_odd_lengths(spark):
    rows = clustered(120, dim=5, seed=6)
    rows += [(200, None, [1.0] * 5), (250, 1, None), (300, 1, [1.0, None, 0.0, 0.0, 0.0]), (350, 1, [math.nan] * 5), (400, 1, [math.inf] * 5), (None, 1, [1.0] * 5)]
    rows += [rows[50], rows[3], rows[3], (450, 2, [0.5, 0.25]), (500, 2, []), (0, 3, [0.9] * 5)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("size", [2.0 ** 14, 2.0 ** 21, 2.0 ** 22])
def test_large_components_are_not_rounded(spark, size):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, [float(x) * size / 3 for x in rng.uniform(0.5, 1, 6)]) for i in range(60)]
    assert mined(spark, rows, 20) == plain(rows, lambda i: i % 20 == 0)


def test_negative_and_zero_scores_one_label_and_empty_table(spark):
    rows = [(i, i % 2, [float((-1) ** i), 0.0]) for i in range(20)] + [(50 + i, i % 2, [0.0, 0.0]) for i in range(6)]
    assert mined(spark, rows, 10) == plain(rows, lambda i: i % 10 == 0)
    assert mined(spark, [(i, 1, [1.0, 2.0]) for i in range(30)], 10) == []
    assert mined(spark, []) == []


def test_registered_query_matches_every_anchor_with_every_row(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_hard_negatives"](spark, sf).collect())
    assert got and got == plain(rows, lambda i: i % 50 == 0)
