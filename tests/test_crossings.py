"""Crossings of lines against comparing every pair of segments."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrid.catalog import load_all
from lodegrid.catalog.registry import QUERIES
from lodegrid.functions.scalars import round_dp
from lodegrid.operators import lines as ln

SCHEMA = "line_id bigint, kind string, ax double, ay double, bx double, by double"


def turn(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def on(a, b, p):
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def touch(a, b, c, d):
    o1, o2, o3, o4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    sign = lambda v: (v > 0) - (v < 0)
    return (sign(o1) * sign(o2) < 0 and sign(o3) * sign(o4) < 0 or o1 == 0 and on(a, b, c) or o2 == 0 and on(a, b, d)
            or o3 == 0 and on(c, d, a) or o4 == 0 and on(c, d, b))


def brute(rows):
    return {(p[0], s[0]) for p in rows for s in rows if p[0] < s[0] and touch(p[2:4], p[4:6], s[2:4], s[4:6])}


def crowd(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = -120 + rng.random() * 0.05, 47 + rng.random() * 0.05
        for _ in range(rng.randrange(1, 4)):  # traces of one to three segments
            u, v = x + rng.uniform(-0.03, 0.03), y + rng.uniform(-0.03, 0.03)
            rows.append((i, "fault", x, y, u, v))
            x, y = u, v
    rows += [(n, "fault", -120.0, 47.02, -119.9, 47.02), (n + 1, "fault", -120.0, 47.0, -120.0, 47.1), (n + 2, "fault", -119.98, 47.02, -119.94, 47.02),
             (n + 3, "fault", -119.98, 47.02, -119.98, 47.02), (n + 4, "fault", -119.96, 47.0, -119.96, 47.02), (n + 5, "fault", -119.96, 47.02, -119.96, 47.0)]
    return rows


@pytest.mark.parametrize("side,most,deepest", [(0.02, 64, 4), (0.02, 4, 2), (0.5, 3, 3), (0.004, 1, 1)])
def test_crossings_match_every_pair_of_segments(spark, side, most, deepest):
    rows = crowd(3, 60)
    points = ln.crossing_points(spark.createDataFrame(rows, SCHEMA), side, most, deepest).collect()
    assert {(p.line_id, p.other_id) for p in points} == brute(rows)
    for p in points:
        near = lambda a, b: abs(turn(a, b, (p.x, p.y))) < 1e-12 and on((a[0] - 1e-9, a[1] - 1e-9), (b[0] + 1e-9, b[1] + 1e-9), (p.x, p.y)) or on(a, b, (p.x, p.y))
        for line in (p.line_id, p.other_id):
            assert any(near(r[2:4], r[4:6]) for r in rows if r[0] == line)


def test_a_crossing_is_found_in_one_square_only(spark):
    """Two segments that pass many squares together meet once."""
    rows = [(1, "fault", -120.0, 47.0, -119.0, 48.0), (2, "fault", -120.0, 48.0, -119.0, 47.0), (3, "fault", -120.0, 47.0001, -119.0, 48.0001)]
    got = ln.crossing_points(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((p.line_id, p.other_id, round(p.x, 6), round(p.y, 6)) for p in got) == [(1, 2, -119.5, 47.5), (2, 3, -119.50005, 47.50005)]


def test_more_than_twelve_faults_in_a_cell_are_counted(spark):
    rows = [(i, "fault", -120.0, 47.0 + i / 1000, -119.9, 47.0 + i / 1000) for i in range(20)] + [(100, "fault", -119.95, 46.9, -119.95, 47.1)]
    segments = spark.createDataFrame(rows, SCHEMA)
    near = spark.createDataFrame([("c", r[0], "fault", 0.0) for r in rows] + [("d", 0, "fault", 0.0), ("d", 100, "fault", 5.0)], "cell string, line_id bigint, kind string, distance_m double")
    assert [(r.cell, r.fault_intersections_in_cell) for r in ln.fault_crossings_all(near, segments, ["cell"]).collect()] == [("c", 20)]


def test_cells_with_more_than_twelve_faults_are_not_left_out(spark, tmp_path):
    """Twenty faults that begin in one point of an area's cell: all 190 pairs of them meet there."""
    # Places of occurrences come back after 264,000 keys; 15196 lies near area 1.
    customers = spark.range(20).select((15196 + F.col("id") * 264000).alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1).select(F.lit(1).cast("bigint").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    load_all()
    found = {name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("cell_fault_crossings", "fault_crossings_all")}
    assert max(n for *_, n in found["cell_fault_crossings"]) == 190
    assert found["cell_fault_crossings"] == found["fault_crossings_all"]


@pytest.mark.parametrize("held", [4096, 10, 1])
def test_pairs_of_faults_are_counted_in_blocks_of_bounded_size(spark, held):
    """However a cell is dealt out, each pair that touches counts once; parallel, shared and empty segments included."""
    rows = crowd(5, 40)
    cells = {"a": set(range(46)), "b": set(range(0, 46, 3)), "c": {1}, "d": {40, 42, 43, 44, 45}}
    near = spark.createDataFrame([(c, i, "fault", 0.0) for c, ids in cells.items() for i in ids], "cell string, line_id bigint, kind string, distance_m double")
    got = ln.fault_crossings_all(near, spark.createDataFrame(rows, SCHEMA), ["cell"], held).collect()
    pairs = brute(rows)
    want = {c: sum(1 for a, b in pairs if a in ids and b in ids) for c, ids in cells.items()}
    assert {r.cell: r.fault_intersections_in_cell for r in got} == {c: n for c, n in want.items() if n}


def test_tiles_give_the_pairs_of_all_segments():
    rng = np.random.default_rng(7)
    lines = rng.permutation(np.repeat(np.arange(300), 4))
    ends = rng.integers(0, 60, (4, 1200)).astype(float)
    ends[2:] = ends[:2] + rng.integers(-4, 5, (2, 1200))
    met = np.zeros((300, 300), bool)
    for i in range(1200):
        met[lines[i], lines[ln._touching_ends(np.repeat(ends[:, i:i + 1], 1200, 1), ends)]] = True
    assert ln._count_touching(lines, ends) == np.count_nonzero(np.triu(met, 1))
    second = lines % 3 == 0
    assert ln._count_touching(lines, ends, second) == np.count_nonzero(met[np.arange(300) % 3 != 0][:, np.arange(300) % 3 == 0])


def test_rounded_points_are_distinct_without_a_shuffle_of_them(spark):
    """A vertex shared by two segments, and points on both sides of a square's border that round to one, are told once."""
    rows = crowd(9, 40) + [(200, "fault", -119.99, 47.005, -119.98, 47.01), (200, "fault", -119.98, 47.01, -119.97, 47.0), (201, "fault", -119.98, 47.0, -119.98, 47.02)]
    rows += [(202, "fault", -119.9800003, 47.03, -119.9800003, 47.05), (202, "fault", -119.9800003, 47.05, -119.9799997, 47.05), (202, "fault", -119.9799997, 47.05, -119.9799997, 47.03), (203, "fault", -120.0, 47.04, -119.95, 47.04)]
    segments = spark.createDataFrame(rows, SCHEMA)
    points = ln.crossing_points(segments, 0.02, places=6)
    assert points._jdf.queryExecution().executedPlan().toString().count("Aggregate") == 0
    got = [tuple(r) for r in points.collect()]
    assert len(got) == len(set(got)) and got.count((202, 203, -119.98, 47.04)) == 1 and got.count((200, 201, -119.98, 47.01)) == 1
    plain = ln.crossing_points(segments, 0.5).select("line_id", "other_id", round_dp(F.col("x"), 6), round_dp(F.col("y"), 6)).distinct()
    assert set(got) == {tuple(r) for r in plain.collect()}
