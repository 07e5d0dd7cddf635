"""The geology store: key ranges lose nothing, and a window reads few files."""
import random

import pytest
from pyspark.sql import functions as F

from lodegrid.sinks import store


def boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, size = rng.uniform(-126, -115.5), rng.uniform(44.5, 50), rng.choice([0.0, 0.001, 0.01, 0.1, 1.0, 6.0])
        out.append((i, x, y, x + size * rng.random(), y + size * rng.random()))
    return out + [(n, -130.0, 40.0, -110.0, 55.0), (n + 1, -125.5, 45.0, -125.5, 45.0), (n + 2, -116.0, 49.5, -116.0, 49.5)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = boxes(3000, 1)
    path = str(tmp_path_factory.mktemp("store"))
    df = spark.createDataFrame(rows, "poly_id int, min_lon double, min_lat double, max_lon double, max_lat double")
    store._write(df, f"{path}/poly", "poly_id")
    return rows, path


WINDOWS = [(-121.0, 47.0, -120.9, 47.1), (-125.5, 45.0, -116.0, 49.5), (-118.0, 46.0, -116.5, 49.0), (-120.0, 47.0, -120.0, 47.0), (-140.0, 30.0, -100.0, 60.0), (-131.0, 39.0, -129.0, 41.0)]


@pytest.mark.parametrize("window", WINDOWS)
def test_a_window_gives_every_feature_that_meets_it(spark, written, window):
    rows, path = written
    w, s, e, n = window
    want = {i for i, x0, y0, x1, y1 in rows if x0 <= e and x1 >= w and y0 <= n and y1 >= s}
    assert {r.poly_id for r in store.read_window(spark, path, "poly", *window).collect()} == want


def test_a_small_window_reads_few_files_and_the_plan_says_so(spark, written):
    _, path = written
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000000")
    window = store.read_window(spark, path, "poly", *WINDOWS[0])
    plan = window._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [" in plan and "level#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(z" in plan and "LessThanOrEqual(min_lon" in plan
    everything = spark.read.parquet(f"{path}/poly")
    read = {r[0] for r in everything.where(F.col("level") <= store.LEVELS).select(F.col("_metadata.file_path")).distinct().collect()}
    blocks = everything.select("level", "block").distinct().count()
    assert len(read) >= blocks > 100
    kept = sum(1 for r in everything.select("level", "block").distinct().collect() if any(
        a >> max(2 * r.level - store.PART_BITS, 0) <= r.block <= b >> max(2 * r.level - store.PART_BITS, 0) for a, b in store.key_ranges(r.level, *WINDOWS[0])))
    assert kept < blocks / 3


def test_ranges_are_few_cover_the_window_and_hold_little_else():
    for level in (0, 1, 5, 9, 12):
        ranges = store.key_ranges(level, -121.0, 46.5, -119.0, 48.0)
        assert 1 <= len(ranges) <= store.MOST_RANGES and all(a <= b for a, b in ranges)
        assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
        exact = store.key_ranges(level, -121.0, 46.5, -119.0, 48.0, most=10**9)
        assert all(any(a <= c and d <= b for a, b in ranges) for c, d in exact)
    wide = sum(b - a + 1 for a, b in store.key_ranges(9, -121.0, 46.5, -119.0, 48.0))
    assert wide < 4 ** 9 / 8


def test_bounds_and_lengths_reach_their_features_without_the_driver(spark):
    point = "struct(CAST(id AS DOUBLE) AS x, 47D AS y)"
    polygons = spark.range(9).selectExpr("id AS poly_id", f"array(array({point}, struct(id + 1D AS x, 48D AS y), {point})) AS rings")
    lines = spark.range(9).selectExpr("id AS line_id", f"array(array({point}, struct(id + 1D AS x, 48D AS y))) AS parts")
    for df in (store.bounded_polygons(polygons), store.measured_lines(lines)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.min_lon, r.max_lat) for r in df.collect()) == [(float(i), 48.0) for i in range(9)]
