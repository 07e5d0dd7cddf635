"""Cells that many areas share: bounds once per cell of the grid, distances per area only where an answer hangs on them."""
import random

import pytest
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.operators import lines as ln, spatial

KEYS = ["aoi", "col", "row"]


@pytest.fixture(scope="module")
def framed(spark):
    """Four areas that share cells but not their frames."""
    rows = [(a, 1000, c, r) for a, (c0, r0) in enumerate([(400, 400), (402, 401), (403, 380), (401, 402)]) for c in range(c0, c0 + 5) for r in range(r0, r0 + (25 if a == 2 else 5))]
    return spatial.framed_cells(spark.createDataFrame(rows, "aoi int, res int, col int, row int"), ["aoi"])


def degrees(framed):
    box = framed.select(F.min("lon0f"), F.max("lon0f"), F.min("lat0f"), F.max("lat0f")).first()
    return box[0] - 0.05, box[1] + 0.05, box[2] - 0.12, box[3] + 0.12


@pytest.fixture(scope="module")
def points(spark, framed):
    rng, (w, e, s, n) = random.Random(1), degrees(framed)
    spots = [(rng.uniform(w, e), rng.uniform(s, n)) for _ in range(150)]
    rows = [(i, f"n{i}", rng.random() < 0.5, rng.random() < 0.5, rng.choice(["survey", "topo", "unknown"]), *rng.choice(spots)) for i in range(400)]
    return spark.createDataFrame(rows, "site_id int, name string, assays boolean, production boolean, accuracy_class string, lon double, lat double")


def sorted_rows(df, keys=KEYS):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


@pytest.mark.parametrize("radius", [700.0, 5000.0])
def test_facts_are_those_of_all_pairs(spark, framed, points, radius):
    cells, every = framed.select(*KEYS), spatial.cells_near_points(framed, points, radius, 1000)
    bounds = spatial.near_squares(framed, points, radius, 1000)
    few = spatial.first_near(framed, bounds, radius, spatial.record_orders(top=6, nearest=3))
    got = spatial.occurrence_facts(cells, few, KEYS, counts=spatial.counts_near(framed, KEYS, bounds, radius))
    assert sorted_rows(got) == sorted_rows(spatial.occurrence_facts(cells, every, KEYS))
    third = lambda rows: sorted_rows(spatial.nearest_records(rows, KEYS).select(*KEYS, "place", "site_id", "km"), [*KEYS, "place"])
    assert third(few) == third(every)
    if radius > 1000:
        assert few.count() < every.count() / 4


def test_what_is_written_does_not_grow_with_the_areas_of_a_cell(spark, framed, points):
    again = framed.unionByName(framed.withColumn("aoi", F.col("aoi") + 10))
    assert spatial.near_squares(again, points, 5000.0, 1000).count() == spatial.near_squares(framed, points, 5000.0, 1000).count()


@pytest.mark.parametrize("n", [3, 60])
def test_structures_are_those_of_all_pairs(spark, framed, n):
    rng, (w, e, s, t) = random.Random(n), degrees(framed)
    rows = []
    for i in range(n):
        kind = rng.choice(fixed.STRUCTURE_KINDS)
        x, y = rng.uniform(w, e), rng.uniform(s, t)
        reach = 0.0 if kind == "vent" else 0.03
        rows += [(i, kind, f"name{i % 40}" if i % 3 else None, x, y, (x := x + rng.uniform(-reach, reach)), (y := y + rng.uniform(-reach, reach))) for _ in range(2)]
    segments = spark.createDataFrame(rows, "line_id int, kind string, name string, ax double, ay double, bx double, by double").withColumns({"part": F.lit(0), "seq": F.col("ax")})
    lines = ln.trend_and_length(segments, ["line_id", "kind", "name"])
    every = ln.cells_near_segments(framed, segments, 1700.0, 1000, KEYS, ["line_id", "kind", "name"])
    every = ln.with_nearest_beyond(framed, segments, every, 1700.0, 1000, KEYS, ["line_id", "kind", "name"]).join(lines.select("line_id", "azimuth_deg"), "line_id")
    near = ln.lines_near_squares(framed, segments, "line_id", 1700.0, 1000, "kind")
    got = ln.shared_structure_facts(framed, near.drop("kind"), segments, lines, KEYS)
    assert sorted_rows(got) == sorted_rows(ln.structure_facts(framed.select(*KEYS), every, KEYS))


def test_fact_tables_share_cells_and_records(spark, sf, monkeypatch):
    """Cells are framed once for all tables, and workings and novelty are told from the same records."""
    from lodegrid.catalog import facts, load_all
    load_all()
    calls = []
    for name in ("framed_cells", "first_near"):
        taken = getattr(spatial, name)
        monkeypatch.setattr(spatial, name, lambda *a, _name=name, _taken=taken, **k: calls.append(_name) or _taken(*a, **k))
    rows = facts.assembled(spark, sf, ("workings", "novelty"))
    assert sorted(calls) == ["first_near", "framed_cells"]
    told = rows.select((F.col("workings.list")[0]["km"] == F.col("novelty.nearest_occurrence_km")).alias("same"), F.col("workings").isNull().alias("none")).collect()
    assert len(told) > 0 and all(r.same or r.none for r in told) and any(r.same for r in told)
