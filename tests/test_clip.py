"""Cells cut to polygons, by hand-computed cases in grid metres."""
import math
import random

import pytest
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.operators import clip, overlay

OX, OY = fixed.GRID_ORIGIN_X, fixed.GRID_ORIGIN_Y


def edges(spark, parts):
    """``parts``: lists of rings in metres from the grid's origin, not closed."""
    ring = lambda r: [(OX + float(x), OY + float(y)) for x, y in [*r, r[0]]]
    rows = [(1, [[ring(r) for r in part] for part in parts])]
    df = spark.createDataFrame(rows, "id int, parts array<array<array<struct<x:double,y:double>>>>")
    return overlay.ring_edges(df, ["id"], "parts", degrees=False)


def cells(spark, parts, res=1000):
    out = {}
    for r in clip.clipped_cells(edges(spark, parts), ["id"], res).withColumn("area", clip.shape_area(F.col("shape"))).collect():
        out[r["col"], r["row"]] = ([[[(round(p.x - OX, 6), round(p.y - OY, 6)) for p in ring] for ring in polygon] for polygon in r["shape"]], r["area"])
    return out


def test_square_on_grid_lines_is_its_cells(spark):
    got = {k: v for k, v in cells(spark, [[[(0, 0), (2000, 0), (2000, 1000), (0, 1000)]]]).items() if v[0]}
    assert got == {(0, 0): ([[[(0, 0), (1000, 0), (1000, 1000), (0, 1000)]]], 1e6), (1, 0): ([[[(1000, 0), (2000, 0), (2000, 1000), (1000, 1000)]]], 1e6)}


def test_corner_hole_and_island_inside_one_cell(spark):
    """A clockwise outer ring, a hole within one cell, and a second part inside the hole."""
    outer = [(-500, -500), (-500, 2500), (2500, 2500), (2500, -500)]
    hole, island = [(200, 200), (800, 200), (800, 800), (200, 800)], [(400, 400), (600, 400), (600, 600), (400, 600)]
    got = cells(spark, [[outer, hole], [island]])
    assert got[0, 0][1] == 1e6 - 360000 + 40000 and len(got[0, 0][0]) == 2
    shapes = sorted(got[0, 0][0], key=len)
    assert shapes[0] == [island] and shapes[1][0] == [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]
    assert sorted(shapes[1][1]) == sorted(hole)
    assert got[1, 1][0] == [[[(1000, 1000), (2000, 1000), (2000, 2000), (1000, 2000)]]]
    assert got[-1, -1][0] == [[[(-500, -500), (0, -500), (0, 0), (-500, 0)]]]
    assert sum(a for _, a in got.values()) == 9e6 - 360000 + 40000


def test_a_polygon_that_comes_back_into_a_cell_gives_two_shapes(spark):
    comb = [(100, -500), (900, -500), (900, 500), (600, 500), (600, -200), (400, -200), (400, 500), (100, 500)]
    got = cells(spark, [[comb]])
    assert sorted(got[0, 0][0]) == [[[(100, 0), (400, 0), (400, 500), (100, 500)]], [[(600, 0), (900, 0), (900, 500), (600, 500)]]]
    assert len(got[0, -1][0]) == 1 and got[0, -1][1] == 800 * 500 - 200 * 200


def test_hole_across_a_border_is_part_of_the_ring(spark):
    outer, hole = [(-3000, -3000), (3000, -3000), (3000, 3000), (-3000, 3000)], [(-100, 300), (100, 300), (100, 700), (-100, 700)]
    got = cells(spark, [[outer, hole]])
    assert got[0, 0][0] == [[[(0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 700), (100, 700), (100, 300), (0, 300)]]]


@pytest.mark.parametrize("seed", range(4))
def test_shares_of_a_star_sum_to_it(spark, seed):
    rng = random.Random(seed)
    star = [(math.cos(i / 40 * math.tau) * rng.uniform(300, 5200), math.sin(i / 40 * math.tau) * rng.uniform(300, 5200)) for i in range(40)]
    star = sorted(star, key=lambda p: math.atan2(p[1], p[0]))
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(star, star[1:] + star[:1]))) / 2
    frame = clip.clipped_cells(edges(spark, [[star]]), ["id"], 500).withColumn("area", clip.shape_area(F.col("shape")))
    rows = frame.collect()
    assert sum(r.area for r in rows) == pytest.approx(area, rel=1e-9)
    assert all(r.area == pytest.approx(r.fraction * 250000, abs=0.01) for r in rows)


def test_text_of_a_shape(spark):
    row = clip.clipped_cells(edges(spark, [[[(100, 100), (900, 100), (900, 900)]]]), ["id"], 1000).select(clip.shape_json(F.col("shape")).alias("t")).first()
    assert row.t.startswith('{"type":"Polygon","coordinates":[[[') and row.t.count("[-1") == 4
