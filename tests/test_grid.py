import math

import pytest
from pyspark.sql import functions as F

from lodegrid.catalog import load_all
from lodegrid.catalog.registry import QUERIES
from lodegrid.functions import geo, grid as g
from lodegrid.operators import lines as ln, overlay
from lodegrid.sources import geojson

POINTS = [(-121.44, 48.03), (-118.74, 48.65), (-124.7, 48.38), (-117.05, 46.0), (-122.33, 47.61), (-120.5, 45.6), (-119.0, 49.0), (-123.0, 46.1), (-118.0, 47.5)]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(POINTS, "lon double, lat double")


def test_known_cell_id(spark, points):
    c = g.locate(F.col("lon"), F.col("lat"), F.lit(1000))
    row = points.limit(1).select(c.alias("c")).select(g.cell_id(F.col("c.res"), F.col("c.col"), F.col("c.row")).alias("id")).first()
    assert row.id == "wa5070-1000m-000349-000380"


def test_round_trip_is_exact_to_a_tenth_of_a_millimetre(points):
    x, y = g.to_grid_metres(F.col("lon"), F.col("lat"))
    lon, lat = g.to_degrees(x, y)
    gap = F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat")))
    assert points.agg(F.max(gap)).first()[0] < 1e-9


def test_snap_and_coarsen(spark):
    df = spark.createDataFrame([(800.0,), (125.0,), (10.0,), (99999.0,), (250.0,)], "r double")
    out = df.select(g.snap_resolution(F.col("r")).alias("s")).select("s", g.coarser(F.col("s")).alias("c")).collect()
    assert [(r.s, r.c) for r in out] == [(1000, 2000), (125, 250), (125, 250), (8000, 8000), (250, 500)]


def test_malformed_ids_are_null(spark):
    df = spark.createDataFrame([("wa5070-250m-000001-000002",), ("x",), (None,), ("wa5070-250m-1-2",)], "id string")
    got = [r.p for r in df.select(g.parse_cell_id(F.col("id")).alias("p")).collect()]
    assert got[0].asDict() == {"res": 250, "col": 1, "row": 2} and got[1:] == [None, None, None]


def test_ids_of_keys_with_seven_digits_follow_the_statement(spark, tmp_path):
    import duckdb

    from lodegrid.catalog import load_all
    from lodegrid.catalog.registry import ORACLES, QUERIES
    load_all()
    rows = [(1234567, 42, "1-URGENT"), (1234565, 7, "5-LOW"), (12, 7654321, "2-HIGH")]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["grid_parse_ids"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(ORACLES["grid_parse_ids"]).fetchall())


def test_inverted_parent_fails(spark):
    with pytest.raises(Exception, match="coarser rung"):
        spark.range(1).select(g.parent_index(F.lit(5), F.lit(1000), F.lit(250))).collect()


def ring(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts + pts[:1]])


X0, Y0 = -2_240_000 + 350_000, 2_656_000 + 380_000


def test_overlay_of_square_with_hole(spark):
    outer = ring((X0 + 300, Y0 + 200), (X0 + 3700, Y0 + 200), (X0 + 3700, Y0 + 2900), (X0 + 300, Y0 + 2900))
    hole = ring((X0 + 1000, Y0 + 1000), (X0 + 2000, Y0 + 1000), (X0 + 2000, Y0 + 2000), (X0 + 1000, Y0 + 2000))
    df = spark.range(1).select("id", F.array(outer, hole).alias("rings"))
    cells = overlay.polygon_cells(overlay.ring_edges(df, ["id"], degrees=False), ["id"], 1000)
    got = {(r.col - 350, r.row - 380): r.fraction for r in cells.collect()}
    assert got.get((1, 1), 0.0) == 0.0
    assert got[(0, 0)] == pytest.approx(0.7 * 0.8) and got[(2, 1)] == pytest.approx(1.0) and got[(3, 2)] == pytest.approx(0.7 * 0.9)
    assert sum(got.values()) * 1e6 == pytest.approx(3400 * 2700 - 1e6)


def test_winding_does_not_matter_and_tiling_sums_to_one(spark):
    cut = 437.0
    left = ring((X0, Y0), (X0, Y0 + 2000), (X0 + cut, Y0 + 2000), (X0 + cut, Y0))  # clockwise
    right = ring((X0 + cut, Y0), (X0 + 2000, Y0), (X0 + 2000, Y0 + 2000), (X0 + cut, Y0 + 2000))
    df = spark.range(2).select("id", F.when(F.col("id") == 0, F.array(left)).otherwise(F.array(right)).alias("rings"))
    cells = overlay.polygon_cells(overlay.ring_edges(df, ["id"], degrees=False), ["id"], 500)
    inside = cells.where((F.col("col") >= 700) & (F.col("col") < 704) & (F.col("row") >= 760) & (F.col("row") < 764))
    total = inside.groupBy("col", "row").agg(F.sum("fraction").alias("f"))
    assert total.count() == 16 and total.agg(F.min("f")).first()[0] == pytest.approx(1.0)


def test_envelope_fails_loudly(spark):
    df = spark.createDataFrame([(-130.0, 47.0, -129.0, 48.0)], "min_lon double, min_lat double, max_lon double, max_lat double")
    with pytest.raises(Exception, match="envelope"):
        overlay.in_range(df).collect()


def test_azimuth_fold_and_band(spark):
    from lodegrid.functions.scalars import favourable_trend
    az = [0.0, 30.0, 30.1, 165.0, 164.9, 179.9, 90.0, 350.0, None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(az)], "i int, a double").orderBy("i")
    assert [r[0] for r in df.select(favourable_trend(F.col("a"))).collect()] == [True, True, False, True, False, True, False, True, False]


def test_closed_trace_has_no_trend(spark):
    pts = [(-120.0, 48.0), (-120.0, 48.1), (-119.9, 48.1), (-120.0, 48.0)]
    v = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pts])
    seg = ln.line_segments(spark.range(1).select(F.col("id").alias("line_id"), F.array(v).alias("parts")), ["line_id"])
    row = ln.trend_and_length(seg, ["line_id"]).first()
    assert row.azimuth_deg is None and row.length_m > 20_000


def test_utm(spark):
    u = spark.range(1).select(geo.to_utm(F.lit(-121.44), F.lit(48.03)).alias("u")).first().u
    assert (u.zone, u.band) == (10, "U") and abs(u.easting - 616_322) < 50 and abs(u.northing - 5_320_900) < 500


def test_utm_inverse_round_trip(spark):
    u = spark.range(1).select(geo.to_utm(F.lit(-118.2), F.lit(48.4)).alias("u")).first().u
    lon, lat = geo.utm_inverse(F.lit(float(u.easting)), F.lit(float(u.northing)), 11, 6378137.0, 0.00669437999014)
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(row.lon + 118.2) < 1e-5 and abs(row.lat - 48.4) < 1e-5


def test_old_datum_shift_is_some_tens_of_metres(spark):
    lon, lat = geo.nad27_utm_to_wgs84(F.lit(400000.0), F.lit(5350000.0))
    plain = geo.utm_inverse(F.lit(400000.0), F.lit(5350000.0), 11, 6378206.4, 0.006768657997)
    row = spark.range(1).select(geo.km_between(lon, lat, *plain).alias("km")).first()
    assert 0.03 < row.km < 0.2


def test_state_plane_origin(spark):
    lon, lat = geo.washington_south_to_wgs84(F.lit(500000.0 * 3937 / 1200), F.lit(0.0))
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert row.lon == pytest.approx(-120.5, abs=1e-9) and row.lat == pytest.approx(45 + 20 / 60, abs=1e-7)


def test_simplify_keeps_shape(spark):
    n = 400
    pts = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)] + [(1.0, 0.0)]
    slim = overlay.simplify_ring(pts, 0.01)
    assert 10 < len(slim) < 60 and slim[0] == slim[-1]


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_parts_of_a_polygon_add_up_and_only_holes_are_taken_out(spark):
    parts = [[square(0.0, 0.0, 1000.0)], [square(5000.0, 0.0, 1000.0)[::-1], square(5250.0, 250.0, 500.0)]]
    df = spark.createDataFrame([("p", parts)], "id string, parts array<array<array<struct<x:double,y:double>>>>")
    edges = overlay.ring_edges(df, ["id"], "parts", degrees=False)
    assert overlay.polygon_area_km2(edges, ["id"]).first().area_km2 == 1.75
    cells = overlay.polygon_cells(edges, ["id"], 1000)
    assert abs(cells.agg(F.sum("fraction")).first()[0] - 1.75) < 1e-9
    x = overlay.polygon_centroid(edges, ["id"]).first().x
    assert abs(x - (500.0 + 0.75 * 5500.0) / 1.75) < 1e-6


def test_areas_drawn_as_geojson_become_parts(spark):
    body = '{"type":"FeatureCollection","features":[' + ",".join([
        '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2]],[[0.5,0.5],[1,0.5],[1,1],[0.5,1],[0.5,0.5]]]},"properties":{"n":1}}',
        '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[3,3],[4,3],[4,4],[3,3]]]]},"properties":{"n":2}}',
        '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1,9]]},"properties":{"n":3}}',
        '{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]},"properties":{"n":4}}',
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,1]},"properties":{"n":5}}']) + "]}"
    features = geojson.features_from_text(spark.createDataFrame([(body,)], "body string"), "body", "struct<n:int>")
    polygons = {r.n: r.parts for r in geojson.polygon_rows(features).collect()}
    assert {n: [[len(ring) for ring in part] for part in parts] for n, parts in polygons.items()} == {1: [[5, 5]], 2: [[4], [4]]}
    lines = {r.n: r.parts for r in geojson.line_rows(features).collect()}
    assert {n: [len(p) for p in parts] for n, parts in lines.items()} == {3: [2], 4: [2, 2]}


def test_a_vertex_outside_the_envelope_stops_the_job(spark):
    df = spark.createDataFrame([("p", [square(-200.0, 48.0, 1.0)])], "id string, rings array<array<struct<x:double,y:double>>>")
    with pytest.raises(Exception, match="envelope"):
        overlay.rings_in_range(df).collect()


def test_simplified_polygons_lose_vertices_and_area(spark, sf):
    load_all()
    rows = QUERIES["polygons_simplified"](spark, sf).collect()
    assert len(rows) == 200 and all(r.vertices_before == 20 and r.vertices_after == (15 if r.feature_id % 9 == 0 else 11) for r in rows)
    assert sum(r.before != r.after for r in rows) > 150
