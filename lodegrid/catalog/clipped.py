"""Cells cut to their polygon, fault crossings, and the geology store."""
from __future__ import annotations

from pyspark.sql import functions as F

from lodegrid.catalog import sqlmath as q
from lodegrid.catalog.geometry import POLY_SIZE, aoi_edges, drawn_once, drawn_polygons, multi_sql, overlay_sql, polygons
from lodegrid.catalog.names import _NL, _SEG, _TRD, _cross, _touch, faults_in_squares, lines, of_all_cells, segments
from lodegrid.catalog.registry import register
from lodegrid.catalog.views import view, with_views
from lodegrid.functions import grid as g
from lodegrid.functions.scalars import round_dp
from lodegrid.operators import clip, lines as ln, overlay, spatial
from lodegrid.session import scratch_path, shuffled
from lodegrid.sinks import store
from lodegrid.sinks.tables import polygon_feature


def _corners_inside(res: int) -> str:
    """Corners of a cell (sx, sy) inside its polygon, by counting edges to the right of each."""
    tests = []
    for dx in (0, res):
        for dy in (0, res):
            cx, cy = f"(sx + {dx})", f"(sy + {dy})"
            tests.append(f"CAST(sum(CASE WHEN (ya > {cy}) <> (yb > {cy}) AND xa + ({cy} - ya) / (yb - ya) * (xb - xa) > {cx} THEN 1 ELSE 0 END) % 2 AS INT)")
    return " + ".join(tests)


def _crossings(res: int) -> str:
    """Points in which an edge meets the border of the cell (sx, sy)."""
    out = []
    for x in ("sx", f"(sx + {res})"):
        y = f"(ya + ({x} - xa) / (xb - xa) * (yb - ya))"
        out.append(f"CASE WHEN (xa < {x}) <> (xb < {x}) AND {y} > sy AND {y} < sy + {res} THEN 1 ELSE 0 END")
    for y in ("sy", f"(sy + {res})"):
        x = f"(xa + ({y} - ya) / (yb - ya) * (xb - xa))"
        out.append(f"CASE WHEN (ya < {y}) <> (yb < {y}) AND {x} > sx AND {x} < sx + {res} THEN 1 ELSE 0 END")
    return " + ".join(out)


_RES = 1000


@register("clipped_cells", f"""{with_views('place_name')}, {overlay_sql(_RES, multi_sql())},
  placed AS (SELECT feature_id, col, row, f, {q.OX} + col * {_RES} AS sx, {q.OY} + row * {_RES} AS sy FROM frac WHERE f > 1e-6),
  v AS (SELECT feature_id, col, row, any_value(f) AS f, sum(CASE WHEN xa > sx AND xa < sx + {_RES} AND ya > sy AND ya < sy + {_RES} THEN 1 ELSE 0 END
    + {_crossings(_RES)}) + {_corners_inside(_RES)} AS n FROM placed JOIN pedge USING (feature_id) GROUP BY feature_id, col, row, sx, sy)
  SELECT feature_id, col, row, CAST(n AS BIGINT) AS vertices, {q.rd(f'f * {_RES * _RES} / 1e6', 3)} AS area_km2 FROM v""")
def clipped_cells(spark, d):
    """Polygons of two parts with holes: corners and area of each cell's share."""
    drawn, members = drawn_once(spark, d)
    edges = overlay.ring_edges(drawn, ["feature_id"], "parts")
    cells = clip.clipped_cells(edges, ["feature_id"], _RES).where("fraction > 1e-6")
    vertices = F.aggregate(F.flatten("shape"), F.lit(0).cast("bigint"), lambda n, ring: n + F.size(ring))
    told = cells.select("feature_id", "col", "row", vertices.alias("vertices"), round_dp(clip.shape_area(F.col("shape")) / 1e6, 3).alias("area_km2"))
    return told.join(shuffled(members), "feature_id").select(F.col("_id").alias("feature_id"), "col", "row", "vertices", "area_km2")


def _convex_sql(res: int) -> str:
    """Share of a cell of a convex area: its corners, the area's corners and the border points, in the order of their angle."""
    inside = " AND ".join(f"(x{(i + 1) % 4} - x{i}) * (py - y{i}) - (y{(i + 1) % 4} - y{i}) * (px - x{i}) > 0" for i in range(4))
    lines = []
    for x in ("sx", f"sx + {res}"):
        lines.append(f"SELECT aoi_id, col, row, {x} AS px, ya + ({x} - xa) / (xb - xa) * (yb - ya) AS py, sx, sy FROM sides WHERE (xa < {x}) <> (xb < {x})")
    for y in ("sy", f"sy + {res}"):
        lines.append(f"SELECT aoi_id, col, row, xa + ({y} - ya) / (yb - ya) * (xb - xa) AS px, {y} AS py, sx, sy FROM sides WHERE (ya < {y}) <> (yb < {y})")
    within = f"px >= sx AND px <= sx + {res} AND py >= sy AND py <= sy + {res}"
    return f"""sq3 AS (SELECT aoi_id, CAST(col AS INT) AS col, CAST(row AS INT) AS row, sx, sy, x0, y0, x1, y1, x2, y2, x3, y3 FROM sq2),
      sides AS (SELECT aoi_id, col, row, sx, sy, s.xa, s.ya, s.xb, s.yb FROM (SELECT *, unnest([{', '.join(
        f"{{xa: x{i}, ya: y{i}, xb: x{(i + 1) % 4}, yb: y{(i + 1) % 4}}}" for i in range(4))}]) AS s FROM sq3)),
      corner AS (SELECT * FROM (SELECT *, sx + unnest([0, {res}, {res}, 0]) AS px, sy + unnest([0, 0, {res}, {res}]) AS py FROM sq3) WHERE {inside}),
      pts AS (SELECT aoi_id, col, row, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py FROM corner
        UNION ALL SELECT aoi_id, col, row, xa, ya FROM sides WHERE xa > sx AND xa < sx + {res} AND ya > sy AND ya < sy + {res}
        UNION ALL SELECT aoi_id, col, row, px, py FROM ({' UNION ALL '.join(lines)}) WHERE {within}),
      low AS (SELECT aoi_id, col, row, min({{px: px, py: py}}) AS o FROM pts GROUP BY 1, 2, 3 HAVING count(*) > 2),
      way AS (SELECT aoi_id, col, row, px, py, CASE WHEN px = o.px AND py = o.py THEN -9e0 ELSE atan2(py - o.py, px - o.px) END AS turn FROM pts JOIN low USING (aoi_id, col, row)),
      deg AS (SELECT *, {q.inverse('px', 'py', 'lon', 'lat')} FROM way),
      ring AS (SELECT aoi_id, col, row, list(printf('[%.6f,%.6f]', lon, lat) ORDER BY turn) AS t FROM deg GROUP BY 1, 2, 3)"""


@register("cells_geojson", f"""{with_views('aoi')}, {q.square_aoi()}, {q.cover_ctes(4000)}, {_convex_sql(4000)}
  SELECT aoi_id, {q.cell_id('4000', 'col', 'row')} AS cell_id, '{{"type":"Feature","id":"' || {q.cell_id('4000', 'col', 'row')} ||
    '","geometry":{{"type":"Polygon","coordinates":[[' || array_to_string(t, ',') || ',' || t[1] || ']]}},"properties":{{"aoi_id":' || aoi_id || ',"resolution_m":4000}}}}' AS feature FROM ring""")
def _(spark, d):
    """Cells of every area as features, cut to the area for display."""
    cells = clip.clipped_cells(aoi_edges(spark, d), ["aoi_id"], 4000).withColumn("geometry", clip.shape_json(F.col("shape")))
    cells = cells.where("geometry IS NOT NULL").withColumn("cell_id", g.cell_id(F.col("res"), F.col("col"), F.col("row")))
    properties = F.struct("aoi_id", F.col("res").alias("resolution_m"))
    return cells.select("aoi_id", "cell_id", polygon_feature(F.col("geometry"), properties, F.col("cell_id")).alias("feature"))


# --- crossings of faults, however many a cell holds -------------------------------------------------
_A, _B, _C, _D = (("p.ax", "p.ay"), ("p.bx", "p.by"), ("s.ax", "s.ay"), ("s.bx", "s.by"))


@register("fault_crossings_all", f"""{_NL}, ins AS (SELECT DISTINCT aoi_id, col, row, line_id FROM nl WHERE kind = 'fault' AND dm = 0),
  pr AS (SELECT a.aoi_id, a.col, a.row, a.line_id AS la, b.line_id AS lb FROM ins a JOIN ins b ON a.aoi_id = b.aoi_id AND a.col = b.col AND a.row = b.row AND a.line_id < b.line_id),
  cr AS (SELECT DISTINCT la, lb FROM (SELECT DISTINCT la, lb FROM pr) JOIN seg p ON p.line_id = la JOIN seg s ON s.line_id = lb WHERE {_touch(_A, _B, _C, _D)})
  SELECT aoi_id, col, row, count(*) AS fault_intersections_in_cell FROM pr JOIN cr USING (la, lb) GROUP BY 1, 2, 3""")
def _(spark, d):
    return of_all_cells(spark, d, ln.fault_crossings_all(faults_in_squares(spark, d), segments(spark, d), spatial.SQUARE))


def _meeting_sql() -> str:
    o3, o4 = _cross(_C, _D, _A), _cross(_C, _D, _B)
    def end(o, p, r, e):
        return (f"CASE WHEN {o} = 0 AND {e[0]} BETWEEN least({p[0]}, {r[0]}) AND greatest({p[0]}, {r[0]}) AND {e[1]} BETWEEN least({p[1]}, {r[1]}) AND greatest({p[1]}, {r[1]}) "
                f"THEN {{x: {e[0]}, y: {e[1]}}} END")
    ends = ", ".join((end(_cross(_A, _B, _C), _A, _B, _C), end(_cross(_A, _B, _D), _A, _B, _D), end(o3, _C, _D, _A), end(o4, _C, _D, _B)))
    return f"coalesce(list_min([{ends}]), {{x: p.ax + {o3} / ({o3} - {o4}) * (p.bx - p.ax), y: p.ay + {o3} / ({o3} - {o4}) * (p.by - p.ay)}})"


@register("fault_crossing_points", f"""{with_views('occurrence')}, {_SEG}, met AS (SELECT p.line_id, s.line_id AS other_id, {_meeting_sql()} AS m
  FROM seg p JOIN seg s ON p.line_id < s.line_id AND p.kind = 'fault' AND s.kind = 'fault' WHERE {_touch(_A, _B, _C, _D)})
  SELECT DISTINCT line_id, other_id, {q.rd('m.x', 6)} AS lon, {q.rd('m.y', 6)} AS lat FROM met""")
def _(spark, d):
    points = ln.crossing_points(segments(spark, d).where("kind = 'fault'"), places=6)
    return points.withColumnsRenamed({"x": "lon", "y": "lat"})


# --- geology store ------------------------------------------------------------------------------
_WINDOW = (-121.5, 46.6, -119.9, 47.9)
_MEETS = "min_lon <= {2} AND max_lon >= {0} AND min_lat <= {3} AND max_lat >= {1}".format(*_WINDOW)


@register("store_window_read", f"""{with_views('place_name', 'occurrence')}, {_SEG}, {_TRD},
  u AS (SELECT feature_class AS unit, arg_max(name, length(name) * 1000000000 - feature_id) AS description FROM place_name GROUP BY 1),
  p AS (SELECT feature_id AS id, feature_class AS label, lon - {POLY_SIZE} AS min_lon, lat - {POLY_SIZE} AS min_lat, lon + {POLY_SIZE} AS max_lon, lat + 1e0 * {POLY_SIZE} AS max_lat FROM place_name),
  b AS (SELECT line_id AS id, kind AS label, min(least(ax, bx)) AS min_lon, min(least(ay, seg.by)) AS min_lat, max(greatest(ax, bx)) AS max_lon, max(greatest(ay, seg.by)) AS max_lat FROM seg GROUP BY 1, 2)
  SELECT 'poly' AS layer, id, label, {q.rd('min_lon', 6)} AS min_lon, {q.rd('max_lat', 6)} AS max_lat, description, CAST(NULL AS DOUBLE) AS length_m FROM p JOIN u ON unit = label WHERE {_MEETS}
  UNION ALL SELECT 'line', id, label, {q.rd('min_lon', 6)}, {q.rd('max_lat', 6)}, NULL, {q.rd('length_m', 3)} FROM b JOIN tr2 ON line_id = id WHERE {_MEETS}""")
def _(spark, d):
    """Units, polygons and lines written as a store and read back for a window."""
    path = scratch_path(spark, "geology-store")
    geology = polygons(spark, d).select(F.col("feature_id").alias("poly_id"), "unit", "rings")
    described = view(spark, d, "place_name").select(
        F.col("feature_class").alias("unit"), F.col("feature_class").alias("name"), F.lit(None).cast("string").alias("lithology"), F.col("name").alias("description"), F.col("feature_id").alias("ord"))
    store.write_store(path, described, geology, lines(spark, d))
    six = lambda c: round_dp(F.col(c), 6).alias(c)
    poly = store.with_unit(store.read_window(spark, path, "poly", *_WINDOW), spark, path).select(
        F.lit("poly").alias("layer"), F.col("poly_id").alias("id"), F.col("unit").alias("label"), six("min_lon"), six("max_lat"), "description", F.lit(None).cast("double").alias("length_m"))
    traces = store.read_window(spark, path, "line", *_WINDOW).select(
        F.lit("line").alias("layer"), F.col("line_id").alias("id"), F.col("kind").alias("label"), six("min_lon"), six("max_lat"), F.lit(None).cast("string").alias("description"), round_dp(F.col("length_m"), 3).alias("length_m"))
    return poly.unionByName(traces)
