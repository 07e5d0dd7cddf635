"""Cells cut to the polygon that they lie in, as rings.

Every oriented edge is cut at the grid lines it crosses, so each piece lies in one cell, with the polygon's inside on its
left. Pieces that follow each other in a cell are a path; a path that leaves the cell goes on along the cell's border,
counter-clockwise, to the next place where a path comes in, taking the corners on its way. What closes is a ring:
counter-clockwise ones bound the cell's share, clockwise ones are holes in it. A cell that no edge cuts is its square.

Work is per polygon and cell, all in expressions; a polygon of any size is spread over its cells, and what is
collected is one cell's part of one polygon, which is one geometry.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions import grid as g
from lodegrid.operators.overlay import polygon_cells
from lodegrid.session import shuffled

#: Metres by which a piece on a grid line is moved to its inside to find its cell.
_NUDGE = 1e-6
_POINT = "struct<x:double,y:double>"


def _between(a: Column, b: Column, origin: float, res: float) -> Column:
    """Grid lines strictly between two coordinates."""
    low, high = F.least(a, b), F.greatest(a, b)
    first, last = F.floor((low - origin) / res) + 1, F.ceil((high - origin) / res) - 1
    lines = F.transform(F.sequence(first, last), lambda i: (F.lit(origin) + i * res).cast("double"))
    return F.when(first <= last, lines).otherwise(F.array().cast("array<double>"))


def pieces(edges: DataFrame, keys: list[str], res: int) -> DataFrame:
    """Edges cut at grid lines, turned so that the inside is on the left, each with its cell.

    ``_place`` is (part, ring, edge, piece) in the direction of travel.
    """
    turned = F.col("orient") > 0
    ends = {n: F.when(turned, F.col(b)).otherwise(F.col(a)) for n, a, b in (
        ("_x0", "xa", "xb"), ("_y0", "ya", "yb"), ("_x1", "xb", "xa"), ("_y1", "yb", "ya"))}
    e = edges.withColumns(ends).where("_x0 <> _x1 OR _y0 <> _y1")
    x0, y0, x1, y1 = (F.col(c) for c in ("_x0", "_y0", "_x1", "_y1"))
    at = lambda t, x, y: F.struct(t.cast("double").alias("t"), x.alias("x"), y.alias("y"))
    upright = F.transform(_between(x0, x1, fixed.GRID_ORIGIN_X, res), lambda x: at((x - x0) / (x1 - x0), x, y0 + (x - x0) / (x1 - x0) * (y1 - y0)))
    level = F.transform(_between(y0, y1, fixed.GRID_ORIGIN_Y, res), lambda y: at((y - y0) / (y1 - y0), x0 + (y - y0) / (y1 - y0) * (x1 - x0), y))
    cuts = F.array_sort(F.concat(F.array(at(F.lit(0.0), x0, y0), at(F.lit(1.0), x1, y1)), upright, level))
    e = e.select(*keys, "part", "ring", (-F.col("edge") * F.col("orient")).cast("int").alias("_edge"), cuts.alias("_cuts"))
    spans = F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda i: F.struct(F.element_at("_cuts", i).alias("a"), F.element_at("_cuts", i + 1).alias("b")))
    p = e.select(*keys, "part", "ring", "_edge", F.posexplode(spans).alias("_sub", "_s")).where("_s.a.x <> _s.b.x OR _s.a.y <> _s.b.y")
    ax, ay, bx, by = (F.col(f"_s.{n}.{c}") for n in ("a", "b") for c in ("x", "y"))
    length = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    mx, my = (ax + bx) / 2 - _NUDGE * (by - ay) / length, (ay + by) / 2 + _NUDGE * (bx - ax) / length
    return p.select(*keys, g.col_index(mx, F.lit(res)).alias("col"), g.row_index(my, F.lit(res)).alias("row"), F.struct(
        "part", "ring", "_edge", "_sub", ax.alias("x0"), ay.alias("y0"), bx.alias("x1"), by.alias("y1")).alias("_place"))


def _along(x: Column, y: Column, left: Column, low: Column, res: float) -> Column:
    """Place on a cell's border, counter-clockwise from its lower left corner in sides (0 to 4); null inside the cell."""
    near = lambda a, b: F.abs(a - b) <= 2 * _NUDGE
    right, top = left + res, low + res
    return (F.when(near(y, low), (x - left) / res).when(near(x, right), 1 + (y - low) / res)
            .when(near(y, top), 2 + (right - x) / res).when(near(x, left), 3 + (top - y) / res))


def _area(ring: Column) -> Column:
    """Signed area of a ring without its closing point, counter-clockwise positive, taken from its first point."""
    o = ring[0]
    steps = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: (
        (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / 2


def _from_lowest(ring: Column) -> Column:
    """The same ring, from its smallest point on."""
    k = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, k, F.size(ring)), F.slice(ring, F.lit(1), k - 1))


def _holds(ring: Column, p: Column) -> Column:
    """Whether a ring winds round a point: edges to the right of it, odd in number."""
    crossed = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.when(
        ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (a["x"] + (p["y"] - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]) > p["x"]), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def clipped_cells(edges: DataFrame, keys: list[str], res: int) -> DataFrame:
    """keys, res, col, row, fraction and ``shape``: array of polygons, each its outer ring and its holes.

    Rings are arrays of struct(x, y) in grid metres without a closing point, from their smallest point on. ``shape`` is empty
    for a cell that the polygon only touches.
    """
    r = float(res)
    of = [*keys, "col", "row"]
    left, low = (fixed.GRID_ORIGIN_X + F.col("col") * r), (fixed.GRID_ORIGIN_Y + F.col("row") * r)
    cut = pieces(edges, keys, res).groupBy(*of).agg(F.array_sort(F.collect_list("_place")).alias("_p"))
    cut = cut.withColumns({"_left": left, "_low": low})
    item = lambda a, i: F.element_at(a, i)

    def begins(i: Column) -> Column:
        here, before = item("_p", i), F.try_element_at("_p", F.greatest(i - 1, F.lit(1)))
        return (i == 1) | ~((here["part"] == before["part"]) & (here["ring"] == before["ring"]) & (here["x0"] == before["x1"]) & (here["y0"] == before["y1"]))

    cut = cut.withColumn("_b", F.filter(F.sequence(F.lit(1), F.size("_p")), begins))
    stretch = lambda b, k: F.slice("_p", b, F.coalesce(F.try_element_at("_b", k + 2), F.size("_p") + 1) - b)
    cut = cut.withColumn("_runs", F.transform("_b", stretch))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def path(run: Column) -> Column:
        first, last = run[0], item(run, -1)
        return F.struct(
            first["part"].alias("part"), first["ring"].alias("ring"), point(first["x0"], first["y0"]).alias("start"), point(last["x1"], last["y1"]).alias("end"),
            F.transform(run, lambda s: point(s["x0"], s["y0"])).alias("points"),
            _along(first["x0"], first["y0"], F.col("_left"), F.col("_low"), r).alias("comes"),
            _along(last["x1"], last["y1"], F.col("_left"), F.col("_low"), r).alias("goes"))

    cut = cut.withColumn("_paths", F.transform("_runs", path)).drop("_p", "_b", "_runs")

    def follower(p: Column) -> Column:
        """Number of the path that goes on where ``p`` ends, and the way between them along the border."""
        joined = F.array_position(F.transform("_paths", lambda q: (q["part"] == p["part"]) & (q["ring"] == p["ring"]) & (q["start"] == p["end"])), True)
        gaps = F.transform("_paths", lambda q, j: F.struct(F.pmod(F.round(q["comes"] - p["goes"], 9), F.lit(4.0)).alias("gap"), (j + 1).alias("to")))
        nearest = F.array_min(F.filter(gaps, lambda s: s["gap"].isNotNull()))
        return F.when(joined > 0, F.struct(joined.cast("int").alias("to"), F.lit(0.0).alias("gap"))).otherwise(
            F.struct(nearest["to"].alias("to"), nearest["gap"].alias("gap")))

    cut = cut.withColumn("_next", F.transform("_paths", follower))
    count = F.size("_paths")

    def walk(i: Column) -> Column:
        def step(done: Column, _: Column) -> Column:
            to = item("_next", item(done, -1))["to"]
            return F.when(to.isNull() | (to == i), done).otherwise(F.concat(done, F.array(to)))
        return F.aggregate(F.sequence(F.lit(1), count), F.array(i), step)

    walks = F.transform(F.sequence(F.lit(1), count), walk)
    cut = cut.withColumn("_walks", walks).withColumn("_walks", F.filter("_walks", lambda w: (F.array_min(w) == w[0]) & (item("_next", item(w, -1))["to"] == w[0])))
    corner = lambda c: point(F.col("_left") + F.when(c % 4 == 1, r).when(c % 4 == 2, r).otherwise(0.0), F.col("_low") + F.when(c % 4 == 2, r).when(c % 4 == 3, r).otherwise(0.0))

    def drawn(j: Column) -> Column:
        p, gap = item("_paths", j), item("_next", j)["gap"]
        passed = F.filter(F.array(*[F.lit(c) for c in range(1, 8)]), lambda c: (c > p["goes"] + 1e-9) & (c < p["goes"] + gap - 1e-9))
        onwards = F.when(p["goes"].isNotNull() & (gap > 0), F.concat(F.array(p["end"]), F.transform(passed, corner)))
        return F.concat(p["points"], F.coalesce(onwards, F.when(gap > 0, F.array(p["end"])), F.array().cast(f"array<{_POINT}>")))

    rings = F.transform("_walks", lambda w: F.flatten(F.transform(w, drawn)))
    cut = cut.withColumn("_rings", F.filter(rings, lambda ring: F.size(ring) > 2))
    sized = F.transform("_rings", lambda ring: F.struct(_from_lowest(ring).alias("ring"), _area(ring).alias("area")))
    bordered = F.exists("_paths", lambda p: p["comes"].isNotNull())
    cut = cut.select(*of, sized.alias("_sized"), bordered.alias("_bordered"))

    cells = polygon_cells(edges, keys, res).join(shuffled(cut), of, "left")
    known = F.coalesce("_sized", F.array().cast(f"array<struct<ring:array<{_POINT}>,area:double>>"))
    whole = F.col("fraction") * r * r - F.aggregate(known, F.lit(0.0), lambda s, v: s + v["area"]) > r * r / 2
    square = F.array(*[point(left + dx, low + dy) for dx, dy in ((0.0, 0.0), (r, 0.0), (r, r), (0.0, r))])
    # With rings inside only, or none at all, the area tells whether they are cut out of the whole square.
    known = F.when(whole & ~F.coalesce("_bordered", F.lit(False)), F.concat(F.array(F.struct(square.alias("ring"), F.lit(r * r).alias("area"))), known)).otherwise(known)
    cells = cells.withColumn("_known", known)
    outer = F.filter("_known", lambda s: s["area"] > _NUDGE)
    holes = F.filter("_known", lambda s: s["area"] < -_NUDGE)
    polygons = F.transform(outer, lambda o: F.concat(F.array(o["ring"]), F.transform(
        F.filter(holes, lambda h: (F.size(outer) == 1) | _holds(o["ring"], h["ring"][0])), lambda h: h["ring"])))
    return cells.select(*keys, "res", "col", "row", "fraction", polygons.alias("shape"))


def shape_area(shape: Column) -> Column:
    """Square metres of polygons as ``clipped_cells`` gives them."""
    return F.aggregate(F.flatten(shape), F.lit(0.0), lambda s, ring: s + _area(ring))


def shape_json(shape: Column) -> Column:
    """GeoJSON geometry in degrees, six decimals; null for an empty shape."""
    def text(p: Column) -> Column:
        lon, lat = g.to_degrees(p["x"], p["y"])
        return F.format_string("[%.6f,%.6f]", lon, lat)

    ring = lambda pts: F.concat(F.lit("["), F.array_join(F.transform(F.concat(pts, F.slice(pts, 1, 1)), text), ","), F.lit("]"))
    polygon = lambda rings: F.concat(F.lit("["), F.array_join(F.transform(rings, ring), ","), F.lit("]"))
    parts = F.array_join(F.transform(shape, polygon), ",")
    return (F.when(F.size(shape) == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), parts, F.lit("}")))
            .when(F.size(shape) > 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), parts, F.lit("]}"))))
