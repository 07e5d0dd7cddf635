"""Polygons on the grid: which cells a polygon covers, and how much of each.

Works on an edge table in equal-area metres, one row per oriented edge, so a polygon of any size is
spread over tasks. The area of a polygon inside a cell is the sum over its edges of the integral of the
clamped height; what lies wholly below an edge is carried down its column with a running sum.
"""
from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions import grid as g
from lodegrid.functions.scalars import round_dp, to_fixed
from lodegrid.operators.ranking import best_per_key
from lodegrid.session import dealt, shuffled, spread_join

_AREA_DIGITS = 6  # square metres
_WIDTH_DIGITS = 9  # metres


def ring_edges(polygons: DataFrame, keys: list[str], rings: str = "rings", degrees: bool = True) -> DataFrame:
    """Edges of polygons, each oriented so that outer rings add area and holes take it away.

    ``rings`` is an array of closed rings of struct(x, y), the first one outer and the others its holes, or an array of
    such arrays, one per part of a multipart polygon. Orientation is set from each ring's own signed area, so winding
    in the source does not matter.
    """
    depth = polygons.schema[rings].dataType.simpleString().count("array<")
    listed = polygons if depth == 3 else polygons.withColumn(rings, F.array(rings))
    parts = listed.select(*keys, F.posexplode(rings).alias("part", "_rings")).select(*keys, "part", F.posexplode("_rings").alias("ring", "_pts"))

    def metres(p: Column) -> Column:
        x, y = g.to_grid_metres(p["x"], p["y"]) if degrees else (p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    # The sign is taken where the ring is whole, so edges need not meet it in a join.
    placed = parts.where(F.size("_pts") > 3).select(*keys, "part", "ring", F.transform("_pts", metres).alias("_pts"))
    turns = F.zip_with("_pts", F.slice("_pts", 2, F.size("_pts")), lambda a, b: F.coalesce((a["x"] - b["x"]) * (a["y"] + b["y"]), F.lit(0.0)))
    sign = F.signum(F.aggregate(turns, F.lit(0.0), lambda s, v: s + v))
    signed = placed.withColumn("orient", F.when(F.col("ring") == 0, -sign).otherwise(sign))
    steps = F.sequence(F.lit(1), F.size("_pts") - 1)
    edges = signed.select(
        *keys, "part", "ring", "orient", F.posexplode_outer(F.transform(steps, lambda i: F.struct(
            F.element_at("_pts", i).alias("a"), F.element_at("_pts", i + 1).alias("b")))).alias("edge", "_e"),
    )
    ends = [F.col(f"_e.{p}.{c}").alias(f"{c}{p}") for p in ("a", "b") for c in ("x", "y")]
    return edges.select(*keys, "part", "ring", "edge", *ends, "orient")


def in_range(areas: DataFrame) -> DataFrame:
    """Areas with degree bounds, unchanged; one outside the envelope stops the job instead of giving meaningless cells."""
    w, s, e, n = fixed.ENVELOPE
    ok = (F.col("min_lon") >= w) & (F.col("max_lon") <= e) & (F.col("min_lat") >= s) & (F.col("max_lat") <= n)
    text = F.concat_ws(", ", *[F.format_string("%.4f", F.col(c)) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    stop = F.raise_error(F.concat(F.lit("area bounds outside the grid envelope: "), text)).cast("double")
    return areas.withColumn("min_lon", F.when(ok, F.col("min_lon")).otherwise(stop))


def rings_in_range(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons in degrees, unchanged; a vertex outside the envelope stops the job, as ``in_range`` does for bounds."""
    points = F.flatten(rings)
    if polygons.schema[rings].dataType.simpleString().count("array<") == 3:
        points = F.flatten(points)
    w, s, e, n = fixed.ENVELOPE
    out = F.exists(points, lambda v: ~(v["x"].between(w, e) & v["y"].between(s, n)))
    stop = F.raise_error(F.lit("area vertex outside the grid envelope")).cast(polygons.schema[rings].dataType)
    return polygons.withColumn(rings, F.when(F.coalesce(out, F.lit(False)), stop).otherwise(F.col(rings)))


def simplify_ring(points: list, tolerance: float) -> list:
    """Vertices of a ring kept by the farthest-point rule; ``points`` are (x, y), first equals last."""
    p = np.asarray(points, dtype=float)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = p[i], p[j] - p[i]
        span = float(d @ d)
        q = p[i + 1:j] - a
        t = np.clip(q @ d / span, 0, 1) if span else np.zeros(len(q))
        away = np.hypot(*(q - t[:, None] * d).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[keep].tolist()


def simplify_rings(polygons: DataFrame, rings: str, tolerance: float) -> DataFrame:
    """Simplified rings, the original ring wherever simplification leaves no area. Arrow batches, no shuffle."""
    kind = polygons.schema[rings].dataType.simpleString()

    def one(ring: list[dict]) -> list[dict]:
        pts = [(v["x"], v["y"]) for v in ring]
        slim = simplify_ring(pts, tolerance) if len(pts) > 4 else pts
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(slim, slim[1:]))
        return [{"x": x, "y": y} for x, y in (slim if len(slim) >= 4 and twice != 0 else pts)]

    # Nested ragged arrays travel as JSON text, which Arrow carries as one plain column.
    @F.pandas_udf("string")
    def simplify(column: pd.Series) -> pd.Series:
        return column.map(lambda text: json.dumps([one(r) for r in json.loads(text)]))

    return polygons.withColumn(rings, F.from_json(simplify(F.to_json(rings)), kind))


def rounded_rings(rings: Column, places: int) -> Column:
    """Rings with rounded coordinates; of vertices that fall on the one before them only that one is kept."""
    point = lambda p: F.struct(round_dp(p["x"], places).alias("x"), round_dp(p["y"], places).alias("y"))
    whole = lambda ring: F.transform(ring, point)
    apart = lambda ring: F.filter(ring, lambda p, i: (i == 0) | (p != F.element_at(ring, F.greatest(i, F.lit(1)))))
    return F.transform(F.transform(rings, whole), apart)


def _ring_area(ring: Column) -> Column:
    """Area of a closed ring in the square of its units, taken from its first vertex."""
    o = ring[0]
    steps = F.zip_with(ring, F.slice(ring, 2, F.size(ring)), lambda a, b: F.when(b.isNotNull(), (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])).otherwise(0.0))
    return F.abs(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)) / 2


def rings_area(rings: Column) -> Column:
    """Area of a polygon: its first ring less the others."""
    each = F.transform(rings, _ring_area)
    return F.aggregate(F.slice(each, 2, F.size(each)), F.try_element_at(each, F.lit(1)), lambda s, v: s - v)


def geometry_change(polygons: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Features, vertices and area of a layer before and after its rings were changed, and features that lost all area."""
    vertices = lambda c: F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda n, ring: n + F.size(ring))
    exact = lambda c: F.sum(to_fixed(rings_area(F.col(c)), 12).cast("decimal(38,0)")).cast("double") / 1e12
    return polygons.groupBy(*keys).agg(
        F.count("*").alias("features"), F.sum(vertices(before)).alias("vertices_before"), F.sum(vertices(after)).alias("vertices_after"),
        exact(before).alias("area_before"), exact(after).alias("area_after"), F.count_if(rings_area(F.col(after)) <= 0).alias("emptied"))


def polygon_area_km2(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Shoelace area in equal-area metres, holes taken out by orientation."""
    part = F.col("orient") * (F.col("xb") - F.col("xa")) * (F.col("ya") + F.col("yb")) / 2.0
    total = F.sum(to_fixed(part, 2)).cast("double") / 100.0
    return edges.groupBy(*keys).agg(round_dp(F.abs(total) / 1e6, 2).alias("area_km2"))


def polygon_centroid(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Area centroid of an edge table given in any planar units (offset by its first vertex for precision).

    Sums are taken over decimals, so they do not depend on the order of the edges.
    """
    exact = lambda x: F.sum(x.cast("decimal(38,18)")).cast("double")
    origin = edges.groupBy(*keys).agg(F.min("xa").alias("_ox"), F.min("ya").alias("_oy"))
    e = spread_join(edges, origin, keys)
    xa, ya, xb, yb = (F.col(c) - F.col(o) for c, o in (("xa", "_ox"), ("ya", "_oy"), ("xb", "_ox"), ("yb", "_oy")))
    k = (xa * yb - xb * ya) * F.col("orient") * -1.0
    out = e.groupBy(*keys, "_ox", "_oy").agg(
        exact(k).alias("_a"), exact((xa + xb) * k).alias("_x"), exact((ya + yb) * k).alias("_y")
    )
    return out.select(
        *keys, (F.col("_ox") + F.try_divide(F.col("_x"), 3 * F.col("_a"))).alias("x"),
        (F.col("_oy") + F.try_divide(F.col("_y"), 3 * F.col("_a"))).alias("y"),
    )


def _clamped_integral(y: Column, base: Column, res: float) -> Column:
    """Antiderivative in y of min(max(y - base, 0), res)."""
    h = y - base
    return F.when(h <= 0, 0.0).when(h <= res, h * h / 2.0).otherwise(res * res / 2.0 + (h - res) * res)


def polygon_cells(edges: DataFrame, keys: list[str], res: int) -> DataFrame:
    """Cells of the grid each polygon touches, with the covered share of the cell."""
    r = float(res)
    xa, ya, xb, yb = (F.col(c) for c in ("xa", "ya", "xb", "yb"))
    left, right = F.least(xa, xb), F.greatest(xa, xb)
    ox, oy = float(fixed.GRID_ORIGIN_X), float(fixed.GRID_ORIGIN_Y)
    strips = dealt(edges, [*keys, "xa", "ya", "xb", "yb"]).withColumn(
        "col", F.explode_outer(F.sequence(F.floor((left - ox) / r).cast("int"), F.floor((right - ox) / r).cast("int")))
    )
    x_from = F.greatest(left, ox + F.col("col") * r)
    x_to = F.least(right, ox + (F.col("col") + 1) * r)
    slope = F.when(xb != xa, (yb - ya) / (xb - xa))
    strips = strips.select(
        *keys, "col",
        ((x_to - x_from) * F.signum(xb - xa) * F.col("orient")).alias("_w"),
        F.when(slope.isNull(), ya).otherwise(ya + (x_from - xa) * slope).alias("_y0"),
        F.when(slope.isNull(), yb).otherwise(ya + (x_to - xa) * slope).alias("_y1"),
    )
    low, high = F.least("_y0", "_y1"), F.greatest("_y0", "_y1")
    # One row below the edge starts the wholly covered part of the column.
    rows = strips.withColumn("_low", F.floor((low - oy) / r).cast("int")).withColumn(
        "row", F.explode_outer(F.sequence(F.col("_low") - 1, F.floor((high - oy) / r).cast("int")))
    )
    base = oy + F.col("row") * r
    mean = F.when(
        F.col("_y1") != F.col("_y0"),
        (_clamped_integral(F.col("_y1"), base, r) - _clamped_integral(F.col("_y0"), base, r))
        / (F.col("_y1") - F.col("_y0")),
    ).otherwise(F.least(F.greatest(F.col("_y0") - base, F.lit(0.0)), F.lit(r)))
    on_edge = F.col("row") >= F.col("_low")
    parts = rows.groupBy(*keys, "col", "row").agg(
        F.sum(F.when(on_edge, to_fixed(F.col("_w") * mean, _AREA_DIGITS)).otherwise(0)).alias("_part"),
        F.sum(F.when(on_edge, 0).otherwise(to_fixed(F.col("_w"), _WIDTH_DIGITS))).alias("_full"),
        F.max(on_edge).alias("touched"),
    )
    down = Window.partitionBy(*keys, "col").orderBy(F.desc("row"))
    parts = parts.withColumns({
        "_carry": F.sum("_full").over(down), "_next": F.lead("row").over(down),
    })
    carried = F.col("_carry").cast("double") * res / 10.0**_WIDTH_DIGITS
    here = F.struct(
        F.col("row").alias("row"), F.col("touched").alias("touched"),
        (F.col("_part").cast("double") / 10.0**_AREA_DIGITS + carried).alias("area"),
    )
    gap = F.when(
        (F.col("_carry") != 0) & (F.col("_next") < F.col("row") - 1),
        F.transform(F.sequence(F.col("_next") + 1, F.col("row") - 1), lambda i: F.struct(
            i.alias("row"), F.lit(False).alias("touched"), carried.alias("area"))),
    ).otherwise(F.array().cast("array<struct<row:int,touched:boolean,area:double>>"))
    cells = parts.select(*keys, "col", F.explode_outer(F.concat(F.array(here), gap)).alias("c")).select(
        *keys, F.lit(res).alias("res"), "col", "c.row", "c.touched",
        F.greatest(F.lit(0.0), F.col("c.area") / (r * r)).alias("fraction"),
    )
    return cells.where(F.col("touched") | (F.col("fraction") > 1e-9))


def cover(edges: DataFrame, keys: list[str], res: int) -> DataFrame:
    """Cells whose square meets the polygon at all."""
    return polygon_cells(edges, keys, res).select(*keys, "res", "col", "row")


def box_rings(df: DataFrame, keys: list[str], box: Column) -> DataFrame:
    """A struct(min_lon, min_lat, max_lon, max_lat) as one closed ring."""
    w, s, e, n = (box[c] for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    return df.select(*keys, F.array(ring).alias("rings"))


def unit_shares(cells: DataFrame, overlay: DataFrame, cell_keys: list[str], unit: str, top: int = 3) -> DataFrame:
    """Largest units of each cell by covered share; shares that round to 0 at three places are dropped."""
    joined = cells.join(shuffled(overlay), ["res", "col", "row"])
    summed = joined.groupBy(*cell_keys, unit).agg(
        (F.sum(to_fixed(F.col("fraction"), 9)).cast("double") / 1e9).alias("_f"))
    first = best_per_key(summed, cell_keys, [F.desc("_f"), F.asc(unit)], top)
    return first.withColumn("frac", round_dp(F.col("_f"), 3)).where("frac > 0").drop("_f")


def coarsest_within(edges: DataFrame, keys: list[str], start: int, cap: int) -> DataFrame:
    """Per area the first rung from ``start`` whose cover holds at most ``cap`` cells (else the top rung).

    Only ``start`` is walked on the geometry; coarser counts are distinct parents of the same cells.
    """
    base = cover(edges, keys, start).select(*keys, "col", "row")
    rungs = [s for s in fixed.RESOLUTION_LADDER if s >= start]
    levels = F.explode(F.array(*[F.struct(F.lit(s).alias("res"), F.lit(s // start).alias("_k")) for s in rungs]))
    parents = base.withColumn("_l", levels).select(
        *keys, "_l.res", F.floor(F.col("col") / F.col("_l._k")).alias("_c"),
        F.floor(F.col("row") / F.col("_l._k")).alias("_r"))
    counts = parents.distinct().groupBy(*keys, "res").agg(F.count("*").alias("cells"))
    fits = (F.col("cells") <= cap) | (F.col("res") == rungs[-1])
    return counts.where(fits).groupBy(*keys).agg(
        F.min("res").alias("res"), F.min_by("cells", "res").alias("cells"))
