"""SQL text for projections and distances, used only by the comparison statements."""
from __future__ import annotations

import math

from lodegrid.functions import grid as g

OX, OY = -2240000, 2656000
A, E2, E = 6378137.0, 0.006694380022900787, math.sqrt(0.006694380022900787)
LON0 = math.radians(-96.0)


def rd(e: str, p: int = 4) -> str:
    return f"(floor(CAST(({e}) AS DOUBLE) * 1e{p} + 0.5e0) / 1e{p})"


def fx(e: str, p: int = 9) -> str:
    return f"CAST(floor(CAST(({e}) AS DOUBLE) * 1e{p} + 0.5e0) AS BIGINT)"


def fsum(e: str, p: int = 9) -> str:
    return f"(CAST(sum({fx(e, p)}) AS DOUBLE) / 1e{p})"


def favg(e: str, p: int = 9) -> str:
    return f"(CAST(sum({fx(e, p)}) AS DOUBLE) / count({e}) / 1e{p})"


def authalic(s: str) -> str:
    return (f"({1 - E2!r} * ({s} / (1 - {E2!r} * {s} * {s}) + ln((1 + {E!r} * {s}) / (1 - {E!r} * {s})) / {2 * E!r}))")


def albers_x(lon: str, lat: str) -> str:
    q = authalic(f"sin(radians({lat}))")
    return f"({A!r} * sqrt({g.CONE_C!r} - {g.CONE_N!r} * {q}) / {g.CONE_N!r} * sin({g.CONE_N!r} * (radians({lon}) - ({LON0!r}))))"


def albers_y(lon: str, lat: str) -> str:
    q = authalic(f"sin(radians({lat}))")
    return (f"({g.CONE_RHO0!r} - {A!r} * sqrt({g.CONE_C!r} - {g.CONE_N!r} * {q}) / {g.CONE_N!r} "
            f"* cos({g.CONE_N!r} * (radians({lon}) - ({LON0!r}))))")


def inverse(x: str, y: str, lon: str, lat: str) -> str:
    """Select-list items giving degrees of a grid-metre point; helper columns carry the output's name."""
    k = lat
    n2 = g.CONE_N * g.CONE_N / (A * A)
    s = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)
    return (
        f"({g.CONE_RHO0!r} - ({y})) AS {k}_dy, "
        f"({g.CONE_C!r} - (({x}) * ({x}) + {k}_dy * {k}_dy) * {n2!r}) / {g.CONE_N!r} AS {k}_q, "
        f"asin({k}_q / {g.AUTHALIC_POLE!r}) AS {k}_b, "
        f"{k}_b + {s[0]!r} * sin(2 * {k}_b) + {s[1]!r} * sin(4 * {k}_b) + {s[2]!r} * sin(6 * {k}_b) AS {k}_p, "
        f"sin({k}_p) AS {k}_s, 1 - {E2!r} * {k}_s * {k}_s AS {k}_r, "
        f"degrees({LON0!r} + atan2({x}, {k}_dy) / {g.CONE_N!r}) AS {lon}, "
        f"degrees({k}_p + ({k}_q - {authalic(k + '_s')}) * {k}_r * {k}_r / ({2 * (1 - E2)!r} * cos({k}_p))) AS {lat}"
    )


def corners(col: str, row: str, res: str) -> str:
    items = []
    for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
        x = f"CAST({OX} + ({col} + {dx}) * {res} AS DOUBLE)"
        y = f"CAST({OY} + ({row} + {dy}) * {res} AS DOUBLE)"
        items.append(inverse(x, y, f"lon{i}", f"lat{i}"))
    return ", ".join(items)


def cell_id(res: str, col: str, row: str) -> str:
    return f"'wa5070-' || {res} || 'm-' || lpad(CAST({col} AS VARCHAR), 6, '0') || '-' || lpad(CAST({row} AS VARCHAR), 6, '0')"


def km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (f"sqrt(pow(({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2e0)) * 111.32e0, 2) "
            f"+ pow(({lat2} - {lat1}) * 110.574e0, 2))")


def square_aoi(radius: str = "radius_km") -> str:
    """CTE ``box`` over a CTE ``aoi``."""
    return (f"box AS (SELECT aoi_id, lon - {radius} / (111.32e0 * cos(radians(lat))) AS w, "
            f"lon + {radius} / (111.32e0 * cos(radians(lat))) AS e, "
            f"lat - {radius} / 110.574e0 AS s, lat + {radius} / 110.574e0 AS n FROM aoi)")


def cover_ctes(res: int) -> str:
    """CTEs from ``box`` to ``cells(aoi_id, col, row)``: separating-axis test of every square in the bounds."""
    v = (("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"))
    quad = ", ".join(f"{albers_x(a, b)} AS x{i}, {albers_y(a, b)} AS y{i}" for i, (a, b) in enumerate(v))
    tests = []
    for i in range(4):
        j = (i + 1) % 4
        tests.append("greatest(" + ", ".join(
            f"(x{j} - x{i}) * ({cy} - y{i}) - (y{j} - y{i}) * ({cx} - x{i})"
            for cx in ("sx", f"sx + {res}") for cy in ("sy", f"sy + {res}")) + ") >= 0")
    return (
        f"quad AS (SELECT aoi_id, {quad} FROM box), "
        f"ext AS (SELECT *, CAST(floor((least(x0,x1,x2,x3) - ({OX})) / {res}) AS INT) AS c0, "
        f"CAST(floor((greatest(x0,x1,x2,x3) - ({OX})) / {res}) AS INT) AS c1, "
        f"CAST(floor((least(y0,y1,y2,y3) - {OY}) / {res}) AS INT) AS r0, "
        f"CAST(floor((greatest(y0,y1,y2,y3) - {OY}) / {res}) AS INT) AS r1 FROM quad), "
        f"colx AS (SELECT *, unnest(range(c0, c1 + 1)) AS col FROM ext), "
        f"sq AS (SELECT *, unnest(range(r0, r1 + 1)) AS row, {OX} + col * {res} AS sx FROM colx), "
        f"sq2 AS (SELECT *, {OY} + row * {res} AS sy FROM sq), "
        f"cells AS (SELECT aoi_id, CAST(col AS INT) AS col, CAST(row AS INT) AS row FROM sq2 WHERE {' AND '.join(tests)})"
    )


def framed_ctes(res: int) -> str:
    """CTEs from ``cells`` to ``framed``: corners in the area's local metre frame (px0..py3)."""
    loc = ", ".join(f"(lon{i} - lon00) * mx AS px{i}, (lat{i} - lat00) * 110574e0 AS py{i}" for i in range(4))
    return (
        f"cor AS (SELECT aoi_id, col, row, {corners('col', 'row', str(res))} FROM cells), "
        f"fr AS (SELECT aoi_id, (min(least(lon0,lon1,lon2,lon3)) + max(greatest(lon0,lon1,lon2,lon3))) / 2e0 AS lon00, "
        f"(min(least(lat0,lat1,lat2,lat3)) + max(greatest(lat0,lat1,lat2,lat3))) / 2e0 AS lat00 FROM cor GROUP BY 1), "
        f"framed AS (SELECT c.*, lon00, lat00, 111320e0 * cos(radians(lat00)) AS mx, {loc} FROM cor c JOIN fr USING (aoi_id))"
    )


def seg_d2(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = (f"least(1e0, greatest(0e0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / "
         f"nullif(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 0)))")
    t = f"coalesce({t}, 0e0)"
    return f"(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"


def quad_distance(px: str, py: str) -> str:
    inside = " AND ".join(
        f"(px{(i+1)%4} - px{i}) * ({py} - py{i}) - (py{(i+1)%4} - py{i}) * ({px} - px{i}) >= 0" for i in range(4))
    sides = ", ".join(seg_d2(px, py, f"px{i}", f"py{i}", f"px{(i+1)%4}", f"py{(i+1)%4}") for i in range(4))
    return f"CASE WHEN {inside} THEN 0e0 ELSE sqrt(least({sides})) END"
