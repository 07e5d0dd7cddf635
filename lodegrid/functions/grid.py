"""The fixed quadtree grid: resolutions, ids, equal-area projection, cell geometry."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed

# NAD83 / Conus Albers on GRS80 (fixed values of the projection's definition).
_A = 6378137.0
_E2 = 0.006694380022900787
_E = math.sqrt(_E2)
_LON0 = math.radians(-96.0)
_PHI1, _PHI2, _PHI0 = (math.radians(v) for v in (29.5, 45.5, 23.0))


def _authalic(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) + math.atanh(_E * s) / _E)


def _parallel(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


CONE_N = (_parallel(_PHI1) ** 2 - _parallel(_PHI2) ** 2) / (_authalic(_PHI2) - _authalic(_PHI1))
CONE_C = _parallel(_PHI1) ** 2 + CONE_N * _authalic(_PHI1)
CONE_RHO0 = _A * math.sqrt(CONE_C - CONE_N * _authalic(_PHI0)) / CONE_N
AUTHALIC_POLE = _authalic(math.pi / 2)


def _geodetic(beta: float) -> float:
    phi = beta
    for _ in range(20):
        s = math.sin(phi)
        root = 1 - _E2 * s * s
        phi += (AUTHALIC_POLE * math.sin(beta) - _authalic(phi)) * root * root / (2 * (1 - _E2) * math.cos(phi))
    return phi


def _latitude_series(terms: int = 5, samples: int = 128) -> tuple[float, ...]:
    """Sine coefficients of geodetic minus authalic latitude, by quadrature over half a turn."""
    total = [0.0] * terms
    for j in range(1, samples):
        beta = math.pi * j / samples
        if 2 * j == samples:
            continue
        gap = _geodetic(beta) - beta if beta < math.pi / 2 else -(_geodetic(math.pi - beta) - (math.pi - beta))
        for k in range(terms):
            total[k] += gap * math.sin(2 * (k + 1) * beta)
    return tuple(2 * t / samples for t in total)


SERIES = _latitude_series()


def _authalic_col(phi: Column) -> Column:
    s = F.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) + F.log((1 + _E * s) / (1 - _E * s)) / (2 * _E))


def to_grid_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to equal-area metres."""
    theta = CONE_N * (F.radians(lon) - _LON0)
    rho = _A * F.sqrt(CONE_C - CONE_N * _authalic_col(F.radians(lat))) / CONE_N
    return rho * F.sin(theta), F.lit(CONE_RHO0) - rho * F.cos(theta)


def _authalic_latitude(x: Column, y: Column) -> Column:
    dy = F.lit(CONE_RHO0) - y
    q = (CONE_C - (x * x + dy * dy) * (CONE_N * CONE_N / (_A * _A))) / CONE_N
    return F.asin(q / AUTHALIC_POLE)


def _longitude(x: Column, y: Column) -> Column:
    return F.degrees(F.lit(_LON0) + F.atan2(x, F.lit(CONE_RHO0) - y) / CONE_N)


def _latitude(beta: Column) -> Column:
    phi = beta
    for k, c in enumerate(SERIES, start=1):
        phi = phi + c * F.sin(2 * k * beta)
    return F.degrees(phi)


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Equal-area metres to degrees."""
    return _longitude(x, y), _latitude(_authalic_latitude(x, y))


# --- resolution ladder --------------------------------------------------------------------------
def _ladder() -> Column:
    return F.array(*[F.lit(step) for step in fixed.RESOLUTION_LADDER])


def snap_resolution(res: Column) -> Column:
    """Rung at the least logarithmic distance; the finer rung wins a tie."""
    wanted = F.greatest(res.cast("double"), F.lit(1.0))
    return F.array_min(
        F.transform(_ladder(), lambda s: F.struct(F.abs(F.log(s / wanted)).alias("d"), s.alias("step")))
    )["step"]


def coarser(res: Column) -> Column:
    above = F.filter(_ladder(), lambda s: s > res)
    return F.coalesce(F.try_element_at(above, F.lit(1)), F.lit(fixed.RESOLUTION_LADDER[-1]))


def on_ladder(res: Column) -> Column:
    return res.cast("int").isin(*fixed.RESOLUTION_LADDER)


# --- ids ----------------------------------------------------------------------------------------
_ID = f"^{fixed.GRID_TAG}-(\\d+)m-(\\d{{6}})-(\\d{{6}})$"


def cell_id(res: Column, col: Column, row: Column) -> Column:
    return F.format_string(f"{fixed.GRID_TAG}-%dm-%06d-%06d", res, col, row)


def parse_cell_id(x: Column) -> Column:
    """struct(res, col, row); null when the id is malformed."""
    part = [F.regexp_extract(x, _ID, i).try_cast("int") for i in (1, 2, 3)]
    return F.when(
        part[1].isNotNull(), F.struct(part[0].alias("res"), part[1].alias("col"), part[2].alias("row"))
    )


def col_index(x: Column, res: Column) -> Column:
    return F.floor((x - fixed.GRID_ORIGIN_X) / res).cast("int")


def row_index(y: Column, res: Column) -> Column:
    return F.floor((y - fixed.GRID_ORIGIN_Y) / res).cast("int")


def locate(lon: Column, lat: Column, res: Column) -> Column:
    """struct(res, col, row) of the cell containing a point."""
    x, y = to_grid_metres(lon, lat)
    return F.struct(res.cast("int").alias("res"), col_index(x, res).alias("col"), row_index(y, res).alias("row"))


def centre_x(col: Column, res: Column) -> Column:
    return fixed.GRID_ORIGIN_X + (col + 0.5) * res


def centre_y(row: Column, res: Column) -> Column:
    return fixed.GRID_ORIGIN_Y + (row + 0.5) * res


def parent_index(index: Column, res: Column, parent_res: Column) -> Column:
    """Exact quadtree containment; a finer or off-ladder parent is an error."""
    return F.when(
        (parent_res >= res) & (parent_res % res == 0), F.floor(index / (parent_res / res)).cast("int")
    ).otherwise(F.raise_error(F.lit("parent resolution must be a coarser rung of the same ladder")).cast("int"))


def with_corners(df: DataFrame) -> DataFrame:
    """Add the four corners (lon0, lat0 .. lon3, lat3), counter-clockwise from the south-west.

    Authalic latitudes become columns first, so generated code computes each once.
    """
    res, col, row = F.col("res"), F.col("col"), F.col("row")
    lons, betas = {}, {}
    for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
        x = (F.lit(fixed.GRID_ORIGIN_X) + (col + dx) * res).cast("double")
        y = (F.lit(fixed.GRID_ORIGIN_Y) + (row + dy) * res).cast("double")
        lons[f"lon{i}"], betas[f"_beta{i}"] = _longitude(x, y), _authalic_latitude(x, y)
    lats = {f"lat{i}": _latitude(F.col(f"_beta{i}")) for i in range(4)}
    return df.withColumns({**lons, **betas}).withColumns(lats).drop(*betas)


def with_bbox(df: DataFrame) -> DataFrame:
    """Degree bounds of the square from its id alone. Needs the corners."""
    lons = [F.col(f"lon{i}") for i in range(4)]
    lats = [F.col(f"lat{i}") for i in range(4)]
    return df.withColumns({
        "min_lon": F.least(*lons), "min_lat": F.least(*lats),
        "max_lon": F.greatest(*lons), "max_lat": F.greatest(*lats),
    })


def ring_json() -> Column:
    """GeoJSON polygon of a cell with corners, six decimals."""
    points = [
        F.format_string("[%.6f,%.6f]", F.col(f"lon{i}"), F.col(f"lat{i}")) for i in (0, 1, 2, 3, 0)
    ]
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *points), F.lit("]]}"))
