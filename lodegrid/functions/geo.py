"""Distances, boxes, local metre frames and foreign projections as native expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegrid import fixed

_MLAT = fixed.M_PER_DEG_LAT
_MLON = fixed.M_PER_DEG_LON_EQUATOR


def metres_per_degree_lon(lat: Column) -> Column:
    return _MLON * F.cos(F.radians(lat))


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column, mx: Column) -> tuple[Column, Column]:
    """Metres from a frame's origin; ``mx`` is the frame's metres per degree of longitude."""
    return (lon - lon0) * mx, (lat - lat0) * _MLAT


def km_between(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2.0)) * (_MLON / 1000.0)
    dy = (lat2 - lat1) * (_MLAT / 1000.0)
    return F.sqrt(dx * dx + dy * dy)


def padded_bbox(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, km: float) -> Column:
    dlat = km * 1000.0 / _MLAT
    dlon = km * 1000.0 / F.greatest(F.lit(1.0), metres_per_degree_lon((min_lat + max_lat) / 2.0))
    return F.struct(
        (min_lon - dlon).alias("min_lon"), (min_lat - dlat).alias("min_lat"),
        (max_lon + dlon).alias("max_lon"), (max_lat + dlat).alias("max_lat"),
    )


def square_around(lon: Column, lat: Column, radius_km: Column) -> Column:
    """Square area of interest of half-width ``radius_km``."""
    dlat = radius_km / (_MLAT / 1000.0)
    dlon = radius_km / (_MLON / 1000.0 * F.cos(F.radians(lat)))
    return F.struct(
        (lon - dlon).alias("min_lon"), (lat - dlat).alias("min_lat"),
        (lon + dlon).alias("max_lon"), (lat + dlat).alias("max_lat"),
    )


def in_bbox(lon: Column, lat: Column, min_lon, min_lat, max_lon, max_lat) -> Column:
    return lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat)


def boxes_overlap(a: tuple[Column, ...], b: tuple) -> Column:
    """Each stored bound against the opposite bound of the window (min_lon, min_lat, max_lon, max_lat)."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def in_envelope(lon: Column, lat: Column) -> Column:
    return in_bbox(lon, lat, *fixed.ENVELOPE)


def foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Place of the nearest point of segment ab to p, 0 at a and 1 at b (0 for an empty segment)."""
    dx, dy = bx - ax, by - ay
    along = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)), F.lit(0.0))


def offset(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, t: Column) -> Column:
    """Distance from p to the point of ab at place ``t``."""
    return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_touch(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Do segments ab and cd share a point? Orientation signs, with the collinear cases."""
    o1, o2 = cross(*a, *b, *c), cross(*a, *b, *d)
    o3, o4 = cross(*c, *d, *a), cross(*c, *d, *b)

    def within(p, q, r):
        return (
            (r[0] >= F.least(p[0], q[0])) & (r[0] <= F.greatest(p[0], q[0]))
            & (r[1] >= F.least(p[1], q[1])) & (r[1] <= F.greatest(p[1], q[1]))
        )

    proper = (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)
    return (
        proper | ((o1 == 0) & within(a, b, c)) | ((o2 == 0) & within(a, b, d))
        | ((o3 == 0) & within(c, d, a)) | ((o4 == 0) & within(c, d, b))
    )


def meeting_point(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """struct(x, y) that segments ab and cd share, null where they share none; the smallest end point where ends touch."""
    o1, o2 = cross(*a, *b, *c), cross(*a, *b, *d)
    o3, o4 = cross(*c, *d, *a), cross(*c, *d, *b)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def end(o, p, q, r):
        on = r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
        return F.when((o == 0) & on, at(*r))

    ends = F.array_min(F.array_compact(F.array(end(o1, a, b, c), end(o2, a, b, d), end(o3, c, d, a), end(o4, c, d, b))))
    t = o3 / (o3 - o4)
    proper = (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)
    return F.coalesce(ends, F.when(proper, at(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))))


def azimuth(dx: Column, dy: Column) -> Column:
    """Trend folded to [0, 180); null for a closed or single-point trace."""
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(180.0)))


# --- UTM on WGS84 -------------------------------------------------------------------------------
_UA, _UF, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_UE2 = _UF * (2 - _UF)


def _meridian(phi: Column, a: float, e2: float) -> Column:
    return a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )


def krueger(flattening: float) -> tuple[float, list[float]]:
    """Radius of the rectifying sphere over the semi-major axis, and the coefficients of the transverse Mercator series."""
    n = flattening / (2 - flattening)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    return radius, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]


def to_utm(lon: Column, lat: Column) -> Column:
    """Zone, band and whole metres by the Krueger series on the conformal sphere; under a millimetre within a zone."""
    radius, series = krueger(_UF)
    zone = F.ceil((lon + 180.0) / 6.0 + 1e-12).cast("int")
    away = F.radians(lon - (zone * 6 - 183))
    e = _UE2**0.5
    conformal = F.sinh(F.atanh(F.sin(F.radians(lat))) - e * F.atanh(e * F.sin(F.radians(lat))))
    xi0 = F.atan2(conformal, F.cos(away))
    eta0 = F.asinh(F.sin(away) / F.hypot(conformal, F.cos(away)))
    xi, eta = xi0, eta0
    for j, c in enumerate(series, 1):
        xi = xi + c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    scale = _K0 * _UA * radius
    row = F.floor(lat / 8.0).cast("int") + 10
    band = F.substring(F.lit(fixed.UTM_BANDS), F.greatest(F.lit(0), F.least(F.lit(len(fixed.UTM_BANDS) - 1), row)) + 1, F.lit(1))
    north = scale * xi + F.when(lat < 0, 1e7).otherwise(0.0)
    return F.struct(zone.alias("zone"), band.alias("band"), F.floor(scale * eta + 5e5 + 0.5).cast("bigint").alias("easting"),
                    F.floor(north + 0.5).cast("bigint").alias("northing"))


# --- source projections to degrees --------------------------------------------------------------
def utm_inverse(easting: Column, northing: Column, zone: int, a: float, e2: float) -> tuple[Column, Column]:
    """Northern-hemisphere UTM metres to degrees on the given ellipsoid (footpoint series)."""
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = northing / _K0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    root = F.sqrt(1 - e2 * sin * sin)
    n1, r1 = a / root, a * (1 - e2) / (root * root * root)
    t, c = tan * tan, ep2 * cos * cos
    d = (easting - 500000.0) / (n1 * _K0)
    d2 = d * d
    lat = phi - n1 * tan / r1 * d2 * (
        0.5 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d2 / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d2 * d2 / 720
    )
    lon = d * (
        1 - (1 + 2 * t + c) * d2 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d2 * d2 / 120
    ) / cos
    return F.degrees(lon) + float(zone * 6 - 183), F.degrees(lat)


# Clarke 1866, and the mean shift from NAD27 to WGS84 over the conterminous United States (fixed values).
_CLARKE_A, _CLARKE_F = 6378206.4, 1 / 294.9786982
_SHIFT = (-8.0, 160.0, 176.0)
_DA, _DF = 6378137.0 - _CLARKE_A, 1 / 298.257223563 - _CLARKE_F


def nad27_utm_to_wgs84(easting: Column, northing: Column, zone: int = 11) -> tuple[Column, Column]:
    """UTM on NAD27 to WGS84 with the abridged Molodensky shift."""
    e2 = _CLARKE_F * (2 - _CLARKE_F)
    lon, lat = utm_inverse(easting, northing, zone, _CLARKE_A, e2)
    lam, phi = F.radians(lon), F.radians(lat)
    s, c = F.sin(phi), F.cos(phi)
    w = 1 - e2 * s * s
    nu, rho = _CLARKE_A / F.sqrt(w), _CLARKE_A * (1 - e2) / (w * F.sqrt(w))
    dx, dy, dz = _SHIFT
    dphi = (-dx * s * F.cos(lam) - dy * s * F.sin(lam) + dz * c
            + (_CLARKE_A * _DF + _CLARKE_F * _DA) * F.sin(2 * phi)) / rho
    dlam = (-dx * F.sin(lam) + dy * F.cos(lam)) / (nu * c)
    return lon + F.degrees(dlam), lat + F.degrees(dphi)


# Washington South, Lambert conformal, US survey feet (fixed values of the projection's definition).
_FOOT = 1200.0 / 3937.0
_LCC = dict(lat0=45 + 20 / 60, lon0=-120.5, p1=45 + 50 / 60, p2=47 + 20 / 60, fe=500000.0, fn=0.0)
_GRS_E2 = 0.006694380022900787


def _lcc_constants() -> tuple[float, float, float]:
    e = math.sqrt(_GRS_E2)

    def m(p):
        return math.cos(p) / math.sqrt(1 - _GRS_E2 * math.sin(p) ** 2)

    def t(p):
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    p1, p2, p0 = (math.radians(_LCC[k]) for k in ("p1", "p2", "lat0"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big_f = m(p1) / (n * t(p1) ** n)
    return n, big_f, 6378137.0 * big_f * t(p0) ** n


def washington_south_to_wgs84(x_ft: Column, y_ft: Column) -> tuple[Column, Column]:
    """State-plane US survey feet to degrees."""
    n, big_f, rho0 = _lcc_constants()
    e2 = _GRS_E2
    dx, dy = x_ft * _FOOT - _LCC["fe"], rho0 - (y_ft * _FOOT - _LCC["fn"])
    rho = F.sqrt(dx * dx + dy * dy)
    chi = math.pi / 2 - 2 * F.atan(F.pow(rho / (6378137.0 * big_f), F.lit(1 / n)))
    lat = (
        chi + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12) * F.sin(2 * chi)
        + (7 * e2**2 / 48 + 29 * e2**3 / 240) * F.sin(4 * chi) + (7 * e2**3 / 120) * F.sin(6 * chi)
    )
    return F.degrees(F.atan2(dx, dy) / n) + _LCC["lon0"], F.degrees(lat)
