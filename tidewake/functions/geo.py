"""Geodesy: column builders for the plans, NumPy for polygons on the driver and in tasks.

Rings are arrays of struct<lon, lat>; a closed ring repeats its first vertex.
"""

from __future__ import annotations

from math import asin, atan2, cos, degrees, hypot, pi, radians, sin, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres, and the WGS84 ellipsoid (fixed values).
RADIUS_M = 6371008.8
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
E2 = WGS84_F * (2 - WGS84_F)
Ring = list[tuple[float, float]]


# ------------------------------------------------------------------ columns


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2.0)
    return 2 * (RADIUS_M / 1000) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing on the sphere, in [0, 360)."""
    dlon, p1, p2 = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angular_diff_deg(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Of longitude and of latitude, by the usual cosine series."""
    p = F.radians(lat)
    mlat = 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)
    mlon = 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)
    return mlon, mlat


def utm_xy(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """East and north in metres, by the same series as ``to_utm``, inside generated code."""
    e = sqrt(E2)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = F.radians(lon - (F.pmod(epsg, F.lit(100)) * 6 - 183))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * _A * x, F.when(epsg.between(32701, 32799), 10_000_000).otherwise(0) + _K0 * _A * y


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((lon + 180.0) / 6.0) + 1).cast("int")))
    return zone + F.when(lat >= 0, 32600).otherwise(32700)


def pixel_lonlat(row: Column, col: Column, bounds: tuple[float, float, float, float], height: int, width: int) -> tuple[Column, Column]:
    """Upper left corner of a pixel of a north-up raster."""
    west, south, east, north = bounds
    return F.lit(west) + col * ((east - west) / width), F.lit(north) - row * ((north - south) / height)


def ring_literal(ring: Ring) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring])


def _edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a != b]


#: Rings of more edges are held as an array and walked, instead of written out as one expression.
INLINE_EDGES = 24


def _edge_array(edges: list[tuple[float, float, float, float]]) -> Column:
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for e in edges])


def in_ring(lon: Column, lat: Column, ring: Ring) -> Column:
    """Even-odd rule; the edges of a small ring become part of the expression, so it stays in generated code."""
    if len(ring) > INLINE_EDGES:
        level = [e for e in _edges(ring) if e[1] != e[3]]
        hit = F.filter(_edge_array(level), lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
        return F.size(hit) % 2 == 1
    crossings = F.lit(0)
    for x1, y1, x2, y2 in _edges(ring):
        if y1 != y2:
            spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            crossings = crossings + F.when(spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd rule over an array of closed rings held in a column."""

    def crosses(ring: Column) -> Column:
        n = F.size(ring)
        pairs = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        hit = F.filter(
            pairs,
            lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
            & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]),
        )
        return F.size(hit)

    return F.aggregate(rings, F.lit(0), lambda n, r: n + crosses(r)) % 2 == 1


def ring_distance_km(lon: Column, lat: Column, ring: Ring) -> Column:
    """Distance to a polygon in the metric frame of its middle latitude; 0 inside."""
    mid = sum(y for _, y in ring) / len(ring)
    mx, my = metres_per_degree_at(mid)
    if len(ring) > INLINE_EDGES:

        def away(e: Column) -> Column:
            dx, dy = (e["x2"] - e["x1"]) * mx, (e["y2"] - e["y1"]) * my
            px, py = (lon - e["x1"]) * mx, (lat - e["y1"]) * my
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / (dx * dx + dy * dy)))
            return F.sqrt(F.pow(px - t * dx, 2.0) + F.pow(py - t * dy, 2.0)) / 1000.0

        return F.when(in_ring(lon, lat, ring), 0.0).otherwise(F.array_min(F.transform(_edge_array(_edges(ring)), away)))
    best: Column | None = None
    for x1, y1, x2, y2 in _edges(ring):
        dx, dy = (x2 - x1) * mx, (y2 - y1) * my
        px, py = (lon - x1) * mx, (lat - y1) * my
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / (dx * dx + dy * dy)))
        d = F.sqrt(F.pow(px - t * dx, 2.0) + F.pow(py - t * dy, 2.0)) / 1000.0
        best = d if best is None else F.least(best, d)
    return F.when(in_ring(lon, lat, ring), 0.0).otherwise(best)


# ------------------------------------------------------------------ scalars


def metres_per_degree_at(lat: float) -> tuple[float, float]:
    p = radians(lat)
    return 111412.84 * cos(p) - 93.5 * cos(3 * p) + 0.118 * cos(5 * p), 111132.92 - 559.82 * cos(2 * p) + 1.175 * cos(4 * p) - 0.0023 * cos(6 * p)


def haversine(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    h = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS_M / 1000 * asin(min(1.0, sqrt(h)))


def bearing(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    d, p1, p2 = radians(lon2 - lon1), radians(lat1), radians(lat2)
    return degrees(atan2(sin(d) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(d))) % 360


def utm_epsg_at(lon: float, lat: float) -> int:
    return (32600 if lat >= 0 else 32700) + max(1, min(60, int((lon + 180) // 6) + 1))


_N = WGS84_F / (2 - WGS84_F)
_A = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0 = 0.9996


def to_utm(lon: float | np.ndarray, lat: float | np.ndarray, epsg: int) -> tuple:
    """Transverse Mercator by Krüger's series to third order: under a millimetre inside a zone; numbers or arrays."""
    e = sqrt(E2)
    s = np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    dl = np.radians(lon) - radians((epsg % 100) * 6 - 183)
    xi, eta = np.arctan2(t, np.cos(dl)), np.arctanh(np.sin(dl) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return 500000 + _K0 * _A * x, (10_000_000 if 32700 < epsg < 32800 else 0) + _K0 * _A * y


def from_utm(east: float | np.ndarray, north: float | np.ndarray, epsg: int) -> tuple:
    xi = (north - (10_000_000 if 32700 < epsg < 32800 else 0)) / (_K0 * _A)
    eta = (east - 500000) / (_K0 * _A)
    x = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    y = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return (epsg % 100) * 6 - 183 + np.degrees(np.arctan2(np.sinh(y), np.cos(x))), np.degrees(lat)


def _closed(ring: Ring) -> Ring:
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def geodesic_area_km2(ring: Ring, holes: tuple[Ring, ...] = ()) -> float:
    """Area on the ellipsoid, by authalic latitudes with edges subdivided."""
    e = sqrt(E2)

    def q(lat: np.ndarray) -> np.ndarray:
        s = np.sin(np.radians(lat))
        return (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(e * s) / e)

    pts = np.array(_closed(ring))
    t = np.linspace(0, 1, 17)
    total = 0.0
    for (x1, y1), (x2, y2) in zip(pts[:-1], pts[1:], strict=True):
        lat = y1 + (y2 - y1) * t
        total += float(np.radians(x2 - x1) * np.trapezoid(q(lat), t))
    area = abs(total) * WGS84_A**2 / 2 / 1e6
    return area - sum(geodesic_area_km2(h) for h in holes)


def geodesic_perimeter_km(ring: Ring) -> float:
    """Sum of edges, each in the metric frame of its middle latitude."""
    out = 0.0
    pts = _closed(ring)
    for (x1, y1), (x2, y2) in zip(pts[:-1], pts[1:], strict=True):
        mx, my = metres_per_degree_at((y1 + y2) / 2)
        out += hypot((x2 - x1) * mx, (y2 - y1) * my) / 1000
    return out


def centroid(ring: Ring) -> tuple[float, float]:
    pts = np.array(_closed(ring))
    x, y = pts[:, 0] - pts[0, 0], pts[:, 1] - pts[0, 1]
    w = x[:-1] * y[1:] - x[1:] * y[:-1]
    if abs(w.sum()) < 1e-18:
        return float(pts[:-1, 0].mean()), float(pts[:-1, 1].mean())
    return float(pts[0, 0] + ((x[:-1] + x[1:]) * w).sum() / (3 * w.sum())), float(pts[0, 1] + ((y[:-1] + y[1:]) * w).sum() / (3 * w.sum()))


def convex_hull(points: Ring) -> Ring:
    """Andrew's monotone chain, counter-clockwise."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(items: Ring) -> Ring:
        out: Ring = []
        for p in items:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def smallest_rectangle(points: Ring) -> tuple[float, float, float]:
    """(longer side, shorter side, compass bearing of the longer side in [0, 180)) of the least rectangle."""
    hull = np.array(convex_hull(points), float)
    best = (np.inf, 0.0, 0.0, 0.0)
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        d = b - a
        n = hypot(*d)
        if n == 0:
            continue
        u = d / n
        along, across = hull @ u, hull @ np.array([-u[1], u[0]])
        w, h = float(np.ptp(along)), float(np.ptp(across))
        if w * h < best[0]:
            axis = u if w >= h else np.array([-u[1], u[0]])
            best = (w * h, max(w, h), min(w, h), degrees(atan2(axis[0], axis[1])) % 180)
    return best[1], best[2], best[3]


def shape_metrics(ring: Ring) -> dict[str, float | list[float] | str]:
    """Area, perimeter, centroid, axes, elongation and orientation of a polygon."""
    if len(set(ring)) < 3:
        return {}
    cx, cy = centroid(ring)
    epsg = utm_epsg_at(cx, cy)
    major, minor, orientation = smallest_rectangle([to_utm(x, y, epsg) for x, y in ring])
    return {
        "area_km2": geodesic_area_km2(ring), "perimeter_km": geodesic_perimeter_km(ring), "centroid": [cx, cy], "major_axis_km": major / 1000, "minor_axis_km": minor / 1000,
        "elongation": major / max(minor, 1e-9), "orientation_deg": orientation, "local_crs": f"EPSG:{epsg}",
    }


def simplified(ring: Ring, tolerance_m: float) -> Ring:
    """Douglas-Peucker in the local metric frame; a ring keeps at least three vertices."""
    pts = _closed(ring)
    epsg = utm_epsg_at(*pts[0])
    local = np.array([to_utm(x, y, epsg) for x, y in pts])
    keep = {0, len(pts) - 1}
    far = int(np.argmax(((local - local[0]) ** 2).sum(axis=1)))
    todo = [(0, far), (far, len(pts) - 1)]
    keep.add(far)
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = local[b] - local[a]
        mid = local[a + 1 : b] - local[a]
        n = hypot(*d)
        off = np.abs(d[0] * mid[:, 1] - d[1] * mid[:, 0]) / n if n else np.hypot(mid[:, 0], mid[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance_m:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    out = [pts[i] for i in sorted(keep)]
    return out if len(out) >= 4 else pts


def padded_bounds(ring: Ring, km: float) -> list[float]:
    """Bounds of the polygon widened by a distance: all that a metric buffer is used for."""
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    dy = km * 1000 / metres_per_degree_at((min(ys) + max(ys)) / 2)[1]
    dx = km * 1000 / max(1.0, metres_per_degree_at(max(abs(min(ys)), abs(max(ys))))[0])
    return [min(xs) - dx, min(ys) - dy, max(xs) + dx, max(ys) + dy]


def buffered(ring: Ring, km: float, arc: int = 8) -> Ring:
    """Convex polygon around the ring's hull at a distance, with rounded corners."""
    epsg = utm_epsg_at(*ring[0])
    around = [2 * pi * k / (4 * arc) for k in range(4 * arc)]
    pts = [(x + 1000 * km * cos(a), y + 1000 * km * sin(a)) for x, y in (to_utm(*p, epsg) for p in ring) for a in around]
    hull = [from_utm(*p, epsg) for p in convex_hull(pts)]
    return [*hull, hull[0]]


def cells_outline(cells: set[tuple[int, int]], x0: float, y0: float, dx: float, dy: float) -> list[Ring]:
    """Rings around a set of grid cells: edges that two cells share cancel out."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in cells:
        for a, b, other in (((i, j), (i + 1, j), (i, j - 1)), ((i + 1, j), (i + 1, j + 1), (i + 1, j)), ((i + 1, j + 1), (i, j + 1), (i, j + 1)), ((i, j + 1), (i, j), (i - 1, j))):
            if other not in cells:
                after.setdefault(a, []).append(b)
    rings: list[Ring] = []
    while after:
        start = at = min(after)
        ring = [at]
        while True:
            nexts = after[at]
            step = nexts.pop()
            if not nexts:
                del after[at]
            at = step
            ring.append(at)
            if at == start:
                break
        rings.append([(x0 + i * dx, y0 + j * dy) for i, j in ring])
    return rings


def geojson_polygon(rings: list[Ring]) -> dict:
    """Rings by orientation: counter-clockwise ones are shells, the others their holes."""

    def signed(r: Ring) -> float:
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r[:-1], r[1:], strict=True))

    rings = [_closed(r) for r in rings]
    shells = [[r] for r in rings if signed(r) > 0] or [[r] for r in rings]
    for hole in (r for r in rings if signed(r) <= 0 and [r] not in shells):
        x, y = hole[0]
        home = next((s for s in shells if _inside(x, y, s[0])), shells[0])
        home.append(hole)
    listed = [[[[round(x, 5), round(y, 5)] for x, y in r] for r in shell] for shell in shells]
    return {"type": "Polygon", "coordinates": listed[0]} if len(listed) == 1 else {"type": "MultiPolygon", "coordinates": listed}


def shells(geometry: dict) -> list[Ring]:
    """Outer rings of a GeoJSON polygon or multipolygon."""
    parts = [geometry["coordinates"]] if geometry["type"] == "Polygon" else geometry["coordinates"]
    return [[(float(x), float(y)) for x, y, *_ in p[0]] for p in parts if p]


def _inside(x: float, y: float, ring: Ring) -> bool:
    return sum(((y1 > y) != (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in _edges(ring)) % 2 == 1


def inside(lon: np.ndarray, lat: np.ndarray, ring: Ring) -> np.ndarray:
    out = np.zeros(len(lon), bool)
    for x1, y1, x2, y2 in _edges(ring):
        if y1 != y2:
            out ^= ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    return out


def offset(lon: float, lat: float, east_m: float, north_m: float) -> tuple[float, float]:
    mx, my = metres_per_degree_at(lat)
    return lon + east_m / mx, lat + north_m / my


