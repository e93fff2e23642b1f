"""Land polygons: pieces keyed by grid cell, membership and distance."""

from __future__ import annotations

from collections import defaultdict
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.geo import Ring, in_rings, inside
from tidewake.session import settled

CELL_DEG = 2.0
PIECES = "cell_x int, cell_y int, piece_id long, rings array<array<struct<lon: double, lat: double>>>"


def clip(ring: Ring, west: float, south: float, east: float, north: float) -> Ring:
    """Part of a ring in a box, one half-plane after another; empty if they don't meet."""

    def cut(points: Ring, axis: int, bound: float, keep_less: bool) -> Ring:
        out: Ring = []
        for a, b in zip(points, [*points[1:], points[0]], strict=True) if points else []:
            ia, ib = (a[axis] <= bound) == keep_less or a[axis] == bound, (b[axis] <= bound) == keep_less or b[axis] == bound
            if ia:
                out.append(a)
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                p = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                p[axis] = bound
                out.append(tuple(p))
        return out

    for axis, bound, less in ((0, west, False), (0, east, True), (1, south, False), (1, north, True)):
        ring = cut(ring, axis, bound, less)
    return ring


def pieces(spark: SparkSession, polygons: list[list[Ring]], cell: float = CELL_DEG) -> DataFrame:
    """Polygons (shell first, then holes) cut by a grid; done once, then kept as Parquet."""
    rows = []
    for n, rings in enumerate(polygons):
        rings = [r[:-1] if r[0] == r[-1] else r for r in rings]
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        for cx in range(floor(min(xs) / cell), floor(max(xs) / cell) + 1):
            for cy in range(floor(min(ys) / cell), floor(max(ys) / cell) + 1):
                cut = [clip(r, cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell) for r in rings]
                if len(cut[0]) > 2:
                    rows.append((cx, cy, n, [[(float(x), float(y)) for x, y in [*r, r[0]]] for r in cut if len(r) > 2]))
    return spark.createDataFrame(rows, PIECES)


def read_shapefile(data: bytes) -> list[list[Ring]]:
    """Polygons of an ESRI shapefile: clockwise rings are shells, the others holes of the shell before."""
    import struct

    out: list[list[Ring]] = []
    at = 100
    while at + 8 <= len(data):
        words = struct.unpack(">i", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        xy = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            ring = [tuple(map(float, p)) for p in xy[a:b]]
            turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring[:-1], ring[1:], strict=True))
            if turn < 0 or not out:
                out.append([ring])
            else:
                out[-1].append(ring)
    return out


#: Land of up to so many vertices goes to every task.
MOST_BROADCAST = 1_000_000


def _vertices(land: DataFrame) -> int:
    return land.agg(F.sum(F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)))).first()[0] or 0


def _small(land: DataFrame) -> bool:
    """Whether land is the side of a join that goes to the points.

    Points crowd in few cells, so a shuffle on the cell would bring them to few
    tasks; the optimiser doesn't broadcast a side that it sees fill few
    partitions.  Larger land leaves the choice to it.
    """
    return _vertices(land) <= MOST_BROADCAST


def _listed(land: DataFrame) -> DataFrame:
    """(cell_x, cell_y, pieces): all pieces of a cell in one row, with their bounds."""
    lon, lat = (F.flatten(F.transform("rings", lambda r: r[axis])) for axis in ("lon", "lat"))
    piece = F.struct("rings", F.array_min(lon).alias("west"), F.array_max(lon).alias("east"), F.array_min(lat).alias("south"), F.array_max(lat).alias("north"))
    return land.groupBy("cell_x", "cell_y").agg(F.collect_list(piece).alias("pieces"))


def _reaching(land: DataFrame, most_km: float, cell: float) -> DataFrame:
    """``land`` by the cells of the points that may lie within ``most_km`` of a piece, not by its own."""
    slack = 1e-9
    lon, lat = (F.flatten(F.transform("rings", lambda r: r[axis])) for axis in ("lon", "lat"))
    ry = most_km / 111.0 + slack
    far = F.greatest(F.abs(F.col("cell_y") * cell), F.abs((F.col("cell_y") + 1) * cell))
    rx = most_km / _km_per_degree(F.least(far, F.lit(90.0))) + slack

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int")))

    rows = land.select("rings", F.array_min(lon).alias("w"), F.array_max(lon).alias("e"), F.array_min(lat).alias("s"), F.array_max(lat).alias("n"))
    rows = rows.withColumn("cell_y", cells(F.col("s") - ry, F.col("n") + ry))
    return rows.withColumn("cell_x", cells(F.col("w") - rx, F.col("e") + rx)).select("cell_x", "cell_y", "rings")


def _met(points: DataFrame, land: DataFrame, x: Column, y: Column, cell: float) -> DataFrame:
    """``points`` with ``__pieces`` of the cell of (x, y), null if it has none; no row is shuffled."""
    listed = _listed(land).select(F.col("cell_x").alias("__cell_x"), F.col("cell_y").alias("__cell_y"), F.col("pieces").alias("__pieces"))
    keyed = points.withColumn("__cx", F.floor(x / cell).cast("int")).withColumn("__cy", F.floor(y / cell).cast("int"))
    out = keyed.join(F.broadcast(listed) if _small(land) else listed, (F.col("__cx") == F.col("__cell_x")) & (F.col("__cy") == F.col("__cell_y")), "left")
    return out.drop("__cx", "__cy", "__cell_x", "__cell_y")


def on_land(points: DataFrame, land: DataFrame | None, cell: float = CELL_DEG) -> DataFrame:
    """``points`` with ``on_land``; no land table means sea everywhere.

    Longitudes wrap and latitudes are clipped.  Points meet the pieces of their
    own cell, which are one row, by equality.
    """
    if land is None:
        return points.withColumn("on_land", F.lit(False))
    x = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    y = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat")))
    met = _met(points.withColumn("__x", x).withColumn("__y", y), land, F.col("__x"), F.col("__y"), cell)
    inside = F.exists("__pieces", lambda p: in_rings(F.col("__x"), F.col("__y"), p["rings"]))
    return met.withColumn("on_land", F.coalesce(inside, F.lit(False))).drop("__x", "__y", "__pieces")


def _edges_km(rings: Column, lon: Column, lat: Column, kx: Column, shift: Column | float = 0.0) -> Column:
    """Least distance from a point to the edges of rings that are moved ``shift`` degrees east."""
    ky = F.lit(111.0)

    def edge_km(a: Column, b: Column) -> Column:
        ax, ay = (a["lon"] + shift - lon) * kx, (a["lat"] - lat) * ky
        dx, dy = (b["lon"] - a["lon"]) * kx, (b["lat"] - a["lat"]) * ky
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-18))))
        return F.sqrt(F.pow(ax + t * dx, 2.0) + F.pow(ay + t * dy, 2.0))

    def ring_km(ring: Column) -> Column:
        n = F.size(ring)
        return F.array_min(F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), edge_km))

    return F.array_min(F.transform(rings, ring_km))


def _km_per_degree(lat: Column) -> Column:
    return 111.0 * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))


def land_distance(points: DataFrame, land: DataFrame, most_km: float = 50.0, cell: float = CELL_DEG) -> DataFrame:
    """``points`` with ``land_km``, the distance to the nearest land, 0 on land and ``most_km`` at most.

    Pieces are listed in every cell from which they can be reached, so a point
    asks its own cell only; pieces beyond can't be nearer.
    """
    lon, lat, most = F.col("lon"), F.col("lat"), F.lit(float(most_km))
    placed = on_land(points, land, cell).withColumn("__kx", _km_per_degree(lat))
    met = _met(placed, _reaching(land, most_km, cell), lon, lat, cell)
    rx, ry = most / F.col("__kx") + 1e-9, most_km / 111.0 + 1e-9
    near = F.filter("__pieces", lambda p: (lon >= p["west"] - rx) & (lon <= p["east"] + rx) & (lat >= p["south"] - ry) & (lat <= p["north"] + ry))
    km = F.array_min(F.transform(near, lambda p: _edges_km(p["rings"], lon, lat, F.col("__kx"))))
    return met.withColumn("land_km", F.when(F.col("on_land"), 0.0).otherwise(F.least(most, F.coalesce(km, most)))).drop("__kx", "__pieces", "on_land")


def nearest_land(points: DataFrame, land: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """``points`` with ``land_km``, the distance to the nearest land however far, 0 on land, null without any land.

    Squares of cells grow around the points: of twice the width each time, and
    only around points whose nearest piece so far is farther away than the rim
    of the cells asked.  Every step is an equality join; longitudes wrap if
    whole cells go round.
    """
    placed = settled(on_land(points, land, cell).withColumn("__p", F.monotonically_increasing_id()))
    around = round(360 / cell)
    wraps = abs(around * cell - 360) < 1e-9
    x = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    y = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat")))
    left = placed.where(~F.col("on_land")).select("__p", x.alias("x"), y.alias("y"), F.floor(x / cell).cast("int").alias("cx"), F.floor(y / cell).cast("int").alias("cy"), F.lit(None).cast("double").alias("km"))
    found: list[DataFrame] = []
    inner, reach = -1, 0
    any_land = land.limit(1).count() > 0
    beside = F.broadcast(land) if _small(land) else land
    while any_land:
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        ring = left.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).where(F.greatest(F.abs("dx"), F.abs("dy")) > inner)
        far_x = F.col("cx") + F.col("dx")
        own_x = F.pmod(far_x + around // 2, F.lit(around)) - around // 2 if wraps else far_x
        asked = ring.select("__p", "x", "y", own_x.cast("int").alias("cell_x"), (F.col("cy") + F.col("dy")).alias("cell_y"), ((far_x - own_x) * cell).alias("shift"))
        met = asked.join(beside, ["cell_x", "cell_y"])
        near = met.groupBy("__p").agg(F.min(_edges_km(F.col("rings"), F.col("x"), F.col("y"), _km_per_degree(F.col("y")), F.col("shift"))).alias("near"))
        rim_x = F.least(F.col("x") - (F.col("cx") - reach) * cell, (F.col("cx") + reach + 1) * cell - F.col("x")) * _km_per_degree(F.col("y"))
        # Beyond a pole there is nothing to come nearer.
        down, up = (F.col("cy") - reach) * cell, (F.col("cy") + reach + 1) * cell
        rim_y = F.least(F.when(down > -90, F.col("y") - down).otherwise(F.lit(1e9)), F.when(up < 90, up - F.col("y")).otherwise(F.lit(1e9))) * 111.0
        rim = F.least(F.lit(1e9) if reach * cell >= 360 else rim_x, rim_y)
        state = settled(left.join(near, "__p", "left").withColumn("km", F.least("km", "near")).withColumn("known", F.coalesce(F.col("km") <= rim, F.lit(False)) | F.lit(reach * cell >= 360)))
        found.append(state.where("known").select("__p", "km"))
        left = state.where("not known").drop("near", "known")
        if not left.limit(1).count():
            break
        inner, reach = reach, 2 * reach + 1
    if not found:
        return placed.withColumn("land_km", F.lit(None).cast("double")).drop("__p", "on_land")
    distances = found[0]
    for more in found[1:]:
        distances = distances.unionByName(more)
    return placed.join(distances, "__p", "left").withColumn("land_km", F.when(F.col("on_land"), F.lit(0.0)).otherwise(F.col("km"))).drop("__p", "km", "on_land")


class LandIndex:
    """Land pieces in memory, for tasks that move particles and for single points; ``land_distance`` serves tables.

    A reference table of more than ``most_vertices`` is refused: it has to be
    cut to the area first.
    """

    def __init__(self, land: DataFrame, cell: float = CELL_DEG, most_vertices: int = 4_000_000):
        held = _vertices(land)
        if held > most_vertices:
            raise ValueError(f"{held} vertices of land: cut the table to the area, {most_vertices} at most")
        self.cell, self.by_cell = cell, defaultdict(list)
        for r in land.toLocalIterator():
            self.by_cell[r["cell_x"], r["cell_y"]].append([[(p["lon"], p["lat"]) for p in ring] for ring in r["rings"]])

    def __call__(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        x, y = (lon + 180) % 360 - 180, np.clip(lat, -90, 90)
        cx, cy = np.floor(x / self.cell).astype(int), np.floor(y / self.cell).astype(int)
        out = np.zeros(len(x), bool)
        for c in set(zip(cx.tolist(), cy.tolist(), strict=True)) & set(self.by_cell):
            here = np.flatnonzero((cx == c[0]) & (cy == c[1]))
            for rings in self.by_cell[c]:
                odd = np.zeros(len(here), bool)
                for r in rings:
                    odd ^= inside(x[here], y[here], r)
                out[here] |= odd
        return out

    def distance_km(self, lon: float, lat: float, most_km: float = 50.0) -> float:
        """To the nearest land, at most ``most_km``; 0 on land."""
        if self(np.array([lon]), np.array([lat]))[0]:
            return 0.0
        kx, ky = 111.0 * max(0.2, float(np.cos(np.radians(lat)))), 111.0
        best = most_km
        rx, ry = most_km / kx, most_km / ky
        for cx in range(floor((lon - rx) / self.cell), floor((lon + rx) / self.cell) + 1):
            for cy in range(floor((lat - ry) / self.cell), floor((lat + ry) / self.cell) + 1):
                for rings in self.by_cell.get((cx, cy), []):
                    for r in rings:
                        p = (np.array(r) - (lon, lat)) * (kx, ky)
                        a, d = p[:-1], np.diff(p, axis=0)
                        t = np.clip(-(a * d).sum(1) / np.maximum((d * d).sum(1), 1e-18), 0, 1)
                        best = min(best, float(np.sqrt(((a + t[:, None] * d) ** 2).sum(1)).min()))
        return best
