"""Nearest land without a radius, against all pairs."""

import math
import random

import pytest

from tidewake.operators import land


def plain_km(lon, lat, polygons):
    """Distance to all edges of all polygons, also seen around the globe; 0 inside."""
    kx, best = 111 * max(0.2, math.cos(math.radians(lat))), None
    for rings in polygons:
        inside = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                    inside = not inside
                for turn in (-360, 0, 360):
                    ax, ay, dx, dy = (x1 + turn - lon) * kx, (y1 - lat) * 111, (x2 - x1) * kx, (y2 - y1) * 111
                    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / max(dx * dx + dy * dy, 1e-18)))
                    km = math.hypot(ax + t * dx, ay + t * dy)
                    best = km if best is None else min(best, km)
        if inside:
            return 0.0
    return best


def test_nearest_land_against_all_pairs(spark):
    draw = random.Random(5)
    islands = []
    for _ in range(25):
        x, y, r = draw.uniform(-178, 178), draw.uniform(-80, 80), draw.uniform(0.05, 1.5)
        turns = sorted(draw.uniform(0, 2 * math.pi) for _ in range(7))
        islands.append([[(x + r * math.cos(t), y + r * math.sin(t)) for t in turns]])
    points = [(i, draw.uniform(-180, 180), draw.uniform(-89, 89)) for i in range(150)] + [(900 + i, 179.9, -60.0 + 10 * i) for i in range(12)] + [(990, islands[0][0][0][0], islands[0][0][0][1])]
    points += [(991, *[sum(v) / 7 for v in zip(*islands[3][0], strict=True)])] * 2
    table = spark.createDataFrame(points, "k int, lon double, lat double")
    pieces = land.pieces(spark, islands).cache()
    got = land.nearest_land(table, pieces)
    rows = got.collect()
    assert len(rows) == len(points)
    for r in rows:
        assert r["land_km"] == pytest.approx(plain_km(r["lon"], r["lat"], islands), rel=1e-9, abs=1e-6)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_points_near_land_ask_few_cells(spark, monkeypatch):
    """No step follows for points whose own cells already hold the nearest piece."""
    steps = []
    monkeypatch.setattr(land, "settled", lambda frame, keep=land.settled: steps.append(1) or keep(frame))
    pieces = land.pieces(spark, [[[(10.5, 10.5), (11.5, 10.5), (11.0, 11.5)]]])
    land.nearest_land(spark.createDataFrame([(11.0, 10.45)], "lon double, lat double"), pieces).collect()
    near = len(steps)
    steps.clear()
    land.nearest_land(spark.createDataFrame([(71.0, 40.0)], "lon double, lat double"), pieces).collect()
    assert near == 2 < len(steps)
    none = land.nearest_land(spark.createDataFrame([(1.0, 2.0)], "lon double, lat double"), pieces.where("false"))
    assert none.first()["land_km"] is None


def test_points_of_one_cell_stay_in_their_partitions(spark):
    """Distances within a radius against all pairs; a crowded cell is not brought to one task by a shuffle."""
    draw = random.Random(7)
    islands = [[[(x, y), (x + 0.4, y), (x, y + 0.4), (x, y)]] for x, y in ((draw.uniform(-12, 12), draw.uniform(55, 79)) for _ in range(60))]
    pieces = land.pieces(spark, islands)
    table = spark.createDataFrame([(draw.uniform(-13, 13), draw.uniform(54, 80)) for _ in range(300)] + [(None, 60.0)], "lon double, lat double")
    got = land.land_distance(table, pieces, 150.0)
    rows = got.collect()
    assert len(rows) == 301 and sum(r["land_km"] < 150 for r in rows) > 50
    for r in rows:
        want = 150.0 if r["lon"] is None else min(150.0, plain_km(r["lon"], r["lat"], islands))
        assert r["land_km"] == pytest.approx(want, rel=1e-9, abs=1e-6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
