import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewake.functions import geo, met, text


def test_utm_zones():
    assert (geo.utm_epsg_at(72.8, 18.9), geo.utm_epsg_at(-0.1, 51.5), geo.utm_epsg_at(151.2, -33.9)) == (32643, 32630, 32756)


def test_utm_round_trip():
    for lon, lat in ((72.3, 18.2), (-70.1, -41.0), (3.0, 0.5)):
        epsg = geo.utm_epsg_at(lon, lat)
        assert np.allclose(geo.from_utm(*geo.to_utm(lon, lat, epsg), epsg), (lon, lat), atol=1e-9)


def test_area_of_a_degree_at_the_equator():
    assert 12300 < geo.geodesic_area_km2([(0, 0), (1, 0), (1, 1), (0, 1)]) < 12400


def test_shape_of_a_long_rectangle():
    m = geo.shape_metrics([(72, 18), (72.2, 18), (72.2, 18.02), (72, 18.02), (72, 18)])
    assert 80 < m["orientation_deg"] < 100 and m["major_axis_km"] > 5 * m["minor_axis_km"]
    assert abs(m["major_axis_km"] * m["minor_axis_km"] / m["area_km2"] - 1) < 0.05


def test_haversine_between_cities(spark):
    d = geo.haversine(72.8777, 19.0760, 77.5946, 12.9716)
    got = spark.range(1).select(geo.haversine_km(F.lit(72.8777), F.lit(19.0760), F.lit(77.5946), F.lit(12.9716))).first()[0]
    assert 830 < d < 860 and abs(d - got) < 1e-9


def test_buffer_grows():
    ring = [(72, 18), (72.05, 18), (72.05, 18.05), (72, 18.05), (72, 18)]
    assert geo.geodesic_area_km2(geo.buffered(ring, 5)) > 3 * geo.geodesic_area_km2(ring)


def test_directions(spark):
    u, v = met.uv_towards(F.lit(1.0), F.lit(90.0))
    a, b = met.uv_from(F.lit(1.0), F.lit(270.0))
    r = spark.range(1).select(u.alias("u"), v.alias("v"), a.alias("a"), b.alias("b"), met.speed_direction(F.lit(1.0), F.lit(0.0))[1].alias("d")).first()
    assert np.allclose([r["u"], r["v"], r["a"], r["b"], r["d"]], [1, 0, 1, 0, 90], atol=1e-12)


def test_point_in_ring_inline_and_as_array_agree(spark):
    random.seed(3)
    ring = [(math.cos(a) * (1 + 0.3 * math.sin(5 * a)), math.sin(a) * (1 + 0.3 * math.sin(5 * a))) for a in np.linspace(0, 2 * math.pi, 60, endpoint=False)]
    ring.append(ring[0])
    points = [(random.uniform(-2, 2), random.uniform(-2, 2)) for _ in range(200)]
    frame = spark.createDataFrame(points, "lon double, lat double")
    got = [tuple(r) for r in frame.select(geo.in_ring(F.col("lon"), F.col("lat"), ring), geo.ring_distance_km(F.col("lon"), F.col("lat"), ring)).collect()]
    want = geo.inside(np.array([p[0] for p in points]), np.array([p[1] for p in points]), ring)
    assert [g[0] for g in got] == want.tolist() and all((g[1] == 0) == g[0] for g in got)


def test_cells_outline_covers_the_cells():
    cells = {(0, 0), (1, 0), (1, 1), (3, 3)}
    rings = geo.cells_outline(cells, 0, 0, 1, 1)
    area = sum(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r[:-1], r[1:], strict=True))) / 2 for r in rings)
    assert area == len(cells)


def test_simplified_keeps_the_shape():
    ring = [(72 + 0.1 * math.cos(a), 18 + 0.1 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 400)]
    few = geo.simplified(ring, 100)
    assert len(few) < 100 and abs(geo.geodesic_area_km2(few) / geo.geodesic_area_km2(ring) - 1) < 0.02


def test_times_from_names_and_tags(spark):
    rows = [("S1A_IW_GRDH_1SDV_20260906T010237_20260906T010309_004450_0083F6_023C.tif", {}, None), ("x_20260102_030405-vv.tif", {}, None), ("plain.png", {"TIFFTAG_DATETIME": "2026:05:06 07:08:09", "POLARISATION": "vh"}, None), ("plain.png", {}, "2026-01-01T00:00:00"), ("bad_20261399_999999.png", {}, None)]
    frame = spark.createDataFrame(rows, "name string, tags map<string,string>, given string")
    t, label = text.scene_time(F.to_timestamp("given"), F.col("tags"), F.col("name"))
    got = frame.select(text.iso(t).alias("t"), label.alias("l"), text.polarisation(F.col("tags"), F.col("name")).alias("p")).collect()
    assert [r["l"] for r in got] == ["sentinel1_filename", "filename_timestamp", "tiff_tag:TIFFTAG_DATETIME", "analyst", "assumed_now"]
    assert [r["t"] for r in got][:4] == ["2026-09-06T01:02:37Z", "2026-01-02T03:04:05Z", "2026-05-06T07:08:09Z", "2026-01-01T00:00:00Z"]
    assert [r["p"] for r in got] == [None, "VV", "VH", None, None]


def test_a_plan_parses_each_time_once_and_only_what_looks_like_one(spark):
    """As many parsers as formats; every pattern lets through all that its format reads."""
    frame = spark.createDataFrame([("plain.png", {"datetime": "2026-01-02 03:04:05"}, None)], "name string, tags map<string,string>, given timestamp")
    plan = frame.select(text.scene_time_found(F.col("given"), F.col("tags"), F.col("name")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("gettimestamp(") <= len(text.TIME_FORMATS) + 1
    odd = ["2026-01-02t03:04:05z", "2026-01-02T03:04:05.1Z", "2026-01-02T03:04:05.123456Z", "2026-01-02T03:04:05.123", "+12026-01-02 03:04:05", "12026-01-02 03:04:05", " 2026-01-02 03:04:05", "2026-13-02 03:04:05", "2026:01:02 03:04:05", "20260102030405", "", "x", None]
    for form in (*text.TIME_FORMATS, "yyyyMMddHHmmss"):
        got = spark.createDataFrame([(o,) for o in odd], "s string").select(text._time(F.col("s"), form).cast("string").alias("a"), F.try_to_timestamp("s", F.lit(form)).cast("string").alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got], form
