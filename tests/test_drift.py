import numpy as np
from pyspark.sql import functions as F

from tidewake import config
from tidewake.functions.geo import inside, metres_per_degree_at
from tidewake.operators import density, drift
from tidewake.sources import fields

SQUARE = [(72.1, 18.1), (72.1005, 18.1), (72.1005, 18.1005), (72.1, 18.1005), (72.1, 18.1)]
STILL = {"windage_range": [0.03, 0.03], "current_scale_range": [1.0, 1.0], "current_direction_jitter_deg": 0, "wind_speed_jitter_frac": 0, "diffusion_m2_s": 0.0}


def run(spark, values, hours=2, **extra):
    p = config.drift_params(STILL | {"hindcast_hours": hours, "particle_count": 50, "ensemble_members": 2} | extra)
    field = fields.constant(spark, [72, 18, 72.2, 18.2], -hours * 3600.0, 0.0, dict(zip(("u_current", "v_current", "u_wind", "v_wind"), values, strict=True)))
    return p, drift.integrate(spark, SQUARE, fields.Grid.of(field), 0.0, p).cache()


def moved(particles, p):
    first, last = (particles.where((F.col("member") == 0) & (F.col("step") == s)).orderBy("particle").toPandas() for s in (0, p.n_steps))
    mx, my = metres_per_degree_at(18.1)
    return (last["lon"] - first["lon"]) * mx, (last["lat"] - first["lat"]) * my


def test_steady_current_and_reproducibility(spark):
    p, a = run(spark, (0.2, 0.0, 0.0, 0.0))
    east, north = moved(a, p)
    assert np.allclose(east, -1440, rtol=0.01) and np.allclose(north, 0, atol=0.1)
    _, b = run(spark, (0.2, 0.0, 0.0, 0.0))
    assert a.exceptAll(b).count() == 0 and a.count() == 3 * 50 * (p.n_steps + 1)


def test_windage(spark):
    p, a = run(spark, (0.0, 0.0, 0.0, 10.0), hours=1)
    assert np.allclose(moved(a, p)[1], -0.03 * 10 * 3600, rtol=0.02)


def test_members_spread_and_coast_holds_particles(spark):
    p = config.drift_params({"hindcast_hours": 2, "particle_count": 60, "ensemble_members": 3})
    field = fields.Grid.of(fields.constant(spark, [72, 18, 72.2, 18.2], -7200.0, 0.0))
    got = drift.integrate(spark, SQUARE, field, 0.0, p, land=lambda x, y: x < 72.0995).cache()
    ens = got.where("member >= 0")
    assert ens.where(F.col("step") == p.n_steps).agg(F.stddev("lon")).first()[0] > 0
    assert ens.where("stranded").count() > 0 and got.where("member = -1 and stranded").count() == 0
    stuck = ens.where("stranded").groupBy("member", "particle").agg(F.countDistinct("lon").alias("n")).agg(F.max("n")).first()[0]
    assert stuck == 1


def test_seeds_lie_inside():
    triangle = [(72, 18), (72.1, 18.05), (72.05, 18.1), (72, 18)]
    lon, lat = drift.seed_points(triangle, 300, 1)
    assert len(lon) == 300 and inside(lon, lat, triangle).all()
    lon, _ = drift.seed_points([(1, 1), (1, 1), (1, 1)], 5, 1)
    assert len(lon) == 5


def test_rk4_in_a_turning_field(spark):
    lats, lons = np.linspace(-1, 1, 41), np.linspace(-1, 1, 41)
    y, x = np.meshgrid(lats, lons, indexing="ij")
    values = np.zeros((4, 2, 41, 41))
    w = 2 * np.pi / 86400
    mx, my = metres_per_degree_at(0.0)
    values[0], values[1] = -w * y * my, w * x * mx
    grid = fields.Grid(np.array([0.0, 90000.0]), lats, lons, values)
    p = config.drift_params(STILL | {"hindcast_hours": 24, "particle_count": 50, "ensemble_members": 1, "windage_range": [0.0, 0.0]}, "forward")
    got = drift.integrate(spark, [(0.5, 0), (0.5001, 0), (0.5001, 0.0001), (0.5, 0)], grid, 0.0, p).where("member = 0").groupBy("step").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y")).toPandas().set_index("step")
    assert abs(got["x"][96] - got["x"][0]) < 2e-3 and abs(got["y"][96]) < 5e-3 and abs(got["x"][48] + got["x"][0]) < 5e-3


def test_density_against_numpy(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(0, 1, (500, 2))
    frame = spark.createDataFrame([(0, i, 0, 0.0, float(a), float(b), False) for i, (a, b) in enumerate(pts)], drift.PARTICLES)
    g = density.grid_of(frame, 20)
    cells = density.mass_cells(density.histogram(frame, g))
    h, _, _ = np.histogram2d(pts[:, 0], pts[:, 1], bins=[g["x0"] + g["dx"] * np.arange(21), g["y0"] + g["dy"] * np.arange(21)])
    assert sum(r["n"] for r in cells.collect()) == 500 == h.sum()
    flat = np.sort(h.ravel())[::-1]
    for mass in (0.5, 0.7, 0.9):
        k = int(np.searchsorted(np.cumsum(flat), mass * 500)) + 1
        assert abs(cells.where(F.col("before") < mass).count() - k) <= 1
    rings, area = density.region_polygon(cells, 0.7, g)
    assert rings and area > 0


def steps_frame(spark, scores):
    return spark.createDataFrame([(i, -900.0 * i, 0.25 * i, float(s)) for i, s in enumerate(scores)], "step int, epoch double, hours double, score double")


def test_release_window_rules(spark):
    w = density.release_window(steps_frame(spark, [0] * 10 + [0.2, 0.6, 1.0, 0.7, 0.6, 0.55, 0.5, 0.5, 0.5, 0.5, 0.1, 0.9]))
    assert (w["lo"], w["hi"], w["peak"], w["basis"]) == (11, 19, 12, "flow_convergence_peak")
    w = density.release_window(steps_frame(spark, [0.0] * 13))
    assert (w["lo"], w["hi"]) == (2, 12) and w["basis"].startswith("no_convergence")
    w = density.release_window(steps_frame(spark, [0, 0, 0, 0, 1.0, 0, 0, 0, 0, 0, 0, 0, 0, 0]))
    assert w["hours_back"][1] - w["hours_back"][0] >= 2


def test_field_filling_sampling_and_checks(spark):
    rows = [(t, y, x, None if (t, y, x) == (0.0, 0.0, 0.0) or t == 10.0 else t + 10 * y + 100 * x, 1.0, 2.0, 3.0) for t in (0.0, 10.0, 20.0) for y in (0.0, 1.0) for x in (0.0, 1.0)]
    f = spark.createDataFrame(rows, "epoch double, lat double, lon double, u_cur double, v_cur double, u_wind double, v_wind double")
    full = {(r["epoch"], r["lat"], r["lon"]): r for r in fields.filled(f).collect()}
    assert full[0.0, 0.0, 0.0]["u_cur"] == (10 + 100 + 110) / 3 and full[0.0, 0.0, 0.0]["filled"]
    assert abs(full[10.0, 1.0, 1.0]["u_cur"] - (110 + 130) / 2) < 1e-9 and not full[20.0, 1.0, 1.0]["filled"]
    whole = fields.filled(f).select("epoch", "lat", "lon", *fields.PARTS)
    grid = fields.Grid.of(whole)
    pts = spark.createDataFrame([(5.0, 0.3, 0.6), (20.0, 2.0, -1.0)], "epoch double, lat double, lon double")
    got = fields.sampled(whole, pts, {"epoch": (0.0, 10.0, 3), "lat": (0.0, 1.0, 2), "lon": (0.0, 1.0, 2)}).orderBy("epoch").collect()
    want = [grid.sample(np.array([x]), np.array([y]), t)[0, 0] for t, y, x in ((5.0, 0.3, 0.6), (20.0, 2.0, -1.0))]
    assert np.allclose([r["u_cur"] for r in got], want)
    assert fields.problems(f, [0, 0, 1, 1], 0, 20) == [] and len(fields.problems(f, [-5, 0, 1, 1], -9000, 20)) == 2
    assert fields.endpoint(0, 10 * 86400) == "archive" and fields.endpoint(9 * 86400, 10 * 86400) == "forecast"


def test_forecast(spark):
    p = config.drift_params({"hindcast_hours": 3, "particle_count": 50, "ensemble_members": 2}, "forward")
    field = fields.Grid.of(fields.constant(spark, [72, 18, 72.2, 18.2], 0.0, 3 * 3600.0))
    out = drift.forecast(drift.integrate(spark, SQUARE, field, 0.0, p), p)
    assert len(out["steps"]) == 4 and out["envelope_area_km2"] > 0 and out["coastal_impact_risk"] is False
