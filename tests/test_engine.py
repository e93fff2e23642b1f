import pytest

from tidewake import config
from tidewake.plans.engine import Engine, epoch
from tidewake.plans.store import Store


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    key = e.synthetic_demo(size=300)
    return e, key


def done(e, job_id):
    j = e.job(job_id)
    assert j["state"] == "completed", j["error"]
    return j["result"]


def test_whole_case(case):
    e, c = case
    assert all(j["state"] == "completed" for j in e.jobs(c))
    slick = e.slicks(c)["features"][0]
    assert abs(slick["properties"]["centroid"][0] - 71.85) < 0.05 and abs(slick["properties"]["centroid"][1] - 18.45) < 0.05
    done(e, e.hindcast(c, slick["id"], "constant", hindcast_hours=6, ensemble_members=2, particle_count=60))
    run = e.hindcast_run(c)
    assert run["release_start"] < run["release_end"] and epoch(run["release_end"]) <= epoch(e.store.get("scenes", e.store.latest("scenes", c)["id"])["acquisition_time"])
    first = done(e, e.attribute(c))
    again = done(e, e.attribute(c, weights={"proximity": 1.0, "vessel_type": 0.0}))
    assert first["run_id"] != again["run_id"]
    a = e.attribution(c, first["run_id"])
    assert a["candidates"][0]["mmsi"] == 419001001 and a["candidates"][0]["raw"]["gaps"] and len(a["candidates"][0]["evidence"]) == 8
    e.review(c, slick={"slick_id": slick["id"], "status": "confirmed"}, candidate={"mmsi": 419001001, "status": "investigate", "note": "x"}, notes="seen")
    got = e.get_case(c)
    assert got["slicks"]["features"][0]["properties"]["review_status"] == "confirmed" and got["notes"] == "seen"
    assert {x["mmsi"]: x["review_status"] for x in e.attribution(c)["candidates"]}[419001001] == "investigate"
    with pytest.raises(ValueError):
        e.review(c, slick={"slick_id": slick["id"], "status": "maybe"})
    layers = {f["properties"]["layer"] for f in e.export(c, "geojson")["features"]}
    assert {"slick", "origin_region", "origin_region_50", "origin_region_90", "candidate_track"} <= layers
    bundle = e.export(c)
    assert bundle["schema"] == "tidewake.case.v1" and bundle["ais_imports"][0]["rows_quarantined"] == 2 and bundle["config_snapshot"]["config_hash"] == bundle["case"]["config_hash"]
    page = e.report_html(c)
    assert "419001001" in page and page.startswith("<!doctype html>")
    assert e.layer(c, "ais_tracks")["vessels_returned"] >= 10 and e.what_if(c, {"loitering": 1.0}).count() == len(e.attribution(c)["candidates"])
    assert [r["n_slicks"] for r in e.list_cases().collect()] == [1]


def test_failures_are_recorded(case):
    e, c = case
    job = e.job(e.ingest_scene(c, "chip.png", __import__("numpy").ones((30, 30)), None))
    assert job["state"] == "failed" and "bounds" in job["error"]
    with pytest.raises(config.NotFound):
        e.get_case("case_none")
    with pytest.raises(config.NotFound):
        e.get_forecast(c, "slick_none")
    with pytest.raises(ValueError):
        e.create_case("", "imported")
    with pytest.raises(ValueError):
        e.create_case("x", "dreamt")
    assert e.health()["status"] == "ok"


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("cases", [{"id": "a", "name": "A", "status": "created"}, {"id": "b", "name": "B", "status": "created"}])
    s.update("cases", "a", status="detected")
    assert s.get("cases", "a")["status"] == "detected" and s.table("cases").count() == 2
    s.delete_case("b")
    assert [r["id"] for r in s.table("cases").collect()] == ["a"]
    with pytest.raises(config.NotFound):
        s.get("cases", "b")


def test_jobs_in_the_background(spark, tmp_path):
    from threading import Event

    from tidewake.plans.store import Store

    store, gate = Store(spark, str(tmp_path / "jobs"), background=True), Event()
    one = store.run_job("wait", None, lambda job: gate.wait(30))
    bad = store.run_job("fail", None, lambda job: 1 / 0)
    assert store.get("jobs", one)["state"] in ("queued", "running")
    gate.set()
    assert store.wait(one)["state"] == "completed" and store.wait(bad)["state"] == "failed" and "ZeroDivisionError" in store.get("jobs", bad)["error"]


def test_default_provider_reads_landed_forecasts(spark, tmp_path):
    import zlib

    from pyspark.sql import functions as F

    from tidewake.plans.engine import Engine, loads

    t0 = 1788220800  # 2026-09-01
    hours = F.array(*[F.lit(t0 + 3600 * k) for k in range(-12, 6)])
    steady = {"current_velocity": 1.0, "current_direction": 90.0, "wind_speed": 10.0, "wind_direction": 270.0}
    points = spark.range(16).select((F.lit(17.0) + F.floor(F.col("id") / 4)).alias("lat"), (F.lit(70.5) + F.col("id") % 4).alias("lon"), F.struct(hours.alias("time"), *[F.array_repeat(F.lit(v), 18).alias(k) for k, v in steady.items()]).alias("hourly"))
    engine = Engine(spark, str(tmp_path / "cases"), hourly=points)
    case = engine.synthetic_demo(size=200)
    slick = engine.slicks(case)["features"][0]
    job = engine.hindcast(case, slick["id"], hindcast_hours=3, ensemble_members=2, particle_count=50)
    assert engine.store.get("jobs", job)["state"] == "completed", engine.store.get("jobs", job)["error"]
    run = engine.store.latest("hindcast_runs", case)
    metrics = loads(run["metrics"])
    assert metrics["environment"]["source"] == "open_meteo" and [h["step"] for h in metrics["hourly_regions"]] == [0, 4, 8, 12]
    assert len(loads(engine.store.get("env_fields", run["env_field_id"])["metadata"])["checksum"]) == 64
    scene = engine.store.latest("scenes", case)
    assert spark.read.parquet(f"{engine.root}/probabilities/{scene['id']}").where("p_oil > 0.5").count() > 100
    image = engine.preview_png(scene["id"])
    grey = engine.preview(scene["id"])
    at = image.index(b"IDAT")
    assert image.startswith(b"\x89PNG") and zlib.decompress(image[at + 4 :])[1 : 1 + 2 * grey.shape[1] : 2] == grey[0].tobytes()  # with alpha


def test_a_case_from_files(spark, tmp_path):
    """A scene with control points and a NetCDF field, both read from files, lead to an origin."""
    import numpy as np
    from tests.test_files import cdf, mosaic, planted, tiff
    from tidewake.sources import images, synthetic

    image = synthetic.radar_scene(300)
    size = image.shape[0]

    def degrees_of(c, r):
        return 71.6 + 0.5 * c / size + 0.01 * r / size, 18.7 - 0.5 * r / size + 0.01 * c / size

    ties = [v for a in (0, size / 2, size) for b in (0, size / 2, size) for v in (a, b, 0, *degrees_of(a, b), 0)]
    path = str(tmp_path / "S1A_IW_GRDH_20260101T080000_vv.tif")
    tiff(path, image[None].astype(np.float32), ties=ties, keys=(1, 1, 0, 1, 2048, 0, 1, 4326), compression=8, predictor=3)
    e = Engine(spark, str(tmp_path / "store"))
    c = e.create_case("from files", "imported")
    done(e, e.upload_scene(c, path, bounds=[0, 0, 1, 1], detect={"min_area_km2": 0.5}))
    scene = e.store.latest("scenes", c)
    assert "ignored" in scene["metadata"] and scene["acquisition_time"].hour == 8
    slick = e.slicks(c)["features"][0]
    x, y = slick["properties"]["centroid"]
    want = degrees_of(size / 2, size / 2)
    assert abs(x - want[0]) < 0.05 and abs(y - want[1]) < 0.05
    assert e.preview_png(scene["id"])[25] == 4 and (e.preview(scene["id"]) > 0).mean() > 0.5
    e.export_scene(scene["id"], str(tmp_path / "analysis.tif"))
    info = images.describe(str(tmp_path / "analysis.tif"))
    assert info.bounds == pytest.approx(scene["bounds"]) and info.tags["ACQUISITION_START_TIME"] == "2026-01-01T08:00:00Z"
    assert mosaic(spark.read.format("scene").load(str(tmp_path / "analysis.tif")).collect(), (info.height, info.width)).shape == (info.height, info.width)

    dims, variables, _ = planted(("time", "latitude", "longitude"), 2)
    for k, v in {"time": np.arange(4) * 1.0, "latitude": np.array([19.5, 18.5, 17.5]), "longitude": np.array([70.5, 71.5, 72.0, 72.5, 73.5])}.items():
        variables[k] = ([k], v, {"units": "hours since 2026-01-01 05:00:00"} if k == "time" else {})
    cdf(str(tmp_path / "field.nc"), dims, variables, 2)
    env = e.upload_netcdf(c, str(tmp_path / "field.nc"))
    run = done(e, e.hindcast(c, slick["id"], "netcdf_upload", netcdf_env_id=env, hindcast_hours=2, ensemble_members=2, particle_count=60))
    assert run and e.hindcast_run(c)["status"] == "completed"
    e.export_field(env, str(tmp_path / "again.nc"))
    assert spark.read.format("netcdf_field").load(str(tmp_path / "again.nc")).count() == 60
    assert e.job(e.upload_scene(c, str(tmp_path / "none.tif")))["state"] == "failed"
    with pytest.raises(ValueError):
        e.upload_netcdf(c, "x.csv")


def test_sweeps_other_tracks_and_live_counters(case, tmp_path):
    e, c = case
    slick = e.slicks(c)["features"][0]
    swept = e.windage_sweep(c, slick["id"], [(0.0, 0.0), (0.03, 0.03)], "constant", hindcast_hours=3, ensemble_members=2, particle_count=50)
    rows = {(r["scenario"], r["step"]): r for r in swept.collect()}
    last = max(s for _, s in rows)
    assert rows[0, 0]["particles"] == rows[1, last]["particles"] == 100 and rows[1, 5]["low"] == 0.03
    assert abs(rows[0, 0]["lon"] - rows[1, 0]["lon"]) < 1e-3 < abs(rows[0, last]["lon"] - rows[1, last]["lon"])
    with pytest.raises(ValueError):
        e.windage_sweep(c, slick["id"], [(0.5, 0.1)])
    named = {x["mmsi"] for x in e.attribution(c)["candidates"]}
    others = {r["mmsi"] for r in e.other_tracks(c).collect()}
    assert others and not others & named
    done(e, e.forecast(c, slick["id"], 3, "constant", ensemble_members=2, particle_count=60))
    steps = e.get_forecast(c, slick["id"])["steps"]
    assert len(steps) == 4 and all(s["geometry"]["type"] in ("Polygon", "MultiPolygon") and s["geometry"]["coordinates"] for s in steps)
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "1.json").write_text('{"MessageType": "PositionReport", "MetaData": {"MMSI": 419000099, "time_utc": "2026-01-01 00:00:00"}, "Message": {"PositionReport": {"Latitude": 18.0, "Longitude": 72.0}}}')
    got = done(e, e.record_live(c, str(folder), [71, 17, 73, 19]))
    assert got and e.live_counters(c)["vessels"] == 1
    with pytest.raises(config.NotFound):
        e.live_counters("case_none")
