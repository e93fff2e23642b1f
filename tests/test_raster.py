import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions.geo import centroid
from tidewake.operators import land, raster
from tidewake.sources import scenes, synthetic


def test_tiles_cover_and_end_flush():
    for n in (100, 512, 700, 1500):
        spans = raster.spans(n, 512, 64)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))


def flood(mask):
    seen, n = np.zeros(mask.shape, int), 0
    for r, c in np.argwhere(mask):
        if not seen[r, c]:
            n += 1
            todo = [(r, c)]
            while todo:
                i, j = todo.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not seen[i, j]:
                    seen[i, j] = n
                    todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return seen, n


def test_labels_against_flood_fill():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.4, 0.6):
        mask = rng.random((64, 64)) < share
        a, n = raster.labelled(mask)
        b, m = flood(mask)
        assert n == m and len(set(zip(a[mask].tolist(), b[mask].tolist(), strict=True))) == n


def test_components_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(raster, "BLOCK", 16)
    rng = np.random.default_rng(4)
    mask = rng.random((50, 50)) < 0.35
    px = spark.createDataFrame([("s", int(r), int(c), 0.9, None, "oil") for r, c in np.argwhere(mask)], "scene_id string, row int, col int, p_oil double, p_la double, class string")
    got = raster.components(px).toPandas()
    want, n = flood(mask)
    assert got["region"].nunique() == n and len({(g, want[r, c]) for g, r, c in zip(got["region"], got["row"], got["col"], strict=True)}) == n


def test_blend_of_one_tile_is_itself(spark):
    image = np.random.default_rng(2).random((40, 30)).astype(np.float32)
    rows = [("s", r0, c0, r1 - r0, c1 - c0, image[r0:r1, c0:c1].ravel().tolist(), None) for r0, r1 in raster.spans(40, 20, 8) for c0, c1 in raster.spans(30, 20, 8)]
    out = raster.mosaic(spark.createDataFrame(rows, raster.PROBABILITIES)).toPandas()
    assert len(out) == 1200 and np.allclose(out["p_oil"], image[out["row"], out["col"]], atol=1e-6)


def test_planted_slick_is_found(spark):
    size, bounds = 360, (72.0, 18.4, 72.5, 18.9)
    model = raster.Classical(raster.DEFAULTS["detection"]["classical"] | {"tile_size": 256, "tile_overlap": 64})
    tiles = raster.tile_table(spark, "s", synthetic.radar_scene(size), model.tile_size, model.tile_overlap)
    found = raster.detect(tiles, (size, size), bounds, model, {"min_area_km2": 2.0})
    assert found and found[0]["class"] == "oil" and found[0]["rank"] == 1
    assert np.allclose(found[0]["centroid"], (72.25, 18.65), atol=0.05) and np.allclose(centroid(found[0]["ring"]), (72.25, 18.65), atol=0.05)


def test_decibels_rules():
    assert raster.to_db(np.array([[-1.0, 0.0]]))[0, 0] == -1
    assert raster.to_db(np.array([[0.1, 1.0]]))[0, 0] == pytest.approx(-10)
    assert raster.to_db(np.array([[10.0, 100.0]]))[0, 1] == pytest.approx(40)
    assert raster.to_db(np.array([[10.5, 100.0]]))[0, 1] == pytest.approx(20) and np.isnan(raster.to_db(np.array([[0.0, 5.0]]))[0, 0])


def test_onnx_needs_its_file():
    with pytest.raises(ValueError):
        raster.adapter("onnx", "/nowhere.onnx")
    assert raster.adapter("auto", "/nowhere.onnx").name == "classical"


def test_land(spark):
    island = [(10.0, 10.0), (13.0, 10.0), (13.0, 13.0), (10.0, 13.0), (10.0, 10.0)]
    lake = [(11.0, 11.0), (11.0, 12.0), (12.0, 12.0), (12.0, 11.0), (11.0, 11.0)]
    pieces = land.pieces(spark, [[island, lake]]).cache()
    pts = [(10.5, 10.5), (11.5, 11.5), (9.0, 10.5), (12.5, 12.5), (370.5, 10.5), (12.5, 11.5)]
    got = land.on_land(spark.createDataFrame(pts, "lon double, lat double"), pieces).orderBy("lon", "lat").collect()
    want = {(10.5, 10.5): True, (11.5, 11.5): False, (9.0, 10.5): False, (12.5, 12.5): True, (370.5, 10.5): True, (12.5, 11.5): True}
    assert {(r["lon"], r["lat"]): r["on_land"] for r in got} == want
    index = land.LandIndex(pieces)
    assert index.distance_km(10.5, 10.5) == 0 and 20 < index.distance_km(9.8, 11.0) < 23 and index.distance_km(0.0, 0.0) == 50
    assert land.on_land(spark.createDataFrame(pts, "lon double, lat double"), None).where("on_land").count() == 0


def test_scene_metadata(spark):
    with pytest.raises(scenes.SceneInvalid, match="bounds"):
        scenes.metadata(spark, "a.png", None, (10, 10))
    m = scenes.metadata(spark, "a.png", [72.0, 18.0, 72.3, 18.3], (300, 300))
    assert m["warnings"] and m["time_source"] == "assumed_now" and 100 < m["pixel_size_m"][0] < 120
    small, factor = scenes.reduced(np.ones((90, 50)), 40)
    assert factor == 3 and small.shape == (30, 16) and scenes.preview(np.zeros((3, 3), np.float32)).shape == (3, 3)


def test_catalogue(spark):
    rows = [(f"i{k}", "sentinel-1-grd", None, 70.0 + k, 18.0, 71.0 + k, 19.0, "S1", "IW", ["VV"], "asc", "x") for k in range(3)]
    items = spark.createDataFrame(rows, scenes.CATALOGUE).withColumn("acquired", F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,cast(substr(item_id,2) as int))"))
    got = scenes.search(items, [70.5, 18.2, 71.5, 18.4], "2026-01-01", "2026-02-01")
    assert [r["item_id"] for r in got.collect()] == ["i1", "i0"]
