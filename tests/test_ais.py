import json
import os

import pytest
from pyspark.sql import functions as F

from tidewake.operators import attribution, tracks
from tidewake.sources import ais_csv, registry, synthetic
from tidewake.streaming import recorder


def test_quarantine_of_a_provider_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,VesselType\n"
        "419000001,2026-01-01T00:00:00,18.5,72.1,10.0,45.0,44,GOOD,Tanker\n419000002,2026-01-01T00:05:00,18.6,72.2,9.0,361,511,GOOD2,cargo\n"
        "12,2026-01-01T00:00:00,18.5,72.1,,,,X,\n419000003,never,18.5,72.1,,,,Y,\n419000004,2026-01-01T00:00:00,95,72.1,,,,Z,\n")
    got = ais_csv.load(spark, str(path), "c", "i", "label", "imported")
    assert (got.summary["rows_valid"], got.summary["rows_quarantined"]) == (2, 3)
    assert got.summary["reasons"] == {"invalid_mmsi": 1, "unparseable_timestamp": 1, "invalid_position": 1}
    assert [q["row"] for q in got.summary["quarantine_sample"]] == [4, 5, 6]
    rows = got.positions.orderBy("mmsi").collect()
    assert rows[1]["heading"] is None and rows[1]["cog"] is None and rows[0]["vessel_type"] == "tanker" and rows[0]["source"] == "label"


def test_epochs_month_first_and_synthetic_sources(spark, tmp_path):
    for name, stamps in (("ms", ["1767225600000", "1767225660000"]), ("s", ["1767225600", "1767225660"]), ("us", ["1/1/2026 0:00", "1/1/2026 0:01"])):
        path = tmp_path / f"{name}.csv"
        path.write_text("mmsi;time;x;y;source\n" + "".join(f"41900000{i};{t};72;18;SYNTHetic\n" for i, t in enumerate(stamps, 1)))
        got = ais_csv.load(spark, str(path), "c", "i", "label", "imported")
        assert got.summary["data_mode"] == "synthetic" and got.summary["rows_valid"] == 2
        assert [r["ts_epoch"] for r in got.positions.orderBy("mmsi").collect()] == [1767225600.0, 1767225660.0]


def test_missing_columns_and_too_many_rows(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("mmsi,lat\n1,2\n3,4\n")
    with pytest.raises(ValueError, match="missing"):
        ais_csv.load(spark, str(path), "c", "i", "label", "imported")
    with pytest.raises(ValueError, match="more than 1"):
        ais_csv.read_csv(spark, str(path), max_rows=1)


def test_the_limit_of_rows_is_one_of_uploads(spark, tmp_path):
    """What Spark wrote itself is read whole; an uploaded file still has its limit."""
    path = tmp_path / "c.csv"
    spark.range(2_000_001).selectExpr("419000001 as mmsi", "'2026-01-01T00:00:00Z' as time", "72 as lon", "18 as lat").write.option("header", True).csv(str(path))
    assert ais_csv.read_csv(spark, str(path)).count() == 2_000_001
    with pytest.raises(ValueError, match="more than 2000000"):
        ais_csv.load(spark, str(path), "c", "i", "label", "imported")


def test_type_priors(spark):
    names = ["tanker", " Crude Oil Tanker ", "LNG tanker", "85", "72", "30", "99", None, "yacht", "bulk carrier x"]
    frame = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r[0] for r in frame.select(attribution.type_prior(F.col("t"))).collect()] == [1.0, 1.0, 1.0, 1.0, 0.7, 0.4, 0.5, 0.5, 0.5, 0.7]


def brute(rows, rs, re_, inside):
    """Gaps, dwell and expected interval of small tracks, fix by fix."""
    by = {}
    for m, t, lon, lat, sog in sorted(rows):
        by.setdefault(m, []).append((t, lon, lat, sog))
    medians = []
    for v in by.values():
        steps = sorted(b[0] - a[0] for a, b in zip(v, v[1:], strict=False) if b[0] > a[0])
        if len(v) > 3 and steps:
            medians.append((steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2)
    medians.sort()
    expected = (medians[(len(medians) - 1) // 2] + medians[len(medians) // 2]) / 2 if medians else 300.0
    gaps, dwell = [], {}
    for m, v in by.items():
        total = 0.0
        for i, (t, lon, lat, _) in enumerate(v):
            if i + 1 < len(v) and v[i + 1][0] - t > max(4 * expected, 1200):
                gaps.append((m, t, max(0.0, min(v[i + 1][0], re_) - max(t, rs))))
            if rs <= t <= re_ and inside(lon, lat):
                total += 0.5 * (min(v[i + 1][0] if i + 1 < len(v) else t, re_) - max(v[i - 1][0] if i else t, rs))
        dwell[m] = max(0.0, min(total, re_ - rs))
    return expected, sorted(gaps), dwell


def test_track_operators_against_plain_loops(spark):
    import random

    random.seed(5)
    rows = [(m, float(random.randrange(0, 40000, 10)), random.uniform(0, 2), random.uniform(0, 2), random.uniform(0, 5)) for m in range(1, 7) for _ in range(random.randrange(1, 25))]
    rows = sorted({(m, t): r for r in rows for m, t in [r[:2]]}.values())
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "mmsi long, ts_epoch double, lon double, lat double, sog double, seq long")
    box = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    steps = tracks.with_steps(frame)
    expected, gaps, dwell = brute(rows, 5000.0, 30000.0, lambda x, y: 0 < x < 1 and 0 < y < 1)
    one = tracks.expected_interval_s(steps)
    assert one.first()[0] == expected
    assert sorted((r["mmsi"], r["ts_epoch"], r["overlap_s"]) for r in tracks.gaps(steps, one, (5000.0, 30000.0)).collect()) == gaps
    from tidewake.functions.geo import in_ring

    got = {r["mmsi"]: r["dwell_s"] for r in tracks.dwell_s(steps, in_ring(F.col("lon"), F.col("lat"), box), (5000.0, 30000.0)).collect()}
    assert got.keys() == dwell.keys() and all(abs(got[m] - dwell[m]) < 1e-6 for m in dwell)


def test_planted_suspect_ranks_first(spark, tmp_path):
    release = 1788202800.0
    origin = (71.875, 18.45)
    path = str(tmp_path / "traffic")
    synthetic.traffic(spark, origin, release).coalesce(1).write.option("header", True).csv(path)
    got = ais_csv.load(spark, path, "c", "i", "x", "imported")
    assert got.summary["rows_quarantined"] == 2 and got.summary["data_mode"] == "synthetic" and got.summary["vessels"] == 14
    around = [(origin[0] + a, origin[1] + b) for a, b in ((-0.05, -0.05), (0.05, -0.05), (0.05, 0.05), (-0.05, 0.05), (-0.05, -0.05))]
    spill = attribution.Hindcast(around, around, around, release - 3600, release + 3600)
    positions = got.positions.withColumn("seq", F.monotonically_increasing_id())
    result = attribution.attribute(positions, spill, (71.9, 18.5), release + 6 * 3600)
    scores = result.scores.orderBy("rank").collect()
    rank = {r["mmsi"]: r["rank"] for r in scores}
    assert scores[0]["mmsi"] == synthetic.SUSPECT and rank[synthetic.SUSPECT] < rank[synthetic.DECOY]
    assert scores[0]["n_gaps"] == 1 and scores[0]["priority"] in ("medium", "high")
    for r in scores:
        assert all(0 <= r[k] <= 1 for k in (*attribution.FACTORS, "data_quality"))
    again = attribution.rescored(result.scores, {"loitering": 5.0}).collect()
    assert len(again) == len(scores) and sorted(r["new_rank"] for r in again) == list(range(1, len(again) + 1))
    gone = attribution.attribute(positions, spill, (71.9, 18.5), release + 6 * 3600, excluded=(synthetic.SUSPECT,))
    assert synthetic.SUSPECT not in {r["mmsi"] for r in gone.scores.select("mmsi").collect()}
    assert {r["mmsi"]: r["decision"] for r in gone.decisions.collect()}[synthetic.SUSPECT] == "excluded_by_analyst"


def test_registry(spark):
    reg = spark.createDataFrame([(1, None, "OWN", "IN", "9", "C", 2), (1, "REG", "OWN", "PA", "8", "D", 1), (2, "TWO", None, "LR", "7", "E", 1)], registry.COLUMNS)
    cand = spark.createDataFrame([(1, None, 5.0), (3, "N", 4.0)], "mmsi long, vessel_name string, score double")
    got = {r["mmsi"]: r for r in registry.enrich(cand, reg).collect()}
    assert got[1]["vessel_name"] == "REG" and got[1]["flag"] == "PA" and got[3]["flag"] is None and got[3]["score"] == 4.0
    assert [r["imo"] for r in registry.search(reg, "two").collect()] == ["7"]


def message(kind, mmsi, time="2026-01-01 00:00:00.123 +0000 UTC", **body):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "ShipName": "META ", "time_utc": time}, "Message": {kind: body}})


def test_recorder_replay(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text("\n".join([
        message("PositionReport", 1, Latitude=1.0, Longitude=2.0, Sog=102.3, Cog=360.0, TrueHeading=511),
        message("PositionReport", 0, Latitude=1.0, Longitude=2.0), message("PositionReport", 2, Latitude=0.0, Longitude=0.0)]))
    (feed / "2.json").write_text(message("ShipStaticData", 1, time="2026-01-01 00:01:00", Name="ONE", Type=81, Dimension={"A": 100, "B": 50}))
    (feed / "3.json").write_text(message("PositionReport", 1, time="2026-01-01 00:02:00", Latitude=1.1, Longitude=2.0, Sog=9.0, Cog=10.0, TrueHeading=11))
    for n in (1, 2, 3):  # files are taken by age
        os.utime(feed / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    got = recorder.record(spark, str(feed), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = got["positions_frame"].orderBy("ts").collect()
    assert (got["positions"], got["vessels"], got["static_vessels"]) == (2, 1, 1)
    assert rows[0]["sog"] is None and rows[0]["cog"] is None and rows[0]["heading"] is None and rows[1]["sog"] == 9.0
    assert [r["vessel_type"] for r in rows] == ["tanker", "tanker"] and rows[1]["vessel_name"] == "ONE" and rows[0]["length_m"] == 150


def test_all_files_are_one_batch_in_their_order(spark, tmp_path):
    """Every batch visits the state of its vessels, so files don't each make one; positions still get what came before them."""
    feed, out = tmp_path / "feed", tmp_path / "out"
    feed.mkdir()
    place = {"Latitude": 1.0, "Longitude": 2.0}
    for i, name in enumerate((None, "A", None, "B", None)):
        text = message("ShipStaticData", 5, Name=name, Type=80) if name else message("PositionReport", 5, **place | {"Latitude": float(i)})
        (feed / f"{9 - i}.json").write_text(text.replace("META ", ""))
        os.utime(feed / f"{9 - i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    recorder.record(spark, str(feed), str(out), str(tmp_path / "cp"))
    assert {r["lat"]: r["vessel_name"] for r in spark.read.parquet(str(out)).collect()} == {0.0: None, 2.0: "A", 4.0: "B"}
    assert len(list((tmp_path / "cp" / "commits").glob("[0-9]*"))) == 1
