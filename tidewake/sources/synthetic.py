"""Planted scenarios: vessel traffic around a release, and a radar scene with one slick."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.sources.ais_csv import COLUMNS

SUSPECT, DECOY, BACKGROUND = 419001001, 419001002, 419002000
KNOT = 0.514444


def traffic(spark: SparkSession, origin: tuple[float, float], release: float, n_background: int = 12, seed: int = 3) -> DataFrame:
    """Canonical string columns: a suspect with a 40-minute silence at the release, a faster decoy
    20 km north, vessels far away, and two bad rows.  Positions are closed form along each course."""
    lon0, lat0 = origin
    rng = np.random.default_rng(seed)
    cos0 = float(np.cos(np.radians(lat0)))
    back = 10.0 * KNOT * 3 * 3600 / 111320 * float(np.sqrt(0.5))
    specs = [
        (SUSPECT, "SYNTH TANKER A", "tanker", lon0 - back / cos0, lat0 - back, 45.0, 10.0, release - 3 * 3600.0, 6 * 3600.0, 120, release - 1200, release + 1200),
        (DECOY, "SYNTH CARGO B", "cargo", lon0 - back / cos0, lat0 - back + 0.18, 45.0, 12.0, release - 3 * 3600.0, 6 * 3600.0, 120, 0.0, 0.0),
    ]
    for k in range(n_background):
        x, y = rng.uniform(-0.8, 0.8, 2)
        x += 0.5 if abs(x) < 0.25 and abs(y) < 0.25 else 0.0
        kind = str(rng.choice(["cargo", "fishing", "container", "tanker"]))
        specs.append((BACKGROUND + k, f"SYNTH BG {k}", kind, float(lon0 + x), float(lat0 + y), float(rng.uniform(0, 360)), float(rng.uniform(4, 14)), release - 3600 * float(rng.uniform(2, 6)), 3600 * float(rng.uniform(3, 7)), 300, 0.0, 0.0))
    table = spark.createDataFrame(specs, "mmsi long, name string, type string, lon double, lat double, course double, knots double, start double, length double, every int, mute_from double, mute_to double")
    t = F.col("start") + F.col("i") * F.col("every")
    rows = table.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / F.col("every")).cast("int") - 1))).withColumn("t", t)
    rows = rows.where((F.col("mute_to") == 0) | ~F.col("t").between(F.col("mute_from"), F.col("mute_to")))
    away = (F.col("i") + 1) * F.col("every") * F.col("knots") * KNOT
    lat = F.col("lat") + away * F.cos(F.radians("course")) / 111320
    lon = F.col("lon") + away * F.sin(F.radians("course")) / (111320 * F.cos(F.radians((F.col("lat") + lat) / 2)))
    wobble = (F.pmod(F.xxhash64(F.lit(seed), "mmsi", "i"), F.lit(2001)) - 1000) / 1e8
    good = rows.select(
        F.col("mmsi").cast("string").alias("mmsi"), F.date_format(F.timestamp_micros((F.col("t") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"),
        F.format_string("%.6f", lon + wobble).alias("longitude"), F.format_string("%.6f", lat + wobble).alias("latitude"), F.format_string("%.1f", "knots").alias("sog_knots"),
        F.format_string("%.0f", "course").alias("cog_deg"), F.format_string("%.0f", "course").alias("heading_deg"), F.col("name").alias("vessel_name"), F.col("type").alias("vessel_type"), F.lit("180").alias("length_m"), F.lit("synthetic").alias("source"),
    )
    bad = [("12", "not-a-time", "999", "0", "", "", "", "BAD", "", "", "synthetic"), ("419009999", "2026-08-31T19:00:00Z", "0", "0", "", "", "", "NULL ISLAND", "", "", "synthetic")]
    return good.unionByName(spark.createDataFrame(bad, ", ".join(f"{c} string" for c in COLUMNS)))


def radar_scene(size: int = 800, seed: int = 7) -> np.ndarray:
    """Speckle with a dark slanted ellipse and a bright corner, as power."""
    rng = np.random.default_rng(seed)
    image = rng.gamma(4.0, 0.02, (size, size))
    y, x = np.mgrid[0:size, 0:size]
    a = np.radians(35)
    dx, dy = x - size / 2, y - size / 2
    u, v = dx * np.cos(a) + dy * np.sin(a), -dx * np.sin(a) + dy * np.cos(a)
    image[(u / (0.22 * size)) ** 2 + (v / (0.03 * size)) ** 2 <= 1] *= 0.18
    image[: size // 10, : size // 10] *= 6
    return image.astype(np.float32)
