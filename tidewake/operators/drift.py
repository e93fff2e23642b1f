"""Particle drift: seeding, perturbed ensemble members, integration, and the forward forecast."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS, DriftParams
from tidewake.functions.geo import Ring, convex_hull, geodesic_area_km2, inside
from tidewake.operators.density import CONTROL, grid_of, histogram, mass_cells, region_area, step_regions
from tidewake.sources.fields import Grid

PARTICLES = "member int, particle int, step int, epoch double, lon double, lat double, stranded boolean"
LAND_EVERY = 4
Land = Callable[[np.ndarray, np.ndarray], np.ndarray]


def seed_points(ring: Ring, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n points in the polygon, the same for a seed; a polygon too thin to hit gives the mean of its vertices."""
    xs, ys = np.array([p[0] for p in ring]), np.array([p[1] for p in ring])
    rng = np.random.default_rng(seed)
    lon, lat = np.zeros(0), np.zeros(0)
    for _ in range(200):
        x, y = rng.uniform(xs.min(), xs.max(), 2 * n), rng.uniform(ys.min(), ys.max(), 2 * n)
        hit = inside(x, y, ring)
        lon, lat = np.concatenate([lon, x[hit]]), np.concatenate([lat, y[hit]])
        if len(lon) >= n:
            return lon[:n], lat[:n]
    return np.full(n, xs.mean()), np.full(n, ys.mean())


def members(spark: SparkSession, p: DriftParams) -> DataFrame:
    """The control run and the perturbed members: windage, current scale, turn of the current, wind factor."""
    rows = [(CONTROL, float(np.mean(p.windage_range)), 1.0, 0.0, 1.0)]
    for m in range(p.ensemble_members):
        rng = np.random.default_rng([p.seed, m])
        rows.append((m, rng.uniform(*p.windage_range), rng.uniform(*p.current_scale_range), rng.normal(0, p.current_direction_jitter_deg), max(0.2, rng.normal(1, p.wind_speed_jitter_frac))))
    return spark.createDataFrame(rows, "member int, windage double, current_scale double, turn_deg double, wind_factor double")


def _metres(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.radians(lat)
    return np.maximum(111412.84 * np.cos(p) - 93.5 * np.cos(3 * p) + 0.118 * np.cos(5 * p), 1.0), 111132.92 - 559.82 * np.cos(2 * p) + 1.175 * np.cos(4 * p) - 0.0023 * np.cos(6 * p)


def run_member(row: pd.Series, ring: Ring, field: Grid, t0: float, p: DriftParams, land: Land | None) -> Iterator[pd.DataFrame]:
    """One member's particles, a frame for each step.

    The control run has neither diffusion nor coast.  Others meet the coast at
    every fourth step: a particle found on land stays where it was before.
    """
    member = int(row["member"])
    control = member == CONTROL
    lon, lat = seed_points(ring, p.particle_count, p.seed)
    turn = np.radians(row["turn_deg"])
    rng = np.random.default_rng([p.seed, 1 + abs(member), 7])
    dead = np.zeros(len(lon), bool)
    sigma = 0.0 if control else np.sqrt(2 * p.diffusion_m2_s * abs(p.dt))

    def velocity(x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        uc, vc, uw, vw = field.sample(x, y, t)
        east = row["current_scale"] * (uc * np.cos(turn) - vc * np.sin(turn)) + row["windage"] * row["wind_factor"] * uw
        north = row["current_scale"] * (uc * np.sin(turn) + vc * np.cos(turn)) + row["windage"] * row["wind_factor"] * vw
        mx, my = _metres(y)
        return east / mx, north / my

    def advance(x: np.ndarray, y: np.ndarray, t: float, h: float) -> tuple[np.ndarray, np.ndarray]:
        k1 = velocity(x, y, t)
        if p.integrator == "euler":
            return x + h * k1[0], y + h * k1[1]
        k2 = velocity(x + h / 2 * k1[0], y + h / 2 * k1[1], t + h / 2)
        k3 = velocity(x + h / 2 * k2[0], y + h / 2 * k2[1], t + h / 2)
        k4 = velocity(x + h * k3[0], y + h * k3[1], t + h)
        return tuple(a + h / 6 * (b + 2 * c + 2 * d + e) for a, b, c, d, e in zip((x, y), k1, k2, k3, k4, strict=True))

    for step in range(p.n_steps + 1):
        t = t0 + step * p.dt
        if step:
            x, y = advance(lon, lat, t - p.dt, p.dt)
            if sigma:
                mx, my = _metres(y)
                x, y = x + rng.normal(0, sigma, len(x)) / mx, y + rng.normal(0, sigma, len(y)) / my
            if land is not None and not control and step % LAND_EVERY == 0:
                dead |= land(x, y)
            lon, lat = np.where(dead, lon, x), np.where(dead, lat, y)
        yield pd.DataFrame({"member": np.int32(member), "particle": np.arange(len(lon), dtype=np.int32), "step": np.int32(step), "epoch": t, "lon": lon, "lat": lat, "stranded": dead.copy()})


def integrate(spark: SparkSession, ring: Ring, field: Grid, t0: float, p: DriftParams, land: Land | None = None) -> DataFrame:
    """All members' particles, one task a member; same seed, same particles, wherever they run."""
    held = spark.sparkContext.broadcast(field)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                yield from run_member(row, ring, held.value, t0, p, land)

    return members(spark, p).repartition(p.ensemble_members + 1, "member").mapInPandas(run, PARTICLES)


def windage_sweep(spark: SparkSession, ring: Ring, field: Grid, t0: float, p: DriftParams, ranges: list[tuple[float, float]], land: Land | None = None) -> DataFrame:
    """``integrate`` for several windage ranges in one job: particles with ``scenario``, the range's number."""
    held = spark.sparkContext.broadcast(field)
    each = [replace(p, windage_range=tuple(r)) for r in ranges]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                n = int(row["scenario"])
                for out in run_member(row, ring, held.value, t0, each[n], land):
                    yield out.assign(scenario=np.int32(n))

    rows = [m.withColumn("scenario", F.lit(n)) for n, m in enumerate(members(spark, q) for q in each)]
    return reduce(DataFrame.unionByName, rows).repartition(len(ranges) * (p.ensemble_members + 1), "scenario", "member").mapInPandas(run, PARTICLES + ", scenario int")


def sampled_particles(particles: DataFrame, n: int, seed: int) -> DataFrame:
    """The same n particles at every step, picked by a seeded hash."""
    chosen = particles.where((F.col("member") != CONTROL) & (F.col("step") == 0)).select("member", "particle").orderBy(F.xxhash64(F.lit(seed), "member", "particle"), "member", "particle").limit(n)
    return particles.join(F.broadcast(chosen), ["member", "particle"])


def shown_steps(p: DriftParams, per_hour: int = 2) -> list[int]:
    """Steps about every half hour, and the last."""
    every = max(1, max(1, round(60 / p.time_step_minutes)) // per_hour)
    return sorted({*range(0, p.n_steps + 1, every), p.n_steps})


def space_time_cloud(particles: DataFrame, p: DriftParams, n: int = 300) -> tuple[DataFrame, float, float, float]:
    """((step, k, lon, lat) with times rising, first time, step, last time) for matching tracks."""
    few = sampled_particles(particles, n, p.seed + 1)
    back = p.dt < 0
    step = F.lit(p.n_steps) - F.col("step") if back else F.col("step")
    ends = particles.agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).first()
    return few.select(step.alias("step"), F.xxhash64("member", "particle").alias("k"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat")), ends["a"], abs(p.dt), ends["b"]


def forecast(particles: DataFrame, p: DriftParams, cells: int = DEFAULTS["hindcast"]["origin_window"]["density_grid_cells"]) -> dict:
    """Hourly regions with their outlines, the swept hull, the stranded share, and whether the coast is at risk."""
    ens = particles.where(F.col("member") != CONTROL).cache()
    grid = grid_of(ens, cells)
    hourly = max(1, round(60 / p.time_step_minutes))
    at = ens.where(F.col("step") % hourly == 0)
    areas = region_area(mass_cells(histogram(at, grid, "step"), "step"), p.probability_mass, grid["cell_km2"], "step")
    steps = areas.join(at.groupBy("step").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.min("epoch").alias("epoch")), "step").orderBy("step")
    stranded = ens.agg(F.avg(F.col("stranded").cast("double"))).first()[0]
    hull = swept_hull(at.where((F.col("particle") + F.col("member")) % 7 == 0))
    outlines = {r["step"]: r["rings"] for r in step_regions(ens, grid, p.probability_mass, hourly)}
    return {"steps": [r.asDict() | {"rings": outlines.get(r["step"], [])} for r in steps.collect()], "envelope": hull, "envelope_area_km2": geodesic_area_km2(hull) if len(hull) > 2 else 0.0, "stranded_fraction": stranded, "coastal_impact_risk": stranded > 0.02, "grid": grid}


def swept_hull(points: DataFrame) -> Ring:
    """Convex hull of all points: a hull in each task, and the hull of those on the driver."""

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Ring = []
        for f in frames:
            seen = convex_hull([*seen, *zip(f["lon"].tolist(), f["lat"].tolist(), strict=True)])
        if seen:
            yield pd.DataFrame(seen, columns=["lon", "lat"])

    return convex_hull([(r["lon"], r["lat"]) for r in points.select("lon", "lat").mapInPandas(local, "lon double, lat double").collect()])


def aoi_padding(hours: float) -> float:
    """Degrees of field to fetch around a slick for a drift of so many hours."""
    return min(3.0, 0.02 + hours * 3600 / 111000)
