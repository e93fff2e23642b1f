"""Particle density: grid counts, highest-density regions, convergence, and the release window."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS
from tidewake.functions.geo import Ring, cells_outline, geodesic_area_km2, metres_per_degree, metres_per_degree_at

CONTROL = -1


def grid_of(particles: DataFrame, cells: int = 60) -> dict[str, float]:
    """Extent with 5 % around it, at least 0.002 degrees, as cells x cells."""
    e = particles.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")).first()
    px, py = max((e["x1"] - e["x0"]) * 0.05, 0.002), max((e["y1"] - e["y0"]) * 0.05, 0.002)
    dx, dy = (e["x1"] - e["x0"] + 2 * px) / cells, (e["y1"] - e["y0"] + 2 * py) / cells
    mx, my = metres_per_degree_at((e["y0"] + e["y1"]) / 2)
    return {"x0": e["x0"] - px, "y0": e["y0"] - py, "dx": dx, "dy": dy, "cells": cells, "cell_km2": dx * mx * dy * my / 1e6}


def cell(value: Column, origin: float, size: float, cells: int) -> Column:
    """Cell number; the last cell holds its upper edge."""
    return F.least(F.floor((value - origin) / size), F.lit(cells - 1)).cast("int")


def histogram(particles: DataFrame, grid: dict[str, float], *by: str) -> DataFrame:
    """Counts by ``by`` and cell: one partial aggregation, no rows but occupied cells."""
    ix = cell(F.col("lon"), grid["x0"], grid["dx"], grid["cells"])
    iy = cell(F.col("lat"), grid["y0"], grid["dy"], grid["cells"])
    return particles.groupBy(*by, ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("n"))


def mass_cells(counts: DataFrame, *by: str) -> DataFrame:
    """Cells in order of count with ``before``, the share of mass in denser cells.

    The smallest region of mass m is the cells with before < m, ties by cell.
    """
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.desc("n"), "ix", "iy").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("before", (F.sum("n").over(order) - F.col("n")) / F.sum("n").over(whole)).withColumn("share", F.col("n") / F.sum("n").over(whole))


def region_area(cells: DataFrame, mass: float, cell_km2: float, *by: str) -> DataFrame:
    return cells.where(F.col("before") < mass).groupBy(*by).agg((F.count("*") * cell_km2).alias("area_km2"), F.max("share").alias("peak_density"))


def region_polygon(cells: DataFrame, mass: float, grid: dict[str, float]) -> tuple[list[Ring], float]:
    """Outline of a region and its area; at most grid cells squared rows come to the driver."""
    chosen = {(r["ix"], r["iy"]) for r in cells.where(F.col("before") < mass).select("ix", "iy").collect()}
    rings = cells_outline(chosen, grid["x0"], grid["y0"], grid["dx"], grid["dy"])
    area = abs(sum(geodesic_area_km2(r) * (1 if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r[:-1], r[1:], strict=True)) > 0 else -1) for r in rings))
    return rings, area


def step_regions(particles: DataFrame, grid: dict[str, float], mass: float, every: int) -> list[dict]:
    """The region of a mass at every so many steps and at the last, outlined; only its cells come to the driver."""
    ensemble = particles.where(F.col("member") != CONTROL)
    last = F.broadcast(ensemble.agg(F.max("step").alias("__last")))
    shown = ensemble.join(last).where((F.col("step") % every == 0) | (F.col("step") == F.col("__last")))
    cells = mass_cells(histogram(shown, grid, "step"), "step").where(F.col("before") < mass)
    rows = cells.groupBy("step").agg(F.collect_list(F.struct("ix", "iy")).alias("cells")).orderBy("step").collect()
    return [{"step": r["step"], "rings": cells_outline({(c["ix"], c["iy"]) for c in r["cells"]}, grid["x0"], grid["y0"], grid["dx"], grid["dy"])} for r in rows]


def step_metrics(particles: DataFrame, grid: dict[str, float], mass: float, cfg: dict = DEFAULTS["hindcast"]["origin_window"]) -> DataFrame:
    """One row a step: region area, spread of member means, control-run area, convergence and agreement.

    ``particles`` is (member, particle, step, epoch, lon, lat, stranded); member
    CONTROL is the unperturbed run.
    """
    ensemble = particles.where(F.col("member") != CONTROL)
    areas = region_area(mass_cells(histogram(ensemble, grid, "step"), "step"), mass, grid["cell_km2"], "step")
    means = ensemble.groupBy("step", "member").agg(F.avg("lon").alias("cx"), F.avg("lat").alias("cy"), F.sum("lon").alias("sx"), F.sum("lat").alias("sy"), F.count("*").alias("n"))
    middle = means.groupBy("step").agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"), F.count("*").alias("members"), (F.sum("sx") / F.sum("n")).alias("lon"), (F.sum("sy") / F.sum("n")).alias("lat"))
    per_lon, per_lat = metres_per_degree(F.col("my"))
    apart = F.sqrt(F.pow((F.col("cx") - F.col("mx")) * per_lon, 2.0) + F.pow((F.col("cy") - F.col("my")) * per_lat, 2.0)) / 1000
    spread = means.select("step", "cx", "cy").join(middle, "step").groupBy("step", "members", "lon", "lat", "my").agg(F.avg(apart).alias("spread_km"))
    control = particles.where(F.col("member") == CONTROL).groupBy("step").agg(
        F.var_samp("lon").alias("vx"), F.var_samp("lat").alias("vy"), F.covar_samp("lon", "lat").alias("vxy"), F.min("epoch").alias("epoch"))
    kx, ky = metres_per_degree(F.col("my"))
    det = (F.col("vx") * F.col("vy") - F.pow("vxy", 2.0)) * F.pow(kx * ky, 2.0)
    rows = control.join(spread, "step").join(areas, "step").select(
        "step", "epoch", "lon", "lat", "peak_density", F.greatest("area_km2", F.lit(grid["cell_km2"])).alias("area_km2"), F.when(F.col("members") > 1, F.col("spread_km")).otherwise(0.0).alias("spread_km"),
        F.greatest(3.141592653589793 * F.sqrt(F.greatest(det, F.lit(1e-6))) / 1e6, F.lit(1e-4)).alias("control_area_km2"))
    return convergence(rows, cfg)


def convergence(rows: DataFrame, cfg: dict = DEFAULTS["hindcast"]["origin_window"]) -> DataFrame:
    """Adds hours, convergence (first control area over each), agreement and score by step."""
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("control_area_km2").over(w)
    hours = F.abs(F.col("epoch") - F.first("epoch").over(w)) / 3600
    out = rows.withColumn("hours", hours).withColumn("convergence", first / F.col("control_area_km2"))
    out = out.withColumn("agreement", 1 / (1 + F.col("spread_km") / max(float(cfg["agreement_scale_km"]), 0.1)))
    return out.withColumn("score", F.when(F.col("hours") >= cfg["min_age_hours"], F.greatest(F.col("convergence") - 1, F.lit(0.0))).otherwise(0.0))


def peak_island(steps: DataFrame, fraction: float = 0.5, least: float = 0.15, min_age: float = 0.5) -> DataFrame:
    """(lo, hi, peak): the run of steps around the best score that stay above a fraction of it; empty if the best is under ``least``."""
    best = steps.agg(F.max(F.struct("score", (-F.col("step")).alias("back"))).alias("b")).select((-F.col("b.back")).alias("peak"), F.col("b.score").alias("top"))
    order = Window.orderBy("step")
    joined = steps.join(F.broadcast(best)).where(F.col("top") >= least)
    high = (F.col("score") >= fraction * F.col("top")) & ((F.col("hours") >= min_age) | (F.col("step") >= F.col("peak")))
    marked = joined.withColumn("high", high.cast("int")).withColumn("island", F.sum(1 - F.col("high")).over(order)).where("high = 1")
    runs = marked.groupBy("island", "peak").agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    return runs.where("peak between lo and hi").select("lo", "hi", "peak")


def release_window(steps: DataFrame, cfg: dict = DEFAULTS["hindcast"]["origin_window"]) -> dict:
    """The release window, widened to its least width; at most some thousand step rows come to the driver."""
    rows = steps.orderBy("step").select("step", "epoch", "hours", "score").collect()
    found = peak_island(steps, cfg["score_fraction_of_peak"], cfg["min_convergence_signal"], cfg["min_age_hours"]).collect()
    last = len(rows) - 1
    if found:
        lo, hi, peak, basis = found[0]["lo"], found[0]["hi"], found[0]["peak"], "flow_convergence_peak"
    else:
        aged = [r["step"] for r in rows if r["hours"] >= cfg["min_age_hours"]] or [0, last]
        lo, hi, basis = min(aged), max(aged), "no_convergence_signal_full_horizon"
        peak = hi

    # Steps that the least width lacks: the older side takes the larger half, and either side what the other has no room for.
    size = rows[1]["hours"] - rows[0]["hours"] if last else 1.0
    lack = max(0, ceil(cfg["min_window_hours"] / size - 1e-9) - (hi - lo))
    older = min(last - hi, (lack + 1) // 2)
    younger = min(lo, lack - older)
    hi, lo = min(last, hi + lack - younger), lo - younger
    ends = sorted((rows[lo]["epoch"], rows[hi]["epoch"]))
    return {"lo": lo, "hi": hi, "peak": peak, "basis": basis, "release_start": ends[0], "release_end": ends[1], "hours_back": [rows[lo]["hours"], rows[hi]["hours"]], "peak_hours_back": rows[peak]["hours"]}


def origin_regions(particles: DataFrame, grid: dict[str, float], window: dict, mass: float) -> dict[str, dict]:
    """50 %, ``mass`` and 90 % regions over the window's steps, from one ordering of the cells."""
    inside = particles.where((F.col("member") != CONTROL) & F.col("step").between(window["lo"], window["hi"]))
    cells = mass_cells(histogram(inside, grid)).cache()
    out = {}
    for m in (0.5, mass, 0.9):
        rings, area = region_polygon(cells, m, grid)
        out[str(round(m * 100))] = {"rings": rings, "area_km2": area}
    return out
