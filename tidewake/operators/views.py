"""What a viewer derives from a case's layers: default choices, markers, paths, bounds and replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_slick(slicks: DataFrame, *by: str) -> DataFrame:
    """Of each case the first slick of class oil, else the first; ``slicks`` has slick_id, class and rank."""
    order = F.struct((F.col("class") != "oil").alias("other"), "rank", "slick_id")
    return slicks.groupBy(*by).agg(F.min_by("slick_id", order).alias("slick_id"))


def default_suspect(scores: DataFrame) -> DataFrame:
    return scores.where("rank = 1")


def closest_markers(scores: DataFrame) -> DataFrame:
    """Where candidates came closest, for those with such a place."""
    return scores.where("closest_lon is not null and closest_lat is not null").select("mmsi", F.col("closest_lon").alias("lon"), F.col("closest_lat").alias("lat"), F.col("closest_t").alias("ts_epoch"))


def last_step(particles: DataFrame) -> DataFrame:
    """The particles at the last step; that step is one row, joined as a constant."""
    return particles.join(F.broadcast(particles.agg(F.max("step").alias("__last"))), F.col("step") == F.col("__last")).drop("__last")


def path_until(paths: DataFrame, step: Column) -> DataFrame:
    """Each path, an array, up to a replay step: two points at least."""
    return paths.withColumn("path", F.slice("path", F.lit(1), F.greatest(F.lit(2), step)))


def centroid_line(steps: DataFrame, *by: str) -> DataFrame:
    """The centroids of all steps as one line; ``steps`` has step, lon and lat."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("step", "lon", "lat"))), lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))
    return steps.groupBy(*by).agg(line.alias("line"))


def regions_largest_first(regions: DataFrame, origin: DataFrame) -> DataFrame:
    """(case_id, level, geom) from 90 % to 50 %; a case without regions shows its origin polygon as level 70."""
    alone = origin.join(regions.select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.lit(70).alias("level"), "geom")
    return regions.select("case_id", "level", "geom").unionByName(alone).orderBy("case_id", F.desc("level"))


def forecast_points(steps: DataFrame) -> DataFrame:
    """All steps' points, one row each; ``steps`` has an array ``points``."""
    return steps.select("step", F.explode("points").alias("p")).select("step", "p.*")


def every_third(steps: DataFrame) -> DataFrame:
    """Every third step and the last."""
    last = F.broadcast(steps.agg(F.max("step").alias("__last")))
    return steps.join(last).where("step % 3 = 0 or step = __last").drop("__last")


def latest_first(audit: DataFrame) -> DataFrame:
    return audit.orderBy(F.desc("ts"), F.desc("action"))


def layer_bounds(*layers: DataFrame) -> DataFrame:
    """One row: the bounds of all layers' points (lon, lat)."""
    points = reduce(DataFrame.unionByName, [x.select("lon", "lat") for x in layers])
    return points.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def replay_step(step: Column, n_steps: Column) -> Column:
    """A step asked for, moved into the steps that are there."""
    return F.greatest(F.lit(0), F.least(step, n_steps - 1))
