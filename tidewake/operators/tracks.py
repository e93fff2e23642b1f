"""Vessel tracks in long form: filters, neighbours, gaps, dwell, and summaries.

Positions are rows (mmsi, ts_epoch, lon, lat, sog, cog, ...) with a tie-breaking
``seq``; all windows run over (mmsi) in the order (ts_epoch, seq), so one
shuffle on mmsi serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.geo import Ring, bearing_deg, haversine_km, in_ring, metres_per_degree, ring_distance_km


def along() -> Window:
    return Window.partitionBy("mmsi").orderBy("ts_epoch", "seq")


def in_box(positions: DataFrame, bbox: list[float] | None = None, t0: float | None = None, t1: float | None = None) -> DataFrame:
    """Inclusive bounds, each optional; plain comparisons, so they reach the scan."""
    if bbox:
        positions = positions.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    if t0 is not None:
        positions = positions.where(F.col("ts_epoch") >= t0)
    return positions if t1 is None else positions.where(F.col("ts_epoch") <= t1)


def with_steps(fixes: DataFrame) -> DataFrame:
    """Neighbours in time: prev_t, next_t, dt to the next fix, and the number of the fix."""
    w = along()
    return fixes.select(
        "*", F.lag("ts_epoch").over(w).alias("prev_t"), F.lead("ts_epoch").over(w).alias("next_t"), F.row_number().over(w).alias("rn"),
    ).withColumn("dt", F.col("next_t") - F.col("ts_epoch"))


def expected_interval_s(steps: DataFrame, default: float = 300.0) -> DataFrame:
    """One row: the median over vessels with more than three fixes of their median positive step."""
    per = steps.groupBy("mmsi").agg(F.count("*").alias("n"), F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).alias("median_dt"))
    return per.where("n > 3").agg(F.coalesce(F.percentile("median_dt", 0.5), F.lit(default)).alias("expected_s"))


def gaps(steps: DataFrame, expected: DataFrame, window: tuple[float, float], multiple: float = 4.0, least_s: float = 1200.0) -> DataFrame:
    """Steps longer than the expected interval allows, with their overlap with the window.

    ``expected`` is one row, so it is joined as a constant.
    """
    ga, gb = F.col("ts_epoch"), F.col("next_t")
    overlap = F.greatest(F.lit(0.0), F.least(gb, F.lit(window[1])) - F.greatest(ga, F.lit(window[0])))
    long = F.col("dt") > F.greatest(F.col("expected_s") * multiple, F.lit(least_s))
    return steps.join(F.broadcast(expected)).where(long).withColumn("overlap_s", overlap)


def dwell_s(steps: DataFrame, inside: Column, window: tuple[float, float]) -> DataFrame:
    """Per vessel, time inside a region in the window: half of what lies between each inside fix's neighbours."""
    rs, re_ = window
    t = F.col("ts_epoch")
    share = 0.5 * (F.least(F.coalesce("next_t", t), F.lit(re_)) - F.greatest(F.coalesce("prev_t", t), F.lit(rs)))
    counted = F.when(t.between(rs, re_) & inside, share).otherwise(0.0)
    return steps.groupBy("mmsi").agg(F.greatest(F.lit(0.0), F.least(F.sum(counted), F.lit(re_ - rs))).alias("dwell_s"))


def loiter_s(fixes: DataFrame, distance_km: Column, knots: float = 1.5, near_km: float = 2.0) -> DataFrame:
    """Per vessel, seconds between consecutive slow fixes near a region, at most an hour a step."""
    slow = F.coalesce(F.col("sog") <= knots, F.lit(False)) & (distance_km <= near_km)
    marked = fixes.withColumn("slow", slow)
    w = along()
    step = F.lead("ts_epoch").over(w) - F.col("ts_epoch")
    both = F.col("slow") & F.coalesce(F.lead("slow").over(w), F.lit(False))
    parts = marked.select("mmsi", F.when(both, F.least(step, F.lit(3600.0))).otherwise(0.0).alias("s"))
    return parts.groupBy("mmsi").agg(F.sum("s").alias("loiter_s"))


def closest(fixes: DataFrame, distance: Column) -> DataFrame:
    """Per vessel the fix of least distance, the earliest of equals."""
    best = F.min(F.struct(distance.alias("d"), "ts_epoch", "seq", "lon", "lat")).alias("best")
    return fixes.groupBy("mmsi").agg(F.count("*").alias("positions"), best).select(
        "mmsi", "positions", F.col("best.d").alias("min_distance_km"), F.col("best.ts_epoch").alias("closest_t"), F.col("best.lon").alias("closest_lon"), F.col("best.lat").alias("closest_lat"))


def neighbour_bearing(fixes: DataFrame, reach: int = 2) -> DataFrame:
    """Each fix with the bearing from ``reach`` fixes before to ``reach`` after, null for under 50 m."""
    near = along().rowsBetween(-reach, reach)
    ends = fixes.select("*", *[f(c).over(near).alias(f"{p}_{c}") for c in ("lon", "lat") for p, f in (("a", F.first), ("b", F.last))])
    a = [F.col(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat")]
    return ends.withColumn("track_bearing", F.when(haversine_km(*a) > 0.05, bearing_deg(*a))).drop("a_lon", "a_lat", "b_lon", "b_lat")


def region_flags(fixes: DataFrame, regions: dict[str, Ring]) -> DataFrame:
    """in_<name> and d_<name> (km, 0 inside) for every region."""
    lon, lat = F.col("lon"), F.col("lat")
    return fixes.select("*", *[in_ring(lon, lat, r).alias(f"in_{k}") for k, r in regions.items()], *[ring_distance_km(lon, lat, r).alias(f"d_{k}") for k, r in regions.items()])


def first_given(column: str) -> Column:
    """First value in time that is neither null, empty nor zero."""
    c = F.col(column)
    given = c.isNotNull() & (c.cast("string") != "") & F.coalesce(c.try_cast("double") != 0, F.lit(True))
    return F.min_by(F.when(given, c), F.when(given, F.struct("ts_epoch", "seq")))


def track_summary(fixes: DataFrame, most: int | None = 300) -> DataFrame:
    """Per vessel: fixes, first and last time, name and type; the first ``most`` vessels by number."""
    out = fixes.groupBy("mmsi").agg(
        F.count("*").alias("positions"), F.min("ts_epoch").alias("t0"), F.max("ts_epoch").alias("t1"), first_given("vessel_name").alias("vessel_name"),
        first_given("vessel_type").alias("vessel_type"), first_given("length_m").alias("length_m"),
    )
    return out.orderBy("mmsi").limit(most) if most else out


def decimated(fixes: DataFrame, most: int) -> DataFrame:
    """Every k-th fix of a vessel, k so that fewer than twice ``most`` are left."""
    n = F.count("*").over(Window.partitionBy("mmsi"))
    step = F.greatest(F.lit(1), F.floor(n / most))
    return fixes.withColumn("rn", F.row_number().over(along())).withColumn("step", step).where("(rn - 1) % step = 0").drop("step")


def other_tracks(fixes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fixes of vessels that aren't candidates."""
    return fixes.join(candidates.select("mmsi").distinct(), "mmsi", "left_anti")


def gap_lines(found: DataFrame) -> DataFrame:
    """One feature for each gap of a vessel, numbered in time: from the fix before it to the one after."""
    order = Window.partitionBy("mmsi").orderBy("ts_epoch", "seq")
    return found.select("mmsi", F.row_number().over(order).cast("long").alias("gap_no"), F.col("ts_epoch").alias("gap_start"), F.col("next_t").alias("gap_end"))


def lines(fixes: DataFrame, most: int = 500) -> DataFrame:
    """Per vessel its decimated path as an array of (t, lon, lat, sog), at most twice ``most`` long."""
    kept = decimated(fixes, most)
    return kept.groupBy("mmsi").agg(F.sort_array(F.collect_list(F.struct("ts_epoch", "seq", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), F.round("sog", 1).alias("sog")))).alias("path"))


def with_cloud(fixes: DataFrame, cloud: DataFrame, t_first: float, t_last: float, dt: float, share: float = 0.1) -> DataFrame:
    """``fixes`` with st_km: distance to the nearer tenth of a particle cloud at each fix's time, null outside the cloud's time.

    ``cloud`` is (step, k, lon, lat) at t_first + step * dt.  The step before a
    fix is arithmetic, so the join is an equality on it; positions are lerped
    between that step and the next.  A step's particles, whose number is a
    parameter, are one row, so each fix stays one row where it lies.
    """
    t = F.col("ts_epoch")
    inside = t.between(t_first, t_last)
    last = int(round((t_last - t_first) / dt))
    keyed = fixes.withColumn("__mid", F.avg(F.when(inside, F.col("lat"))).over(Window.partitionBy("mmsi")))
    keyed = keyed.withColumn("__j1", F.when(inside, F.least(F.ceil((t - t_first) / dt), F.lit(last)).cast("int"))).withColumn("__j0", F.greatest(F.col("__j1") - 1, F.lit(0)))
    keyed = keyed.withColumn("__w", F.when(F.col("__j1") == F.col("__j0"), 0.0).otherwise((t - t_first - F.col("__j0") * dt) / dt))
    a = cloud.select(F.col("step").alias("__a"), F.col("k"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    b = cloud.select(F.col("step").alias("__b"), F.col("k").alias("kb"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    pairs = a.join(b, (F.col("k") == F.col("kb")) & ((F.col("__b") == F.col("__a") + 1) | ((F.col("__b") == 0) & (F.col("__a") == 0))))
    steps = pairs.groupBy("__a", "__b").agg(F.collect_list(F.struct("lon_a", "lat_a", "lon_b", "lat_b")).alias("__cloud"))
    met = keyed.join(F.broadcast(steps), (F.col("__j0") == F.col("__a")) & (F.col("__j1") == F.col("__b")), "left")
    mx, my = metres_per_degree(F.col("__mid"))
    w = F.col("__w")

    def km(p: Column) -> Column:
        lon, lat = (p[f"{c}_a"] * (1 - w) + p[f"{c}_b"] * w for c in ("lon", "lat"))
        return F.sqrt(F.pow((lon - F.col("lon")) * F.col("__mx"), 2.0) + F.pow((lat - F.col("lat")) * F.col("__my"), 2.0)) / 1000.0

    found = met.withColumns({"__mx": mx, "__my": my}).withColumn("__km", F.sort_array(F.array_compact(F.transform("__cloud", km))))
    # The same interpolation as F.percentile.
    place = (F.size("__km") - 1) * F.lit(share)
    low, high = F.get("__km", F.floor(place).cast("int")), F.get("__km", F.ceil(place).cast("int"))
    out = found.withColumn("st_km", F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return out.drop("__mid", "__j0", "__j1", "__w", "__a", "__b", "__cloud", "__mx", "__my", "__km")


def asof_cloud(fixes: DataFrame, cloud: DataFrame, t_first: float, t_last: float, dt: float, share: float = 0.1) -> DataFrame:
    """(fix, st_km) of the fixes in the cloud's time, as ``with_cloud`` has it."""
    return with_cloud(fixes, cloud, t_first, t_last, dt, share).where("st_km is not null").select("mmsi", "ts_epoch", "seq", "st_km")
