"""Vessel attribution: seven factors, a score, a rank, and what they rest on."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS, weights
from tidewake.functions.geo import Ring, angular_diff_deg, bearing, centroid, padded_bounds
from tidewake.operators import tracks

FACTORS = ("proximity", "temporal_overlap", "heading_compatibility", "loitering", "ais_gap_relevance", "vessel_type")


@dataclass
class Hindcast:
    """What attribution needs of a hindcast: regions, release window and, if there, the particle cloud."""

    origin: Ring
    core: Ring
    outer: Ring
    release_start: float
    release_end: float
    confidence_level: float = 0.7
    cloud: DataFrame | None = None  # (step, k, lon, lat), times rising
    cloud_first: float = 0.0
    cloud_step: float = 900.0
    cloud_last: float = 0.0


@dataclass
class Attribution:
    scores: DataFrame
    gaps: DataFrame
    decisions: DataFrame
    funnel: DataFrame
    search_bbox: list[float]
    search_window: tuple[float, float]
    weights: dict[str, float] = field(default_factory=dict)


def type_prior(vessel_type: Column, table: dict[str, float] = DEFAULTS["attribution"]["vessel_type_plausibility"]) -> Column:
    """Exact name, else the first name it contains, else the numeric code's class, else unknown."""
    v = F.lower(F.trim(vessel_type))
    exact = F.coalesce(*[F.when(v == k, F.lit(float(p))) for k, p in table.items()])
    part = F.coalesce(*[F.when(v.contains(k), F.lit(float(p))) for k, p in table.items()])
    code = v.try_cast("int")
    coded = F.when(code.between(80, 89), table["tanker"]).when(code.between(70, 79), table["cargo"]).when(code == 30, table["fishing"])
    return F.coalesce(exact, part, coded, F.lit(float(table["unknown"])))


def priority(score: Column, bands: dict[str, float] = DEFAULTS["attribution"]["priority_bands"]) -> Column:
    return F.when(score >= bands["high"], "high").when(score >= bands["medium"], "medium").when(score >= bands["low"], "low").otherwise("insufficient")


def total_score(quality: Column, factors: dict[str, Column], w: dict[str, float]) -> Column:
    return 100.0 * quality * reduce(lambda a, b: a + b, [w[k] * factors[k] for k in FACTORS])


def data_quality(n: Column, span_s: Column, has_name: Column, has_type: Column) -> Column:
    density = n / F.greatest(span_s / 3600.0, F.lit(0.25))
    meta = 0.5 * has_name.cast("double") + 0.5 * has_type.cast("double")
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), 0.5 + 0.3 * F.least(F.lit(1.0), density / 6.0) + 0.2 * meta))


def attribute(positions: DataFrame, hindcast: Hindcast, slick_centroid: tuple[float, float], acquisition: float, excluded: tuple[int, ...] = (), user_weights: dict[str, float] | None = None, config: dict = DEFAULTS) -> Attribution:
    """Scores every vessel with two fixes or more in the search box and time.

    One plan from positions to ranks: fixes get distances and neighbours by
    windows over (mmsi), vessels their features by one aggregation; the small
    tables of gaps and closest fixes join on mmsi.
    """
    search, feat = config["ais"]["candidate_search"], config["ais"]["features"]
    buffer_km, pad_s = float(search["origin_buffer_km"]), search["time_pad_hours"] * 3600.0
    scale, st_scale = float(feat["proximity_scale_km"]), float(feat["spacetime_scale_km"])
    rs, re_ = hindcast.release_start, hindcast.release_end
    length = max(re_ - rs, 1.0)
    bbox = padded_bounds(hindcast.outer, buffer_km)
    t0, t1 = rs - pad_s, min(re_ + pad_s, acquisition + 3600)
    w = weights(user_weights, config)

    found = tracks.in_box(positions, bbox, t0, t1)
    if hindcast.cloud is not None:
        found = tracks.with_cloud(found, hindcast.cloud, hindcast.cloud_first, hindcast.cloud_last, hindcast.cloud_step)
    else:
        found = found.withColumn("st_km", F.lit(None).cast("double"))
    steps = tracks.with_steps(tracks.region_flags(found, {"core": hindcast.core, "org": hindcast.origin, "out": hindcast.outer}))
    steps = tracks.neighbour_bearing(steps).cache()

    t = F.col("ts_epoch")
    in_window = t.between(rs, re_)
    slow = F.coalesce(F.col("sog") <= feat["loiter_speed_knots"], F.lit(False)) & (F.col("d_out") <= 2.0)
    along = tracks.along()
    marked = steps.withColumn("slow", slow).withColumn("slow_next", F.coalesce(F.lead("slow").over(along), F.lit(False)))
    inside_share = 0.5 * (F.least(F.coalesce("next_t", t), F.lit(re_)) - F.greatest(F.coalesce("prev_t", t), F.lit(rs)))
    place_fields = ("ts_epoch", "lon", "lat", "cog", "track_bearing")

    def first_least(column: str) -> Column:
        return F.min_by(F.struct(column, *place_fields), F.when(F.col(column).isNotNull(), F.struct(column, "ts_epoch", "seq")))

    vessels = marked.groupBy("mmsi").agg(
        F.count("*").alias("positions"), (F.max(t) - F.min(t)).alias("span_s"),
        tracks.first_given("vessel_name").alias("vessel_name"), tracks.first_given("vessel_type").alias("vessel_type"), tracks.first_given("length_m").alias("length_m"), tracks.first_given("source").alias("source"),
        first_least("d_org").alias("near_org"), first_least("st_km").alias("near_st"),
        F.count_if(in_window).alias("n_window"), F.min(F.when(in_window, F.col("d_out"))).alias("d_window"),
        F.greatest(F.lit(0.0), F.least(F.sum(F.when(in_window & (F.col("d_out") <= 0), inside_share).otherwise(0.0)), F.lit(re_ - rs))).alias("dwell_s"),
        F.min(F.when(in_window, F.col("st_km"))).alias("st_window"), F.avg(F.when(in_window, F.coalesce((F.col("st_km") <= 2 * st_scale).cast("double"), F.lit(0.0)))).alias("st_share"),
        F.least(F.min(F.abs(t - rs)), F.min(F.abs(t - re_))).alias("away_s"),
        F.sum(F.when(F.col("slow") & F.col("slow_next"), F.least("dt", F.lit(3600.0))).otherwise(0.0)).alias("loiter_s"),
        F.bool_or("in_core").alias("in_core_region"), F.bool_or("in_org").alias("in_origin_region"),
    )
    expected = tracks.expected_interval_s(steps)
    least_gap = feat["min_gap_minutes"] * 60.0
    near_next = F.lead("d_out").over(along)
    gaps = tracks.gaps(steps.withColumn("d_next", near_next), expected, (rs, re_), feat["gap_multiple_of_expected"], least_gap)
    gaps = gaps.withColumn("near", F.least("d_out", "d_next") <= buffer_km).select(
        "mmsi", t.alias("start"), F.col("next_t").alias("end"), (F.col("dt") / 60).alias("minutes"), (F.col("overlap_s") / 60).alias("overlap_minutes"), "near", "overlap_s", "lon", "lat", "expected_s")
    g = F.when(F.col("near") & (F.col("overlap_s") > 0), F.least(F.lit(1.0), F.col("overlap_s") / length) * 0.7 + 0.3).when(F.col("near"), 0.25).otherwise(0.0)
    relevance = gaps.groupBy("mmsi").agg(F.max(g).alias("g"), F.count("*").alias("n_gaps"), F.max("overlap_minutes").alias("gap_overlap_minutes"))

    v = vessels.join(relevance, "mmsi", "left").join(F.broadcast(expected))
    d_min, st_min = F.col("near_org.d_org"), F.col("near_st.st_km")
    p_static = F.exp(-d_min / scale)
    p = F.when(st_min.isNotNull(), 0.4 * p_static + 0.6 * F.exp(-st_min / st_scale)).otherwise(p_static)
    dwelt = F.col("dwell_s") / length
    t_inside = F.when(dwelt == 0, 0.5 * F.exp(-F.col("d_window") / scale)).otherwise(dwelt)
    t_cloud = 0.5 * F.col("st_share") + 0.5 * F.exp(-F.col("st_window") / st_scale)
    overlap = F.when(F.col("n_window") == 0, 0.3 * F.exp(-F.col("away_s") / 3600 / max(search["time_pad_hours"], 1))).otherwise(
        F.when(F.col("st_window").isNotNull(), F.greatest(t_inside, t_cloud)).otherwise(t_inside))
    use_cloud = st_min.isNotNull() & (st_min < d_min)

    def at(name: str) -> Column:
        return F.when(use_cloud, F.col(f"near_st.{name}")).otherwise(F.col(f"near_org.{name}"))

    o = centroid(hindcast.origin)
    axis = bearing(*o, *slick_centroid)
    track = F.coalesce(at("track_bearing"), at("cog"))
    off = angular_diff_deg(track, F.lit(axis))
    heading = F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(off, 180 - off) / 90), F.lit(0.5))
    least_loiter = feat["loiter_min_minutes"] * 60.0
    loiter = F.when(F.col("loiter_s") >= least_loiter, F.least(F.lit(1.0), F.col("loiter_s") / (3 * least_loiter))).otherwise(0.3 * F.col("loiter_s") / least_loiter)
    quality = data_quality(F.col("positions"), F.col("span_s"), F.col("vessel_name").isNotNull(), F.col("vessel_type").isNotNull())
    factors = {
        "proximity": p, "temporal_overlap": overlap, "heading_compatibility": heading, "loitering": loiter,
        "ais_gap_relevance": F.coalesce("g", F.lit(0.0)), "vessel_type": type_prior(F.col("vessel_type"), config["attribution"]["vessel_type_plausibility"]),
    }
    decided = v.withColumn("decision", F.when(F.col("mmsi").isin(list(excluded)), "excluded_by_analyst").when(F.col("positions") < 2, "dropped").otherwise("scored"))
    scored = decided.where("decision = 'scored'").select(
        "mmsi", "vessel_name", F.col("vessel_type").alias("type_text"), "length_m", "source", "positions", (F.col("span_s") / 3600).alias("span_hours"), d_min.alias("min_distance_km"), st_min.alias("spacetime_min_km"),
        at("ts_epoch").alias("closest_t"), at("lon").alias("closest_lon"), at("lat").alias("closest_lat"), track.alias("track_bearing_deg"), F.lit(axis).alias("source_to_slick_bearing_deg"),
        (F.col("dwell_s") / 60).alias("dwell_minutes"), (F.col("loiter_s") / 60).alias("loiter_minutes"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        F.coalesce("gap_overlap_minutes", F.lit(0.0)).alias("gap_overlap_minutes"), "expected_s", "in_core_region", "in_origin_region",
        *[c.alias(k) for k, c in factors.items()], quality.alias("data_quality"),
    )
    scored = scored.withColumn("score", F.round(total_score(F.col("data_quality"), {k: F.col(k) for k in FACTORS}, w), 1))
    bands = config["attribution"]["priority_bands"]
    scored = scored.withColumn("priority", priority(F.col("score"), bands)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "mmsi")))
    scored = scored.withColumn("evidence", evidence(hindcast, feat)).withColumn("limitations", limitations()).cache()
    decisions = decided.select("mmsi", "decision", F.when(F.col("decision") == "dropped", "fewer than two fixes in the search").alias("reason")).join(scored.select("mmsi", "score"), "mmsi", "left")
    everyone = positions.agg(F.countDistinct("mmsi").alias("vessels_in_dataset"), F.countDistinct(F.when(t.between(t0, t1), F.col("mmsi"))).alias("vessels_in_time_window"))
    kept = decided.agg(F.count("*").alias("vessels_in_search_region"))
    top = scored.agg(F.count("*").alias("vessels_scored"), F.max("score").alias("top"))
    funnel = everyone.join(kept).join(top).join(expected).withColumn("dark_source_possible", F.coalesce(F.col("top") < bands["medium"], F.lit(True))).drop("top")
    return Attribution(scored, gaps, decisions, funnel, bbox, (t0, t1), w)


def evidence(hindcast: Hindcast, feat: dict) -> Column:
    """Short statements of what each factor rests on."""
    minutes = (hindcast.release_end - hindcast.release_start) / 60
    return F.array(
        F.format_string(f"closest fix is %.1f km from the {100 * hindcast.confidence_level:.0f} percent origin region", F.col("min_distance_km")),
        F.when(F.col("spacetime_min_km").isNotNull(), F.format_string("passed %.1f km from the modelled oil at the same time", F.col("spacetime_min_km"))).otherwise("no fix within the modelled horizon"),
        F.when(F.col("dwell_minutes") > 0, F.format_string(f"%.0f of {minutes:.0f} minutes of the release window inside the outer region", F.col("dwell_minutes"))).otherwise("never inside the outer region in the release window"),
        F.when(F.col("track_bearing_deg").isNotNull(), F.format_string("course %.0f, axis to the slick %.0f degrees", F.col("track_bearing_deg"), F.col("source_to_slick_bearing_deg"))).otherwise("no course known"),
        F.format_string(f"%.0f minutes at {feat['loiter_speed_knots']} knots or less near the region", F.col("loiter_minutes")),
        F.format_string("%d reporting gaps; at most %.0f minutes of one lie in the window; usual interval %.1f minutes", F.col("n_gaps"), F.col("gap_overlap_minutes"), F.col("expected_s") / 60),
        F.format_string("type %s has prior %.2f", F.coalesce("type_text", F.lit("unknown")), F.col("vessel_type")),
        F.format_string("%d fixes over %.1f hours", F.col("positions"), F.col("span_hours")),
    )


def limitations() -> Column:
    return F.array_compact(F.array(
        F.lit("A rank says whom to look at first; it proves nothing."),
        F.lit("Origin region and release window come from a model."),
        F.when(F.col("type_text").isNull(), "Vessel type unknown: the neutral prior is used."),
        F.when(F.col("positions") < 5, "Fewer than five fixes in the search."),
    ))


def rescored(scores: DataFrame, user_weights: dict[str, float]) -> DataFrame:
    """Stored factors under other weights: new_score (unrounded), new_rank, and how many places up."""
    w = weights(user_weights)
    out = scores.withColumn("new_score", total_score(F.col("data_quality"), {k: F.col(k) for k in FACTORS}, w))
    out = out.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("new_score"), "rank")))
    return out.withColumn("rank_change", F.col("rank") - F.col("new_rank"))
