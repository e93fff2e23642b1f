"""More queries over the benchmark tables, each through the library, with the same result in DuckDB's SQL.

Here are the operators that ``queries`` leaves out: the whole attribution, raw
messages and files, rasters over tiles, the case store, streams and what a
viewer derives.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS, drift_params, weights
from tidewake.functions import geo, text
from tidewake.operators import attribution, density, drift, land, raster, tracks, views
from tidewake.plans import store
from tidewake.queries import _CLOUD_DT, _CLOUD_N, _CLOUD_SQL, _ENS_SQL, _GRID, _MLAT, _MLON, _PRIOR_SQL, AIS, BRG, EXPECTED, ORIGIN, OUTER, RE, REGION, RS, STEPS, _ensemble, _px, _PX_SQL, cloud, d, fixes, hav, load, query, r6, raw_rows, sql_in_ring, sql_ring_km
from tidewake.session import shared_dir
from tidewake.sources import ais_csv, fields, registry, scenes
from tidewake.streaming import recorder

# ------------------------------------------------------------------ attribution as a whole

CORE = [(71.82, 18.38), (71.9, 18.38), (71.9, 18.48), (71.82, 18.48), (71.82, 18.38)]
SLICK = (71.95, 18.6)
ACQUIRED = RE + 7200.0
EXCLUDED = (419000003, 419000008)
_S, _FT = DEFAULTS["ais"]["candidate_search"], DEFAULTS["ais"]["features"]
_KM, _PADS = float(_S["origin_buffer_km"]), _S["time_pad_hours"] * 3600.0
_B = geo.padded_bounds(OUTER, _KM)
_T0, _T1 = RS - _PADS, min(RE + _PADS, ACQUIRED + 3600)
_LEN = RE - RS
_ALL = weights()
_AXIS = geo.bearing(*geo.centroid(REGION), *SLICK)
_LAST = RS + _CLOUD_N * _CLOUD_DT
_LOITER = _FT["loiter_min_minutes"] * 60.0


def _diff(a: str, b: str) -> str:
    return f"abs((({a} - {b} + 180.0::double) % 360.0::double + 360.0::double) % 360.0::double - 180.0::double)"


_ATTRIBUTED = f"""with {AIS}, f as (select * from ais where lon between {d(_B[0])} and {d(_B[2])} and lat between {d(_B[1])} and {d(_B[3])} and ts_epoch between {d(_T0)} and {d(_T1)}), {STEPS}, {EXPECTED}, {_CLOUD_SQL},
    a0 as (select *, least(ceil((ts_epoch - {d(RS)}) / {d(_CLOUD_DT)}), {_CLOUD_N})::int as j1 from f where ts_epoch between {d(RS)} and {d(_LAST)}), b0 as (select *, greatest(j1 - 1, 0) as j0 from a0),
    m0 as (select *, case when j1 = j0 then 0.0::double else (ts_epoch - {d(RS)} - j0 * {d(_CLOUD_DT)}) / {d(_CLOUD_DT)} end as w, avg(lat) over (partition by mmsi) as mid from b0),
    near as (select seq, quantile_cont(sqrt(power((c0.lon * (1 - w) + c1.lon * w - m0.lon) * {_MLON.format('mid')}, 2) + power((c0.lat * (1 - w) + c1.lat * w - m0.lat) * {_MLAT.format('mid')}, 2)) / 1000.0::double, 0.1) as st_km
        from m0 join cl c0 on c0.step = m0.j0 join cl c1 on c1.step = m0.j1 and c1.k = c0.k group by seq),
    ends as (select seq, first_value(lon) over w as a, first_value(lat) over w as b, last_value(lon) over w as c, last_value(lat) over w as e from f window w as (partition by mmsi order by ts_epoch, seq rows between 2 preceding and 2 following)),
    z as (select s.*, st_km, {sql_ring_km('lon', 'lat', REGION)} as d_org, {sql_ring_km('lon', 'lat', OUTER)} as d_out, {sql_in_ring('lon', 'lat', REGION)} as in_org, {sql_in_ring('lon', 'lat', CORE)} as in_core, ts_epoch between {d(RS)} and {d(RE)} as in_window,
        case when {hav('a', 'b', 'c', 'e')} > 0.05::double then {BRG.format(lon1='a', lat1='b', lon2='c', lat2='e')} end as track_bearing from s left join near using (seq) left join ends using (seq)),
    y as (select *, coalesce(sog <= {d(_FT['loiter_speed_knots'])}, false) and d_out <= 2.0::double as slow, lead(d_out) over w as d_next from z window w as (partition by mmsi order by ts_epoch, seq)),
    y2 as (select *, slow and coalesce(lead(slow) over (partition by mmsi order by ts_epoch, seq), false) as slow_both from y),
    v as (select mmsi, count(*) as positions, max(ts_epoch) - min(ts_epoch) as span_s, arg_min(vessel_type, (ts_epoch, seq)) filter (vessel_type is not null and vessel_type <> '') as vessel_type,
        arg_min(seq, (d_org, ts_epoch, seq)) as org_seq, min(d_org) as d_min, arg_min(seq, (st_km, ts_epoch, seq)) filter (st_km is not null) as st_seq, min(st_km) as st_min,
        count(*) filter (in_window) as n_window, min(d_out) filter (in_window) as d_window,
        greatest(0.0::double, least(sum(case when in_window and d_out <= 0 then 0.5::double * (least(coalesce(next_t, ts_epoch), {d(RE)}) - greatest(coalesce(prev_t, ts_epoch), {d(RS)})) else 0.0::double end), {d(_LEN)})) as dwell_s,
        min(st_km) filter (in_window) as st_window, avg(case when coalesce(st_km <= {d(2 * _FT['spacetime_scale_km'])}, false) then 1.0::double else 0.0::double end) filter (in_window) as st_share,
        least(min(abs(ts_epoch - {d(RS)})), min(abs(ts_epoch - {d(RE)}))) as away_s, sum(case when slow_both then least(dt, 3600.0::double) else 0.0::double end) as loiter_s, bool_or(in_core) as in_core_region, bool_or(in_org) as in_origin_region from y2 group by mmsi),
    gp as (select mmsi, dt, greatest(0.0::double, least(next_t, {d(RE)}) - greatest(ts_epoch, {d(RS)})) as overlap_s, least(d_out, d_next) <= {d(_KM)} as near from y, x where dt > greatest({d(_FT['gap_multiple_of_expected'])} * expected_s, {d(_FT['min_gap_minutes'] * 60.0)})),
    gr as (select mmsi, count(*) as n_gaps, max(overlap_s) / 60 as gap_overlap_minutes, max(case when near and overlap_s > 0 then least(1.0::double, overlap_s / {d(_LEN)}) * 0.7::double + 0.3::double when near then 0.25::double else 0.0::double end) as g from gp group by mmsi),
    ch as (select v.*, coalesce(n_gaps, 0) as n_gaps, coalesce(gap_overlap_minutes, 0.0::double) as gap_overlap_minutes, coalesce(g, 0.0::double) as f_gap, o.ts_epoch as closest_t, coalesce(o.track_bearing, o.cog) as track,
        case when mmsi in {EXCLUDED} then 'excluded_by_analyst' when positions < 2 then 'dropped' else 'scored' end as decision
        from v left join gr using (mmsi) left join (select seq, ts_epoch, track_bearing, cog from z) o on o.seq = case when st_min is not null and st_min < d_min then st_seq else org_seq end),
    fa as (select *, case when st_min is not null then 0.4::double * exp(-d_min / {d(float(_FT['proximity_scale_km']))}) + 0.6::double * exp(-st_min / {d(float(_FT['spacetime_scale_km']))}) else exp(-d_min / {d(float(_FT['proximity_scale_km']))}) end as f_p,
        case when dwell_s = 0 then 0.5::double * exp(-d_window / {d(float(_FT['proximity_scale_km']))}) else dwell_s / {d(_LEN)} end as t_inside, 0.5::double * st_share + 0.5::double * exp(-st_window / {d(float(_FT['spacetime_scale_km']))}) as t_cloud,
        least({_diff('track', d(_AXIS))}, 180 - {_diff('track', d(_AXIS))}) as off, {_PRIOR_SQL} as f_v,
        greatest(0.3::double, least(1.0::double, 0.5::double + 0.3::double * least(1.0::double, positions / greatest(span_s / 3600.0::double, 0.25::double) / 6.0::double) + 0.2::double * (0.5::double + case when vessel_type is not null then 0.5::double else 0.0::double end))) as dq from ch),
    fb as (select *, case when n_window = 0 then 0.3::double * exp(-away_s / 3600 / {d(float(max(_S['time_pad_hours'], 1)))}) when st_window is not null then greatest(t_inside, t_cloud) else t_inside end as f_t, coalesce(greatest(0.0::double, 1 - off / 90), 0.5::double) as f_h,
        case when loiter_s >= {d(_LOITER)} then least(1.0::double, loiter_s / {d(3 * _LOITER)}) else 0.3::double * loiter_s / {d(_LOITER)} end as f_l from fa),
    sc as (select *, round(100.0::double * dq * ({d(_ALL['proximity'])} * f_p + {d(_ALL['temporal_overlap'])} * f_t + {d(_ALL['heading_compatibility'])} * f_h + {d(_ALL['loitering'])} * f_l + {d(_ALL['ais_gap_relevance'])} * f_gap + {d(_ALL['vessel_type'])} * f_v), 1) as score from fb where decision = 'scored'),
    rk as (select *, row_number() over (order by score desc, mmsi) as rank from sc)"""


def attributed(spark: SparkSession, sf_dir: str) -> attribution.Attribution:
    """Every vessel of ``events`` against regions, a release window and a particle cloud."""
    rows = fixes(spark, sf_dir).withColumn("length_m", F.lit(None).cast("double")).withColumn("source", F.lit("s"))
    back = attribution.Hindcast(REGION, CORE, OUTER, RS, RE, cloud=cloud(spark), cloud_first=RS, cloud_step=_CLOUD_DT, cloud_last=_LAST)
    return attribution.attribute(rows, back, SLICK, ACQUIRED, EXCLUDED)


@query(_ATTRIBUTED + """ select rank, mmsi, positions, round(d_min, 4) as min_distance_km, round(st_min, 4) as spacetime_min_km, closest_t, round(track, 4) as track_bearing_deg, round(dwell_s / 60, 4) as dwell_minutes, round(loiter_s / 60, 4) as loiter_minutes, n_gaps,
    round(gap_overlap_minutes, 4) as gap_overlap_minutes, in_core_region, in_origin_region, round(f_p, 5) as proximity, round(f_t, 5) as temporal_overlap, round(f_h, 5) as heading_compatibility, round(f_l, 5) as loitering, round(f_gap, 5) as ais_gap_relevance, round(f_v, 5) as vessel_type,
    round(dq, 5) as data_quality, score, case when score >= 80 then 'high' when score >= 55 then 'medium' when score >= 30 then 'low' else 'insufficient' end as priority from rk""")
def attribution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = attributed(spark, sf_dir).scores
    four, five = ("min_distance_km", "spacetime_min_km", "track_bearing_deg", "dwell_minutes", "loiter_minutes", "gap_overlap_minutes"), (*attribution.FACTORS, "data_quality")
    return s.select(F.col("rank").cast("long").alias("rank"), "mmsi", "positions", "closest_t", "n_gaps", "in_core_region", "in_origin_region", *[F.round(c, 4).alias(c) for c in four], *[F.round(c, 5).alias(c) for c in five], "score", "priority")


@query(_ATTRIBUTED + " select ch.mmsi, ch.decision, sc.score from ch left join sc using (mmsi)")
def attribution_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir).decisions.select("mmsi", "decision", "score")


@query(_ATTRIBUTED + f""" select (select count(distinct mmsi) from ais) as vessels_in_dataset, (select count(distinct mmsi) from ais where ts_epoch between {d(_T0)} and {d(_T1)}) as vessels_in_time_window, (select count(*) from v) as vessels_in_search_region,
    (select count(*) from sc) as vessels_scored, round((select expected_s from x), 4) as expected_s, coalesce((select max(score) from sc) < 55, true) as dark_source_possible""")
def attribution_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir).funnel.withColumn("expected_s", F.round("expected_s", 4))


_WHATIF = {"proximity": 0.1, "temporal_overlap": 0.1, "heading_compatibility": 0.3, "loitering": 0.1, "ais_gap_relevance": 0.3, "vessel_type": 0.1}


@query(_ATTRIBUTED + """, nw as (select mmsi, rank, 100.0::double * dq * (0.1::double * f_p + 0.1::double * f_t + 0.3::double * f_h + 0.1::double * f_l + 0.3::double * f_gap + 0.1::double * f_v) as new_score from rk)
    select mmsi, rank, round(new_score, 4) as new_score, row_number() over (order by new_score desc, rank) as new_rank, rank - row_number() over (order by new_score desc, rank) as rank_change from nw""")
def attribution_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attribution.rescored(attributed(spark, sf_dir).scores, _WHATIF)
    return out.select("mmsi", *[F.col(c).cast("long").alias(c) for c in ("rank", "new_rank", "rank_change")], F.round("new_score", 4).alias("new_score"))


@query(_ATTRIBUTED + " select mmsi, round(dt / 60, 4) as minutes, round(overlap_s / 60, 4) as overlap_minutes, near from gp")
def attribution_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir).gaps.select("mmsi", F.round("minutes", 4).alias("minutes"), F.round("overlap_minutes", 4).alias("overlap_minutes"), "near")


@query(_ATTRIBUTED + " select mmsi, rank from rk where rank = 1")
def default_suspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.default_suspect(attributed(spark, sf_dir).scores).select("mmsi", F.col("rank").cast("long").alias("rank"))


@query(_ATTRIBUTED + " select mmsi, closest_t as ts_epoch from rk")
def closest_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.closest_markers(attributed(spark, sf_dir).scores).select("mmsi", "ts_epoch")


# ------------------------------------------------------------------ times, names and values


@query("select event_id, (epoch_us(ts) // 1000) / 1000.0::double as t from events")
def numeric_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times given as epoch milliseconds, recognised by their size."""
    rows = load(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp_utc"))
    return rows.select("event_id", text.epoch(ais_csv.timestamp_column(rows)).alias("t"))


@query("select event_id, epoch(date_trunc('minute', ts))::double as t from events")
def month_first_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy H:mm").alias("timestamp_utc"))
    return rows.select("event_id", text.epoch(ais_csv.timestamp_column(rows)).alias("t"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, epoch_us(ts) / 1e6::double as epoch, strftime(ts, '%Y-%m-%d %H:%M UTC') as label from events")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return load(spark, sf_dir, "events").select("event_id", text.iso(ts).alias("iso"), text.epoch(ts).alias("epoch"), text.utc_label(ts).alias("label"))


@query("""select event_id, case when event_id % 5 = 0 then 'analyst' when event_id % 3 = 0 then 'tiff_tag:ACQUISITION_TIME' when event_id % 3 = 1 then 'tiff_tag:TIFFTAG_DATETIME' when event_id % 2 = 0 then 'filename_timestamp' else 'assumed_now' end as label,
    case when event_id % 5 = 0 or event_id % 3 < 2 or event_id % 2 = 0 then epoch(date_trunc('second', ts))::bigint end as t, case when event_id % 3 = 0 then 'VV' when event_id % 2 = 0 then 'HH' end as polarisation from events""")
def scene_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyst's time before tags before the name; polarisation by tag, then by name."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    tags = F.when(i % 3 == 0, F.create_map(F.lit("ACQUISITION_TIME"), text.iso(ts), F.lit("POLARISATION"), F.lit("vv"))).when(i % 3 == 1, F.create_map(F.lit("TIFFTAG_DATETIME"), F.date_format(ts, "yyyy:MM:dd HH:mm:ss"))).otherwise(F.create_map().cast("map<string,string>"))
    name = F.when(i % 2 == 0, F.concat(F.lit("s_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_hh.tif"))).otherwise(F.lit("plain.png"))
    rows = load(spark, sf_dir, "events").select(i, F.when(i % 5 == 0, F.date_trunc("second", ts)).alias("given"), tags.alias("tags"), name.alias("name"))
    found = rows.select("event_id", text.scene_time_found(F.col("given"), F.col("tags"), F.col("name")).alias("found"), text.polarisation(F.col("tags"), F.col("name")).alias("polarisation"))
    t, label = F.col("found.t"), F.col("found.label")
    return found.select("event_id", label.alias("label"), F.when(label != "assumed_now", F.unix_seconds(t)).alias("t"), "polarisation")


@query("select event_id as row, nullif(trim(case when event_id % 3 = 0 then '  ' else ' V ' || user_id || ' ' end), '') as vessel_name, nullif(trim(lower(upper(event_type))), '') as vessel_type, case when event_id % 4 = 0 then 'analyst' else 'feed' end as source from events")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("row")
    rows = raw_rows(spark, sf_dir).withColumn("vessel_type", F.upper("vessel_type")).withColumn("source", F.when(i % 4 == 0, " ").otherwise("feed"))
    names = load(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" V "), F.col("user_id").cast("string"), F.lit(" "))).alias("given"))
    rows = rows.join(names, "row").withColumn("vessel_name", F.col("given"))
    return ais_csv.normalised(rows, "analyst", ts=F.try_to_timestamp(F.col("timestamp_utc"))).select("row", "vessel_name", "vessel_type", "source")


@query(f"with {AIS} select count(*) as positions, count(distinct mmsi) as vessels, min(ts_epoch) as t0, max(ts_epoch) as t1, min(lon) as west, max(lat) as north, coalesce(bool_or(contains(lower(vessel_type), 'synth')), false) as synthetic from ais")
def import_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ais_csv.summary(fixes(spark, sf_dir).withColumn("source", F.col("vessel_type")))
    return s.select("positions", "vessels", text.epoch(F.col("time_start")).alias("t0"), text.epoch(F.col("time_end")).alias("t1"), "west", "north", "synthetic")


@query(f"with {AIS} select seq, round({_diff('cog', 'sog * 20')}, 6) as off from ais")
def angle_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).select("seq", r6(geo.angular_diff_deg(F.col("cog"), F.col("sog") * 20)).alias("off"))


@query("select l_orderkey, l_linenumber, round(71.6::double + (l_partkey % 50) * (0.5::double / 50), 6) as lon, round(18.7::double - l_linenumber * (0.5::double / 8), 6) as lat from lineitem")
def pixel_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.pixel_lonlat(F.col("l_linenumber"), F.col("l_partkey") % 50, (71.6, 18.2, 72.1, 18.7), 8, 50)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(lon).alias("lon"), r6(lat).alias("lat"))


_N3 = geo.WGS84_F / (2 - geo.WGS84_F)
_UTM_SQL = f"""q as (select seq, lon, lat, sin(radians(lat)) as s, radians(lon - 69.0::double - 6.0::double * (case when lon >= 72 then 1 else 0 end)) as dl from ais), t as (select *, sinh(atanh(s) - {d(geo.E2 ** 0.5)} * atanh({d(geo.E2 ** 0.5)} * s)) as t from q),
    u as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from t)"""


@query(f"""with {AIS}, {_UTM_SQL} select seq, round(500000 + 0.9996::double * {d(geo.WGS84_A / (1 + _N3) * (1 + _N3**2 / 4 + _N3**4 / 64))} * (eta + {' + '.join(f'{d(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)' for j, a in enumerate((_N3 / 2 - 2 * _N3**2 / 3 + 5 * _N3**3 / 16, 13 * _N3**2 / 48 - 3 * _N3**3 / 5, 61 * _N3**3 / 240), 1))}), 3) as east,
    round(0.9996::double * {d(geo.WGS84_A / (1 + _N3) * (1 + _N3**2 / 4 + _N3**4 / 64))} * (xi + {' + '.join(f'{d(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)' for j, a in enumerate((_N3 / 2 - 2 * _N3**2 / 3 + 5 * _N3**3 / 16, 13 * _N3**2 / 48 - 3 * _N3**3 / 5, 61 * _N3**3 / 240), 1))}), 3) as north from u""")
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixes(spark, sf_dir)
    east, north = geo.utm_xy(F.col("lon"), F.col("lat"), geo.utm_epsg(F.col("lon"), F.col("lat")))
    return rows.select("seq", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


def _rectangles(spark: SparkSession, sf_dir: str) -> list[tuple[int, geo.Ring]]:
    """One rectangle for each nation, on the driver: the polygons of a case are few."""
    keys = sorted(r[0] for r in load(spark, sf_dir, "nation").select("n_nationkey").collect())
    return [(k, [(70.0 + k, -30.0 + 2 * k), (70.5 + k + k / 50, -30.0 + 2 * k), (70.5 + k + k / 50, -29.0 + 2 * k), (70.0 + k, -29.0 + 2 * k), (70.0 + k, -30.0 + 2 * k)]) for k in keys]


_BOX_SQL = "bx as (select n_nationkey as k, 70.0::double + n_nationkey as x0, 70.5::double + n_nationkey + n_nationkey / 50.0::double as x1, -30.0::double + 2 * n_nationkey as y0, -29.0::double + 2 * n_nationkey as y1 from nation)"
_Q = f"((1 - {d(geo.E2)}) * (sin(radians({{0}})) / (1 - {d(geo.E2)} * power(sin(radians({{0}})), 2)) + atanh({d(geo.E2 ** 0.5)} * sin(radians({{0}}))) / {d(geo.E2 ** 0.5)}))"


@query(f"with {_BOX_SQL} select k, round(radians(x1 - x0) * ({_Q.format('y1')} - {_Q.format('y0')}) * {d(geo.WGS84_A ** 2 / 2 / 1e6)}, 4) as area_km2, round((2 * (y1 - y0) * {_MLAT.format('(y0 + y1) / 2')} + (x1 - x0) * ({_MLON.format('y0')} + {_MLON.format('y1')})) / 1000, 6) as perimeter_km, round((x0 + x1) / 2, 6) as lon, round((y0 + y1) / 2, 6) as lat from bx")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for k, ring in _rectangles(spark, sf_dir):
        m = geo.shape_metrics(ring)
        rows.append((k, round(m["area_km2"], 4), round(m["perimeter_km"], 6), round(m["centroid"][0], 6), round(m["centroid"][1], 6)))
    return spark.createDataFrame(rows, "k int, area_km2 double, perimeter_km double, lon double, lat double")


@query("with b as (select n_nationkey as k, 70.0::double + n_nationkey as x0, 70.5::double + n_nationkey + n_nationkey / 50.0::double as x1, -30.0::double + 2 * n_nationkey as y0, -29.0::double + 2 * n_nationkey as y1 from nation) " + f"select k, round(x0 - 5000 / greatest(1.0::double, {_MLON.format('greatest(abs(y0), abs(y1))')}), 8) as west, round(y0 - 5000 / {_MLAT.format('(y0 + y1) / 2')}, 8) as south, round(x1 + 5000 / greatest(1.0::double, {_MLON.format('greatest(abs(y0), abs(y1))')}), 8) as east, round(y1 + 5000 / {_MLAT.format('(y0 + y1) / 2')}, 8) as north from b")
def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, *[round(v, 8) for v in geo.padded_bounds(ring, 5.0)]) for k, ring in _rectangles(spark, sf_dir)]
    return spark.createDataFrame(rows, "k int, west double, south double, east double, north double")


# ------------------------------------------------------------------ catalogue, registry and fields

@query("select o_orderkey as k, 's3://b/' || o_orderkey || case when o_orderkey % 2 = 0 then '?v=1&sig=abc' else '?sig=abc' end as href from orders")
def signed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    items = load(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("s3://b/"), k.cast("string"), F.when(k % 2 == 0, "?v=1").otherwise("")).alias("href"))
    return scenes.signed(items, "?sig=abc")


@query("select left(sha256(string_agg(n_name, chr(10) order by n_nationkey) || chr(10)), 16) as version from nation")
def model_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a file, here of the nations' names."""
    at = f"{shared_dir(spark)}/file-{uuid.uuid4().hex}"
    load(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(at)
    return spark.createDataFrame([(raster.model_hash(spark, f"{at}/*.txt"),)], "version string")


_ITEMS_SQL = "it as (select o_orderkey::varchar as item_id, case when o_orderkey % 3 = 0 then 'other' else 'sentinel-1-grd' end as collection, o_orderdate::timestamp as acquired, 60.0::double + o_custkey % 20 as west, 10.0::double + o_orderkey % 10 as south from orders)"


@query(f"with {_ITEMS_SQL} select item_id, epoch(acquired)::bigint as t from it where collection = 'sentinel-1-grd' and west <= 72 and west + 2.5::double >= 70 and south <= 16 and south + 1.5::double >= 14 and acquired between timestamp '1994-01-01' and timestamp '1996-12-31' order by acquired desc, item_id limit 50")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    west, south = F.lit(60.0) + F.col("o_custkey") % 20, F.lit(10.0) + k % 10
    items = load(spark, sf_dir, "orders").select(k.cast("string").alias("item_id"), F.when(k % 3 == 0, "other").otherwise("sentinel-1-grd").alias("collection"), F.col("o_orderdate").cast("timestamp").alias("acquired"), west.alias("west"), south.alias("south"), (west + 2.5).alias("east"), (south + 1.5).alias("north"))
    return scenes.search(items, [70, 14, 72, 16], "1994-01-01", "1996-12-31", 50).select("item_id", F.unix_seconds("acquired").alias("t"))


@query("select s_suppkey as reg_mmsi, case when s_suppkey % 2 = 0 then s_name else 'R' || s_suppkey end as name from supplier where contains(lower(case when s_suppkey % 2 = 0 then s_name else 'R' || s_suppkey end), '1') or s_suppkey::varchar = '1' order by s_suppkey limit 5")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    reg = load(spark, sf_dir, "supplier").select(k.alias("reg_mmsi"), F.when(k % 2 == 0, F.col("s_name")).alias("registry_name"), F.concat(F.lit("R"), k.cast("string")).alias("reported_name"), F.lit(None).cast("string").alias("imo"), k.alias("pos"))
    return registry.search(reg, " 1 ").select("reg_mmsi", "name")


_FIELD = f"fl as (select cast(floor(ts_epoch / 86400) as double) * 86400 as epoch, cast(k % 4 as double) as lat, cast(k // 4 % 4 as double) as lon, avg(sog) * 0.514444::double as uc, avg(cog) / 100 * 0.514444::double as vc, avg(value) / 100 as uw, avg(k) / 10.0::double as vw from ais group by all)"


def _gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field from a table under the names of met-ocean files, currents in knots."""
    k = F.col("k")
    table = fixes(spark, sf_dir).groupBy((F.floor(F.col("ts_epoch") / 86400).cast("double") * 86400).alias("time"), (k % 4).cast("double").alias("latitude"), (F.floor(k / 4) % 4).cast("double").alias("longitude")).agg(
        F.avg("sog").alias("uo"), (F.avg("cog") / 100).alias("vo"), (F.avg("value") / 100).alias("u10"), (F.avg("k") / 10.0).alias("v10"))
    return fields.from_table(table, {"u_cur": "kn", "v_cur": "kn"})


@query(f"with {AIS}, {_FIELD} select round(avg(sqrt(uc * uc + vc * vc)), 6) as mean_current_ms, round(max(sqrt(uc * uc + vc * vc)), 6) as max_current_ms, round(avg(sqrt(uw * uw + vw * vw)), 6) as mean_wind_ms, round(max(sqrt(uw * uw + vw * vw)), 6) as max_wind_ms, min(epoch) as time_start, max(epoch) as time_end, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from fl")
def field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fields.summary(_gridded(spark, sf_dir))
    return s.select(*[r6(c).alias(c) for c in ("mean_current_ms", "max_current_ms", "mean_wind_ms", "max_wind_ms")], "time_start", "time_end", "west", "south", "east", "north")


@query(f"with {AIS}, {_FIELD}, m as (select avg(uc) as uc, avg(vc) as vc, avg(uw) as uw, avg(vw) as vw from fl) select round(sqrt(uc * uc + vc * vc), 6) as current_ms, round((degrees(atan2(uc, vc)) + 360) % 360, 6) as current_towards_deg, round(sqrt(uw * uw + vw * vw), 6) as wind_ms, round((degrees(atan2(uw, vw)) + 360) % 360, 6) as wind_towards_deg from m")
def field_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fields.mean_vector(_gridded(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query(f"""with {AIS}, {_FIELD}, e as (select min(epoch) as a, max(epoch) as b, min(lon) as w, max(lon) as x, min(lat) as s, max(lat) as n from fl), asked as (select n_nationkey as k, 1704067200.0::double - 86400 * (n_nationkey % 3) as t0, 1704067200.0::double + 86400 * n_nationkey as t1, n_nationkey / 10.0::double as east from nation)
    select k, (a > t0 + 1800 or b < t1 - 1800)::int + (w > 0.0::double + 0.05::double or x < east - 0.05::double or s > 0.05::double or n < 3.0::double - 0.05::double)::int as problems from asked, e""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a field lacks for each of some requests."""
    field = _gridded(spark, sf_dir).cache()
    keys = sorted(r[0] for r in load(spark, sf_dir, "nation").select("n_nationkey").collect())
    rows = [(k, len(fields.problems(field, [0.0, 0.0, k / 10.0, 3.0], 1704067200.0 - 86400 * (k % 3), 1704067200.0 + 86400 * k))) for k in keys]
    return spark.createDataFrame(rows, "k int, problems int")


@query(f"""with {AIS}, h as (select k % 4 as lat, k // 4 % 4 as lon, floor(ts_epoch / 3600) * 3600 as t, avg(sog) as cv, avg(cog) as cd, avg(value) as wv, avg(k * 3.0::double) as wd from ais group by all)
    select lat::double as lat, lon::double as lon, t as epoch, round(cv / 3.6::double * sin(radians(cd)), 6) + 0.0::double as u_cur, round(cv / 3.6::double * cos(radians(cd)), 6) + 0.0::double as v_cur, round(-wv / 3.6::double * sin(radians(wd)), 6) + 0.0::double as u_wind, round(-wv / 3.6::double * cos(radians(wd)), 6) + 0.0::double as v_wind from h""")
def hourly_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed point forecasts, arrays of hours side by side, as a field."""
    k = F.col("k")
    hours = fixes(spark, sf_dir).groupBy((k % 4).cast("double").alias("lat"), (F.floor(k / 4) % 4).cast("double").alias("lon"), (F.floor(F.col("ts_epoch") / 3600) * 3600).cast("long").alias("time")).agg(F.avg("sog").alias("cv"), F.avg("cog").alias("cd"), F.avg("value").alias("wv"), F.avg(k * F.lit(3.0)).alias("wd"))
    points = hours.groupBy("lat", "lon").agg(F.collect_list(F.struct("time", "cv", "cd", "wv", "wd")).alias("h"))
    points = points.select("lat", "lon", F.struct(F.col("h.time").alias("time"), F.col("h.cv").alias("current_velocity"), F.col("h.cd").alias("current_direction"), F.col("h.wv").alias("wind_speed"), F.col("h.wd").alias("wind_direction")).alias("hourly"))
    out = fields.from_hourly_json(points)
    return out.select("lat", "lon", "epoch", *[(r6(c) + 0.0).alias(c) for c in fields.PARTS])


@query("select e.e as epoch, y.y as lat, x.x as lon, 0.25::double as u_cur, 0.05::double as v_cur, 3.0::double as u_wind, 1.0::double as v_wind from (values (-3600.0::double), (7200.0::double)) e(e), (values (17.0::double), (18.5::double), (20.0::double)) y(y), (values (70.0::double), (71.5::double), (73.0::double)) x(x)")
def constant_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.constant(spark, [71.0, 18.0, 72.0, 19.0], 0.0, 3600.0, {"u_current": 0.25, "v_current": 0.05, "u_wind": 3.0, "v_wind": 1.0})


# ------------------------------------------------------------------ drift and density

_POINT = [(72.0, 18.0)] * 4 + [(72.0, 18.0)]


def _drifted(spark: SparkSession, integrator: str, v: float) -> DataFrame:
    """The control run of a particle in a steady current, a day back in quarter hours."""
    p = drift_params({"ensemble_members": 2, "particle_count": 50, "diffusion_m2_s": 0.0, "integrator": integrator, "hindcast_hours": 24, "time_step_minutes": 15})
    field = fields.Grid.of(fields.constant(spark, [70, 16, 74, 20], -90000.0, 0.0, {"u_current": 0.2, "v_current": v, "u_wind": 0.0, "v_wind": 0.0}))
    out = drift.integrate(spark, _POINT, field, 0.0, p).where(f"member = {density.CONTROL}")
    return out.groupBy("step").agg(F.round(F.avg("lon"), 9).alias("lon"), F.round(F.avg("lat"), 9).alias("lat"), F.min("epoch").alias("epoch"), F.count("*").alias("particles"))


@query(f"with recursive t as (select 0 as step, 72.0::double as lon, 18.0::double as lat union all select step + 1, lon - 900 * 0.2::double / {_MLON.format('lat')}, lat - 900 * 0.1::double / {_MLAT.format('lat')} from t where step < 96) select step, round(lon, 9) as lon, round(lat, 9) as lat, 0.0::double - 900.0::double * step as epoch, 50 as particles from t")
def drift_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drifted(spark, "euler", 0.1)


@query(f"""with recursive t as (select 0 as step, 72.0::double as lon, 18.0::double as lat union all select step + 1, lon + (a + 2 * b + 2 * c + e) / 6, lat + (p + 2 * q + 2 * r + s) / 6 from
    (select *, -900 * 0.2::double / {_MLON.format('lat + r')} as e, -900 * 0.1::double / {_MLAT.format('lat + r')} as s from (select *, -900 * 0.2::double / {_MLON.format('lat + q / 2')} as c, -900 * 0.1::double / {_MLAT.format('lat + q / 2')} as r from
    (select *, -900 * 0.2::double / {_MLON.format('lat + p / 2')} as b, -900 * 0.1::double / {_MLAT.format('lat + p / 2')} as q from (select *, -900 * 0.2::double / {_MLON.format('lat')} as a, -900 * 0.1::double / {_MLAT.format('lat')} as p from t where step < 96) k1) k2) k3) k4)
    select step, round(lon, 9) as lon, round(lat, 9) as lat, 0.0::double - 900.0::double * step as epoch, 50 as particles from t""")
def drift_rk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drifted(spark, "rk4", 0.1)


@query(f"with recursive t as (select 0 as step, s.s as scenario, 72.0::double as lon from (values (0), (1), (2)) s(s) union all select step + 1, scenario, lon - 900 * (0.2::double + (0.01::double * (scenario + 1)) * 10.0::double) / {_MLON.format('18.0::double')} from t where step < 24) select step, scenario, round(lon, 9) as lon from t")
def windage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windages in one job; the control run drifts with each range's middle."""
    p = drift_params({"ensemble_members": 2, "particle_count": 50, "diffusion_m2_s": 0.0, "hindcast_hours": 6, "time_step_minutes": 15})
    field = fields.Grid.of(fields.constant(spark, [70, 16, 74, 20], -90000.0, 0.0, {"u_current": 0.2, "v_current": 0.0, "u_wind": 10.0, "v_wind": 0.0}))
    out = drift.windage_sweep(spark, _POINT, field, 0.0, p, [(0.01 * n, 0.01 * n) for n in (1, 2, 3)]).where(f"member = {density.CONTROL}")
    return out.groupBy("scenario", "step").agg(F.round(F.avg("lon"), 9).alias("lon"))


@query(f"with {AIS}, e as (select min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from ais), p as (select *, greatest((x1 - x0) * 0.05::double, 0.002::double) as px, greatest((y1 - y0) * 0.05::double, 0.002::double) as py from e) select round(x0 - px, 9) as x0, round(y0 - py, 9) as y0, round((x1 - x0 + 2 * px) / 60, 9) as dx, round((y1 - y0 + 2 * py) / 60, 9) as dy, 60 as cells, round((x1 - x0 + 2 * px) / 60 * {_MLON.format('(y0 + y1) / 2')} * (y1 - y0 + 2 * py) / 60 * {_MLAT.format('(y0 + y1) / 2')} / 1e6::double, 6) as cell_km2 from p")
def grid_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = density.grid_of(fixes(spark, sf_dir))
    return spark.createDataFrame([(round(g["x0"], 9), round(g["y0"], 9), round(g["dx"], 9), round(g["dy"], 9), g["cells"], round(g["cell_km2"], 6))], "x0 double, y0 double, dx double, dy double, cells int, cell_km2 double")


@query(f"""with {AIS}, {_ENS_SQL}, h as (select step, cast(least(floor((lon - 71.6::double) / 0.025::double), 19) as int) as ix, cast(least(floor((lat - 18.2::double) / 0.025::double), 19) as int) as iy, count(*) as n from p where member <> -1 group by all),
    c as (select *, (sum(n) over (partition by step order by n desc, ix, iy rows unbounded preceding) - n) / sum(n) over (partition by step) as before, n / sum(n) over (partition by step) as share from h), ar as (select step, count(*) * 7.0::double as area_km2, max(share) as peak from c where before < 0.7::double group by step),
    ce as (select step, avg(lon) as lon, avg(lat) as lat from p where member <> -1 group by step) select ar.step, area_km2, round(peak, 6) as peak_density, round(lon, 6) as lon, round(lat, 6) as lat from ar join ce using (step) where step in (select step from p where member = -1)""")
def region_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = density.step_metrics(_ensemble(spark, sf_dir), _GRID, 0.7)
    return out.select("step", "area_km2", r6("peak_density").alias("peak_density"), r6("lon").alias("lon"), r6("lat").alias("lat"))


_SHOWN = "p as (select cast(mmsi % 6 - 1 as int) as member, seq as particle, cast(floor((ts_epoch - 1704067200.0::double) / 259200) as int) as step, lon, lat from ais)"


@query(f"""with {AIS}, {_ENS_SQL}, h as (select step, cast(least(floor((lon - 71.6::double) / 0.025::double), 19) as int) as ix, cast(least(floor((lat - 18.2::double) / 0.025::double), 19) as int) as iy, count(*) as n from p where member <> -1 and (step % 2 = 0 or step = (select max(step) from p where member <> -1)) group by all),
    c as (select *, (sum(n) over (partition by step order by n desc, ix, iy rows unbounded preceding) - n) / sum(n) over (partition by step) as before from h) select step, count(*) as cells from c where before < 0.7::double group by step""")
def shown_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of every second step and the last as outlines, measured in cells."""

    def cells(rings: list[geo.Ring]) -> int:
        twice = sum(a[0] * b[1] - b[0] * a[1] for r in rings for a, b in zip(r[:-1], r[1:], strict=True))
        return round(abs(twice) / 2 / (_GRID["dx"] * _GRID["dy"]))

    rows = [(r["step"], cells(r["rings"])) for r in density.step_regions(_ensemble(spark, sf_dir), _GRID, 0.7, 2)]
    return spark.createDataFrame(rows, "step int, cells long")


@query(f"with {AIS}, {_SHOWN} select particle, step from p where step = (select max(step) from p)")
def last_step_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.last_step(_ensemble(spark, sf_dir)).select("particle", "step")


@query(f"with {AIS}, {_SHOWN}, s as (select step, count(*) as n from p group by step) select step, n from s where step % 3 = 0 or step = (select max(step) from s)")
def third_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.every_third(_ensemble(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n")))


@query(f"with {AIS}, {_SHOWN}, s as (select member, step, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat from p group by all) select member, string_agg(lon::varchar || ' ' || lat::varchar, ';' order by step) as line from s group by member")
def centroid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _ensemble(spark, sf_dir).groupBy("member", "step").agg(r6(F.avg("lon")).alias("lon"), r6(F.avg("lat")).alias("lat"))
    lines = views.centroid_line(steps, "member")
    return lines.select("member", F.array_join(F.transform("line", lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string"))), ";").alias("line"))


@query(f"with {AIS}, r as (select mmsi, seq, row_number() over (partition by mmsi order by ts_epoch, seq) as rn from ais) select mmsi, string_agg(seq::varchar, ',' order by rn) as path from r where rn <= greatest(2, mmsi % 7) group by mmsi")
def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tracks.lines(fixes(spark, sf_dir), 10**9)
    out = views.path_until(paths, (F.col("mmsi") % 7).cast("int"))
    return out.select("mmsi", F.array_join(F.transform("path", lambda p: p["seq"].cast("string")), ",").alias("path"))


@query(f"with {AIS}, {_SHOWN} select step, particle, round(lon, 6) as lon from p")
def forecast_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _ensemble(spark, sf_dir).groupBy("step", F.pmod("particle", F.lit(64)).alias("part")).agg(F.collect_list(F.struct("particle", "lon")).alias("points"))
    return views.forecast_points(steps).select("step", "particle", r6("lon").alias("lon"))


@query(f"with {AIS}, a as (select lon, lat from ais union all select 60.0::double + n_nationkey, 5.0::double + n_nationkey from nation) select min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from a")
def camera_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return views.layer_bounds(fixes(spark, sf_dir), load(spark, sf_dir, "nation").select((F.lit(60.0) + k).alias("lon"), (F.lit(5.0) + k).alias("lat")))


@query("select event_id, greatest(0, least(event_id % 200 - 20, user_id % 97)) as step from events")
def replay_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", views.replay_step(F.col("event_id") % 200 - 20, F.col("user_id") % 97 + 1).alias("step"))


# ------------------------------------------------------------------ rasters


@query("""with t as (select l_orderkey, l_linenumber - 1 as r, l_partkey % 4 as c, (l_quantity / 50)::float as p from lineitem), g as (select l_orderkey % 50 as scene, l_linenumber as tile, (l_orderkey // 50) % 16 as i, max((l_quantity / 50)::float) as p from lineitem group by all),
    f as (select s.scene, s.tile, i.i, coalesce(g.p, 0::float) as p from (select distinct scene, tile from g) s cross join range(0, 16) i(i) left join g on g.scene = s.scene and g.tile = s.tile and g.i = i.i),
    x as (select scene, i // 4 as row, (tile - 1) * 2 + i % 4 as col, p::double as p, greatest(0.5::double - 0.5::double * cos(2 * 3.141592653589793::double * ((i // 4) + 0.5::double) / 4), 1e-3::double) * greatest(0.5::double - 0.5::double * cos(2 * 3.141592653589793::double * ((i % 4) + 0.5::double) / 4), 1e-3::double) as k from f)
    select scene, row::int as row, col::int as col, round(sum(p * k) / sum(k), 6) as p_oil from x group by all""")
def mosaic_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 4 x 4 pixels that overlap by two columns, blended by their windows."""
    return raster.mosaic(_tiles(spark, sf_dir)).select(F.col("scene_id").cast("long").alias("scene"), "row", "col", r6("p_oil").alias("p_oil"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    cells = load(spark, sf_dir, "lineitem").groupBy((k % 50).alias("scene"), F.col("l_linenumber").alias("tile"), (F.floor(k / 50) % 16).cast("int").alias("i")).agg(F.max((F.col("l_quantity") / 50).cast("float")).alias("p"))
    tiles = cells.groupBy("scene", "tile").agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0).cast("float")))
    return tiles.select(F.col("scene").cast("string").alias("scene_id"), F.lit(0).alias("r0"), ((F.col("tile") - 1) * 2).cast("int").alias("c0"), F.lit(4).alias("h"), F.lit(4).alias("w"), values.alias("p_oil"), F.lit(None).cast("array<float>").alias("p_la"))


@query(f"with {_PX_SQL}, b as (select distinct scene, row, col, value / 50.0::double as p from px) select scene, row, col, case when p >= 0.5::double then 'oil' else 'uncertain' end as class, p from b where p >= 0.35::double")
def threshold_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _px(spark, sf_dir).select("scene", "row", "col", (F.col("value") / 50.0).alias("p_oil")).distinct()
    return raster.classed(px).select("scene", "row", "col", "class", F.col("p_oil").alias("p"))


@query("""with px as (select distinct l_suppkey % 40 as scene, l_orderkey % 23 * 46 as r0, l_partkey % 23 * 46 as c0 from lineitem),
    u as (select distinct scene, r0, c0, scene || '-' || r0 || '-' || c0 as id from px) select scene, count(*)::bigint as regions, sum(900)::bigint as pixels from u group by scene""")
def connected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of 30 x 30 pixels with gaps between them, many of which a block's edge cuts: each is one region."""
    squares = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).cast("string").alias("scene_id"), (F.col("l_orderkey") % 23 * 46).cast("int").alias("r0"), (F.col("l_partkey") % 23 * 46).cast("int").alias("c0")).distinct()
    side = F.sequence(F.lit(0), F.lit(29))
    px = squares.withColumn("a", F.explode(side)).withColumn("b", F.explode(side)).select("scene_id", F.lit("oil").alias("class"), (F.col("r0") + F.col("a")).alias("row"), (F.col("c0") + F.col("b")).alias("col"), F.lit(0.9).alias("p_oil"), F.lit(None).cast("double").alias("p_la"))
    stats = raster.zonal(raster.components(px))
    return stats.groupBy(F.col("scene_id").cast("long").alias("scene")).agg(F.countDistinct("region").alias("regions"), F.sum("pixel_count").alias("pixels"))


@query(f"with {_PX_SQL}, c as (select scene, quantile_cont(value, 0.02) as lo, quantile_cont(value, 0.98) as hi from px group by scene) select scene, count(*) as n, sum(coalesce(floor(greatest(0.0::double, least(1.0::double, (value - lo) / (greatest(hi, lo + 1e-6::double) - lo))) * 255), 0))::bigint as grey from px join c using (scene) group by scene")
def preview_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _px(spark, sf_dir).withColumn("db", F.col("value"))
    return raster.stretched(px, "scene").groupBy("scene").agg(F.count("*").alias("n"), F.sum("grey").alias("grey"))


@query("with p as (select l_orderkey % 20 as scene, l_linenumber as row, l_partkey % 50 as col, avg(l_quantity) as value from lineitem group by all) select row - 2 as row, (col - 10)::int as col, round(avg(value), 6) as value from p where scene = 3 and row between 2 and 6 and col between 10 and 39 group by all")
def window_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of an area of one scene, counted from the window's corner."""
    px = _px(spark, sf_dir).where("scene = 3").groupBy(F.col("scene").alias("scene_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.avg("value").alias("value"))
    out, _, _ = scenes.subset(px, (8, 50), [70.0, 10.0, 75.0, 10.8], [71.0 + 1e-9, 10.1 + 1e-9, 74.0 - 1e-9, 10.6 - 1e-9], margin=0)
    return out.select(F.col("row").cast("long").alias("row"), "col", r6("value").alias("value"))


# ------------------------------------------------------------------ store, layers and streams


def _moment(day: int) -> datetime:
    return datetime(2024, 1, 1 + day)


@query("""select 's' || p_partkey as id, 'c' || p_partkey % 50 as case_id, case when p_partkey % 3 = 0 then 'confirmed' else 'unreviewed' end as review_status, p_size::double as confidence from part where p_partkey % 5 > 0
    union all select 'late' || r_regionkey, 'c' || r_regionkey, 'unreviewed', 0.5::double from region""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's table after appends, new versions of a third of the rows and deletion of a fifth."""
    kept = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    none = F.lit(None).cast("string")
    k = F.col("p_partkey")
    slicks = load(spark, sf_dir, "part").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.concat(F.lit("c"), (k % 50).cast("string")).alias("case_id"), none.alias("scene_id"), none.alias("geom"), F.lit("oil").alias("class"), F.col("p_size").cast("double").alias("confidence"), none.alias("properties"), F.lit("unreviewed").alias("review_status"), none.alias("review_note"), F.lit(_moment(0)).alias("created_at"), k.alias("k"))
    kept.write("slicks", slicks)
    kept.write("slicks", slicks.where("k % 3 = 0").withColumn("review_status", F.lit("confirmed")))
    kept.delete("slicks", F.substring("id", 2, 20).cast("long") % 5 == 0)
    r = F.col("r_regionkey").cast("string")
    kept.write("slicks", load(spark, sf_dir, "region").select(F.concat(F.lit("late"), r).alias("id"), F.concat(F.lit("c"), r).alias("case_id"), none.alias("scene_id"), none.alias("geom"), F.lit("oil").alias("class"), F.lit(0.5).alias("confidence"), none.alias("properties"), F.lit("unreviewed").alias("review_status"), none.alias("review_note"), F.lit(_moment(1)).alias("created_at")))
    return kept.table("slicks").select("id", "case_id", "review_status", "confidence")


@query("""with sc as (select o_custkey as case_id, arg_max(o_orderkey, (o_orderdate, o_orderkey::varchar)) as scene_id, arg_max(o_orderdate, (o_orderdate, o_orderkey::varchar)) as acquired_on from orders group by all), sl as (select o_custkey as case_id, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by all)
    select c_custkey::varchar as case_id, c_name as name, case when c_custkey % 2 = 0 then 'synthetic' else 'real' end as data_mode, scene_id::varchar as scene_id, epoch(acquired_on::timestamp)::bigint as acquired, coalesce(n, 0) as n_slicks from customer left join sc on sc.case_id = c_custkey left join sl on sl.case_id = c_custkey""")
def case_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("c_custkey").cast("string"), load(spark, sf_dir, "orders")
    t = F.lit(_moment(0))
    cases = load(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_name").alias("name"), F.lit("open").alias("status"), F.when(F.col("c_custkey") % 2 == 0, "synthetic").otherwise("real").alias("data_mode"), t.alias("created_at"), t.alias("updated_at"))
    when = F.col("o_orderdate").cast("timestamp")
    found = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("case_id"), when.alias("acquisition_time"), when.alias("created_at"))
    slicks = load(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("case_id"))
    out = store.assembled(cases, found, slicks)
    return out.select("case_id", "name", "data_mode", "scene_id", F.unix_seconds("acquisition_time").alias("acquired"), "n_slicks")


@query("select 'c' || p_partkey % 50 as case_id, arg_min('s' || p_partkey, (case when p_partkey % 4 > 0 then 1 else 0 end, p_size, 's' || p_partkey)) as slick_id from part group by 1")
def default_slick(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    slicks = load(spark, sf_dir, "part").select(F.concat(F.lit("c"), (k % 50).cast("string")).alias("case_id"), F.concat(F.lit("s"), k.cast("string")).alias("slick_id"), F.when(k % 4 > 0, "uncertain").otherwise("oil").alias("class"), F.col("p_size").alias("rank"))
    return views.default_slick(slicks, "case_id")


@query("select n_nationkey as case_id, l.l as level, 'g' || l.l as geom from nation, (values (50), (70), (90)) l(l) where n_nationkey % 4 > 0 union all select n_nationkey, 70, 'o' || n_nationkey from nation where n_nationkey % 4 = 0")
def region_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = load(spark, sf_dir, "nation").select(k.alias("case_id"), F.concat(F.lit("o"), k.cast("string")).alias("geom"))
    regions = n.where("case_id % 4 > 0").select("case_id", F.explode(F.array(F.lit(50), F.lit(90), F.lit(70))).alias("level")).withColumn("geom", F.concat(F.lit("g"), F.col("level").cast("string")))
    return views.regions_largest_first(regions, n)


@query("select p_partkey as id, (p_size % 25)::int as rank from part order by rank, id")
def order_by_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slicks by a field of their JSON properties."""
    props = F.to_json(F.struct((F.col("p_size") % 25).alias("rank"), F.col("p_name").alias("name")))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), props.alias("properties"))
    return rows.withColumn("rank", F.get_json_object("properties", "$.rank").cast("int")).orderBy("rank", "id").select("id", "rank")


@query("select event_id::varchar as action, epoch_us(ts) as t from events")
def audit_latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("action"), F.col("ts").cast("timestamp").alias("ts"))
    return views.latest_first(log).select("action", F.unix_micros("ts").alias("t"))


@query("select case when c_custkey % 2 = 0 then 'synthetic' else 'real' end as data_mode, count(*) as n from customer group by all")
def cases_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("c_custkey") % 2 == 0, "synthetic").otherwise("real")
    return load(spark, sf_dir, "customer").groupBy(mode.alias("data_mode")).agg(F.count("*").alias("n"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a position report of the live feed, some off the map, some with sentinels."""
    e = load(spark, sf_dir, "events")
    i, none = F.col("event_id"), F.lit(None)
    meta = F.struct(F.when(i % 31 == 0, 0).otherwise(F.lit(419000000) + F.col("user_id")).cast("long").alias("MMSI"), F.lit(" ").alias("ShipName"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS' +0000 UTC'").alias("time_utc"))
    report = F.struct((F.lit(10.0) + i % 10).alias("Latitude"), F.when(i % 29 == 0, 181.0).otherwise(F.lit(70.0) + i % 10).alias("Longitude"), F.when(i % 3 == 0, 102.3).otherwise((i % 20).cast("double")).alias("Sog"), F.when(i % 5 == 0, 360.0).otherwise((i % 360).cast("double")).alias("Cog"), F.when(i % 7 == 0, 511.0).otherwise(1.0).alias("TrueHeading"))
    return e.select(F.lit("PositionReport").alias("MessageType"), none.cast("string").alias("error"), meta.alias("MetaData"), F.struct(report.alias("PositionReport"), none.cast("struct<Name: string, Type: long, Dimension: struct<A: double, B: double>>").alias("ShipStaticData")).alias("Message"))


def _statics(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """Static messages of a third of the vessels."""
    u = load(spark, sf_dir, "events").select("user_id").distinct().where(F.col("user_id") % 3 == part)
    none = F.lit(None)
    k = F.col("user_id")
    meta = F.struct((F.lit(419000000) + k).cast("long").alias("MMSI"), F.lit("x").alias("ShipName"), F.lit("2024-01-01 00:00:00").alias("time_utc"))
    static = F.struct(F.concat(F.lit("V"), k.cast("string")).alias("Name"), (k % 90).cast("long").alias("Type"), F.struct((k % 50).cast("double").alias("A"), F.lit(10.0).alias("B")).alias("Dimension"))
    return u.select(F.lit("ShipStaticData").alias("MessageType"), none.cast("string").alias("error"), meta.alias("MetaData"), F.struct(none.cast("struct<Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: double>").alias("PositionReport"), static.alias("ShipStaticData")).alias("Message"))


_LIVE = """m as (select event_id, user_id, 419000000 + user_id as mmsi, epoch(date_trunc('second', ts))::bigint as t, case when event_id % 3 > 0 then (event_id % 20)::double end as sog, case when event_id % 5 > 0 then (event_id % 360)::double end as cog, case when event_id % 7 > 0 then 1.0::double end as heading, 70.0::double + event_id % 10 as lon from events where event_id % 31 > 0 and event_id % 29 > 0)"""


@query(f"with {_LIVE} select mmsi, t, sog, cog, heading, lon, count(*) as n from m group by all")
def live_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recorder.routed(_messages(spark, sf_dir))
    return out.groupBy("mmsi", F.unix_seconds("ts").alias("t"), "sog", "cog", "heading", "lon").agg(F.count("*").alias("n"))


@query(f"""with {_LIVE}, s as (select *, user_id % 90 as c from m) select mmsi, t, lon, case when user_id % 3 < 2 then 'V' || user_id end as vessel_name, case when user_id % 3 < 2 then nullif((user_id % 50)::double + 10, 0) end as length_m,
    case when user_id % 3 < 2 and c > 0 then case when c between 61 and 69 then 'passenger' when c between 71 and 79 then 'cargo' when c between 81 and 89 then 'tanker' when c = 30 then 'fishing' when c in (31, 32, 52) then 'tug' when c = 36 then 'sailing' when c = 37 then 'pleasure' when c = 60 then 'passenger' when c = 70 then 'cargo' when c = 80 then 'tanker' else 'other' end end as vessel_type, count(*) as n from s group by all""")
def live_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all events: a third of the vessels are known before, a third after, a third never."""
    at = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    _statics(spark, sf_dir, 0).coalesce(1).write.mode("append").json(f"{at}/in")
    _messages(spark, sf_dir).write.mode("append").json(f"{at}/in")
    _statics(spark, sf_dir, 1).coalesce(1).write.mode("append").json(f"{at}/in")
    out = recorder.record(spark, f"{at}/in", f"{at}/out", f"{at}/state")["positions_frame"]
    return out.groupBy("mmsi", F.unix_seconds("ts").alias("t"), "lon", "vessel_name", "length_m", "vessel_type").agg(F.count("*").alias("n"))


@query("select event_id, (event_id - (select min(event_id) from events))::bigint as row from events")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered by place, as the CSV intake numbers its records."""
    ordered = load(spark, sf_dir, "events").select("event_id").orderBy("event_id")
    return ais_csv.numbered(ordered)


@query(f"with {AIS}, {_FIELD} select count(*) as nodes, true as same from fl")
def field_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's checksum doesn't depend on the order of its rows."""
    field = _gridded(spark, sf_dir).cache()
    a, b = fields.checksum(field), fields.checksum(field.repartition(5).orderBy(F.desc("lat"), "epoch"))
    return field.agg(F.count("*").alias("nodes")).withColumn("same", F.lit(a == b and len(a) == 64))


# ------------------------------------------------------------------ files and shapes


@query(f"with {AIS} select mmsi, epoch(date_trunc('second', ts))::bigint as t, round(lon, 6) as lon, round(lat, 6) as lat, round(sog, 4) as sog, vessel_type, count(*) as n from ais group by all")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixes written as CSV files and read again under other header names."""
    at = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    none = F.lit(None)
    rows = fixes(spark, sf_dir).withColumns({"heading": none.cast("double"), "length_m": none.cast("double"), "source": F.lit("s")})
    ais_csv.write_csv(rows, f"{at}/canonical")
    again = spark.read.option("header", True).csv(f"{at}/canonical")
    names = {"mmsi": "MMSI", "timestamp_utc": "BaseDateTime", "longitude": "LON", "latitude": "LAT", "sog_knots": "Speed", "vessel_type": "Ship type"}
    again.select(*[F.col(c).alias(n) for c, n in names.items()]).write.option("header", True).option("sep", ";").csv(f"{at}/aliases")
    out = ais_csv.normalised(ais_csv.read_csv(spark, f"{at}/aliases"), "feed").where("reason is null")
    return out.groupBy("mmsi", F.unix_seconds("ts").alias("t"), r6("lon").alias("lon"), r6("lat").alias("lat"), F.round("sog", 4).alias("sog"), "vessel_type").agg(F.count("*").alias("n"))


@query("select t.t * 1800.0::double as epoch, 17.0::double + 0.5::double * y.y as lat, 70.0::double + 0.5::double * x.x as lon, round(0.5::double * y.y + 0.25::double * x.x + 0.125::double * t.t, 3) as u_cur from range(0, 5) t(t), range(0, 7) y(y), range(0, 9) x(x)")
def replay_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is linear in place and time, sampled between its nodes."""
    nodes = spark.range(3 * 4 * 5).select((F.col("id") % 3).alias("e"), (F.floor(F.col("id") / 3) % 4).alias("y"), F.floor(F.col("id") / 12).alias("x"))
    u = F.col("y") * 1.0 + F.col("x") * 0.5 + F.col("e") * 0.25
    grid = fields.Grid.of(nodes.select((F.col("e") * 3600.0).alias("epoch"), (F.lit(17.0) + F.col("y")).alias("lat"), (F.lit(70.0) + F.col("x")).alias("lon"), *[u.alias(p) for p in fields.PARTS]))
    return fields.vectors(spark, grid, [1800.0 * k for k in range(5)], [70.0, 17.0, 74.0, 20.0]).select("epoch", "lat", "lon", "u_cur")


@query("select n_nationkey as k, least(3.0::double, 0.02::double + 5 * n_nationkey * 3600 / 111000.0::double) as pad from nation")
def area_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = sorted(r[0] for r in load(spark, sf_dir, "nation").select("n_nationkey").collect())
    return spark.createDataFrame([(k, drift.aoi_padding(5 * k)) for k in keys], "k int, pad double")


@query("select s.s as step from range(0, 98) s(s) where s.s < 97 and (s.s % 2 = 0 or s.s = 96)")
def half_hour_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = drift_params({"hindcast_hours": 24, "time_step_minutes": 15})
    return spark.createDataFrame([(s,) for s in drift.shown_steps(p)], "step long")


@query("with b as (select n_nationkey as k, 70.013::double + n_nationkey as x0, 70.513::double + n_nationkey + n_nationkey / 50.0::double as x1, -29.987::double + 2 * n_nationkey as y0, -28.987::double + 2 * n_nationkey as y1 from nation) select k, ((floor(x1 / 0.3::double) - floor(x0 / 0.3::double) + 1) * (floor(y1 / 0.3::double) - floor(y0 / 0.3::double) + 1))::bigint as pieces, round((x1 - x0) * (y1 - y0), 6) as area from b")
def land_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons cut by a grid: how many pieces, which together have the polygon's area."""
    moved = [(k, [(x + 0.013, y + 0.013) for x, y in ring]) for k, ring in _rectangles(spark, sf_dir)]
    cut = land.pieces(spark, [[ring] for _, ring in moved], 0.3)
    ring = F.col("rings")[0]
    sides = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    area = F.abs(F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)) / 2
    keys = spark.createDataFrame([(n, k) for n, (k, _) in enumerate(moved)], "piece_id long, k int")
    return cut.withColumn("area", area).groupBy("piece_id").agg(F.count("*").alias("pieces"), r6(F.sum("area")).alias("area")).join(keys, "piece_id").select("k", "pieces", "area")


@query("with c as (select min(l_linenumber)::double as a, max(l_linenumber)::double as b, min(l_partkey % 50)::double as c, max(l_partkey % 50)::double as d from lineitem) select a as lon, c as lat from c union all select a, d from c union all select b, c from c union all select b, d from c")
def swept_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of all cells of a lattice: its corners."""
    points = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("lon"), (F.col("l_partkey") % 50).cast("double").alias("lat"))
    return spark.createDataFrame(drift.swept_hull(points), "lon double, lat double")


@query("select n_nationkey as k, 'Polygon' as type, 5 as points, round(70.0::double + n_nationkey, 5) as west, round(-29.0::double + 2 * n_nationkey, 5) as north from nation")
def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for k, ring in _rectangles(spark, sf_dir):
        geometry = store.loads(store.dumps(geo.geojson_polygon([ring])))
        back = geo.shells(geometry)[0]
        rows.append((k, geometry["type"], len(back), min(x for x, _ in back), max(y for _, y in back)))
    return spark.createDataFrame(rows, "k int, type string, points int, west double, north double")


_LAND = [(cx, cy) for cx in range(715, 722, 2) for cy in range(181, 189, 3)]
_LAND_SQL = "ed as (select * from (values " + ", ".join(f"({d(ax)}, {d(ay)}, {d(bx)}, {d(by)})" for cx, cy in _LAND for x, y in [(cx * 0.1, cy * 0.1)] for (ax, ay), (bx, by) in (((x, y), (x + 0.04, y)), ((x + 0.04, y), (x, y + 0.04)), ((x, y + 0.04), (x, y)))) + ") e(x1, y1, x2, y2))"


@query(f"""with {AIS}, {_LAND_SQL}, p as (select seq, lon + 0.00131::double as lon, lat + 0.00071::double as lat, 111.0::double * greatest(0.2::double, cos(radians(lat + 0.00071::double))) as kx from ais),
    q as (select seq, (x1 - lon) * kx as ax, (y1 - lat) * 111.0::double as ay, (x2 - x1) * kx as dx, (y2 - y1) * 111.0::double as dy, ((y1 > lat) <> (y2 > lat)) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 as hit from p, ed),
    r as (select seq, min(sqrt(power(ax + greatest(0.0::double, least(1.0::double, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) * dx, 2) + power(ay + greatest(0.0::double, least(1.0::double, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) * dy, 2))) as km, coalesce(sum(hit::int), 0) % 2 = 1 as on_land from q group by seq)
    select seq, round(case when on_land then 0.0::double else least(3.0::double, km) end, 6) as land_km from r""")
def land_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fix's distance to small islands, three kilometres at most."""
    islands = [[[(cx * 0.1, cy * 0.1), (cx * 0.1 + 0.04, cy * 0.1), (cx * 0.1, cy * 0.1 + 0.04), (cx * 0.1, cy * 0.1)]] for cx, cy in _LAND]
    rows = fixes(spark, sf_dir).select("seq", (F.col("lon") + 0.00131).alias("lon"), (F.col("lat") + 0.00071).alias("lat"))
    return land.land_distance(rows, land.pieces(spark, islands, 0.5), 3.0, 0.5).select("seq", r6("land_km").alias("land_km"))


@query(f"""with {AIS}, {_LAND_SQL}, p as (select seq, lon + 0.00131::double as lon, lat + 0.00071::double as lat, 111.0::double * greatest(0.2::double, cos(radians(lat + 0.00071::double))) as kx from ais),
    q as (select seq, (x1 - lon) * kx as ax, (y1 - lat) * 111.0::double as ay, (x2 - x1) * kx as dx, (y2 - y1) * 111.0::double as dy, ((y1 > lat) <> (y2 > lat)) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 as hit from p, ed),
    r as (select seq, min(sqrt(power(ax + greatest(0.0::double, least(1.0::double, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) * dx, 2) + power(ay + greatest(0.0::double, least(1.0::double, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) * dy, 2))) as km, coalesce(sum(hit::int), 0) % 2 = 1 as on_land from q group by seq)
    select seq, round(case when on_land then 0.0::double else km end, 6) as land_km from r""")
def nearest_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fix's distance to the nearest small island, however far."""
    islands = [[[(cx * 0.1, cy * 0.1), (cx * 0.1 + 0.04, cy * 0.1), (cx * 0.1, cy * 0.1 + 0.04), (cx * 0.1, cy * 0.1)]] for cx, cy in _LAND]
    rows = fixes(spark, sf_dir).select("seq", (F.col("lon") + 0.00131).alias("lon"), (F.col("lat") + 0.00071).alias("lat"))
    return land.nearest_land(rows, land.pieces(spark, islands, 0.05), 0.05).select("seq", r6("land_km").alias("land_km"))
