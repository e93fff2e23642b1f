"""One query for each family of operators over the benchmark tables, with the same result in DuckDB's SQL.

Vessel positions are derived from ``events`` by fixed arithmetic; regions,
windows and clouds are literals.  Trigonometric results are rounded, as the two
engines differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS, weights
from tidewake.functions import geo, met, text
from tidewake.operators import attribution, density, land, raster, tracks
from tidewake.plans import store
from tidewake.sources import ais_csv, fields, registry
from tidewake.streaming import recorder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORIGIN = (71.85, 18.45)
BOX = [71.7, 18.25, 72.0, 18.6]
REGION = [(71.78, 18.33), (71.93, 18.31), (71.96, 18.47), (71.87, 18.56), (71.76, 18.49), (71.78, 18.33)]
OUTER = [(71.7, 18.3), (72.0, 18.3), (72.0, 18.6), (71.7, 18.6), (71.7, 18.3)]
RS, RE = 1704844800.0, 1705708800.0  # 2024-01-10 to 2024-01-20
PAD = 6 * 3600.0


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vessel view of ``events``; columns are derived row by row, so filters and pruning reach the scan."""
    e = load(spark, sf_dir, "events")
    k, v = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    kind = F.create_map(*[F.lit(x) for x in ("error", "tanker", "purchase", "cargo", "view", "fishing", "click", "80")])
    return e.select(
        F.col("event_id").alias("seq"), (F.lit(419000000) + F.col("user_id")).cast("long").alias("mmsi"), F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_epoch"),
        (F.lit(71.6) + k * F.lit(0.005)).alias("lon"), (F.lit(18.2) + F.pmod(v, F.lit(100.0)) * F.lit(0.005)).alias("lat"), F.pmod(v, F.lit(20.0)).alias("sog"), F.pmod(k * F.lit(3.6), F.lit(360.0)).alias("cog"),
        F.try_element_at(kind, F.col("event_type")).alias("vessel_type"), F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("vessel_name"), k.alias("k"), v.alias("value"),
    )


AIS = """ais as (select event_id as seq, cast(419000000 + user_id as bigint) as mmsi, ts, epoch_us(ts) / 1e6 as ts_epoch, 71.6::double + k * 0.005::double as lon, 18.2::double + (value % 100.0::double) * 0.005::double as lat,
    value % 20.0::double as sog, (k * 3.6::double) % 360.0::double as cog, case event_type when 'error' then 'tanker' when 'purchase' then 'cargo' when 'view' then 'fishing' when 'click' then '80' end as vessel_type,
    'V' || user_id as vessel_name, k, value from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e)"""
HAV = "2 * 6371.0088::double * asin(sqrt(least(1.0::double, power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return HAV.format(lon1=f"({lon1})", lat1=f"({lat1})", lon2=f"({lon2})", lat2=f"({lat2})")


BRG = "(degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))) + 360.0::double) % 360.0::double"


def d(x: float) -> str:
    return f"{x!r}::double"


def sql_in_ring(lon: str, lat: str, ring: geo.Ring) -> str:
    parts = [f"case when (({d(y1)} > {lat}) <> ({d(y2)} > {lat})) and {lon} < {d(x2 - x1)} * ({lat} - {d(y1)}) / {d(y2 - y1)} + {d(x1)} then 1 else 0 end" for x1, y1, x2, y2 in geo._edges(ring) if y1 != y2]
    return f"(({' + '.join(parts)}) % 2 = 1)"


def sql_ring_km(lon: str, lat: str, ring: geo.Ring) -> str:
    mx, my = geo.metres_per_degree_at(sum(y for _, y in ring) / len(ring))
    out = []
    for x1, y1, x2, y2 in geo._edges(ring):
        dx, dy = (x2 - x1) * mx, (y2 - y1) * my
        px, py = f"(({lon} - {d(x1)}) * {d(mx)})", f"(({lat} - {d(y1)}) * {d(my)})"
        t = f"greatest(0.0::double, least(1.0::double, ({px} * {d(dx)} + {py} * {d(dy)}) / {d(dx * dx + dy * dy)}))"
        out.append(f"sqrt(power({px} - {t} * {d(dx)}, 2) + power({py} - {t} * {d(dy)}, 2)) / 1000.0::double")
    return f"case when {sql_in_ring(lon, lat, ring)} then 0.0::double else least({', '.join(out)}) end"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


BOXED = f"f as (select * from ais where lon between {d(BOX[0])} and {d(BOX[2])} and lat between {d(BOX[1])} and {d(BOX[3])} and ts_epoch between {d(RS - PAD)} and {d(RE + PAD)})"
STEPS = "s as (select *, lag(ts_epoch) over w as prev_t, lead(ts_epoch) over w as next_t, lead(ts_epoch) over w - ts_epoch as dt, row_number() over w as rn from f window w as (partition by mmsi order by ts_epoch, seq))"
EXPECTED = "x as (select coalesce(quantile_cont(m, 0.5), 300.0::double) as expected_s from (select mmsi, quantile_cont(case when dt > 0 then dt end, 0.5) as m, count(*) as n from s group by mmsi) q where n > 3)"


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.in_box(fixes(spark, sf_dir), BOX, RS - PAD, RE + PAD)


# ------------------------------------------------------------------ attribution

_W = weights({k: (v if k in ("proximity", "ais_gap_relevance", "vessel_type") else 0.0) for k, v in DEFAULTS["attribution"]["weights"].items()})
_PRIOR = DEFAULTS["attribution"]["vessel_type_plausibility"]
_PRIOR_SQL = f"""coalesce({', '.join(f"case when lower(trim(vessel_type)) = '{k}' then {d(v)} end" for k, v in _PRIOR.items())}, {', '.join(f"case when contains(lower(trim(vessel_type)), '{k}') then {d(v)} end" for k, v in _PRIOR.items())},
    case when try_cast(trim(vessel_type) as int) between 80 and 89 then 1.0::double when try_cast(trim(vessel_type) as int) between 70 and 79 then 0.7::double when try_cast(trim(vessel_type) as int) = 30 then 0.4::double end, 0.5::double)"""
_BAND_SQL = "case when score >= 80 then 'high' when score >= 55 then 'medium' when score >= 30 then 'low' else 'insufficient' end"
_SCORE_CTE = f"""with {AIS}, {BOXED}, {STEPS}, {EXPECTED},
    dist as (select s.*, {hav('lon', 'lat', d(ORIGIN[0]), d(ORIGIN[1]))} as d_km from s),
    gaps as (select mmsi, dt, d_km, least(d_km, lead(d_km) over w) as near_km, greatest(0.0::double, least(next_t, {d(RE)}) - greatest(ts_epoch, {d(RS)})) as overlap from dist window w as (partition by mmsi order by ts_epoch, seq)),
    g as (select mmsi, count(*) as gaps, max(dt) / 60 as max_gap_min, max(case when near_km <= 25 and overlap > 0 then least(1.0::double, overlap / {d(RE - RS)}) * 0.7::double + 0.3::double when near_km <= 25 then 0.25::double else 0.0::double end) as g
        from gaps, x where dt > greatest(4.0::double * expected_s, 1200.0::double) group by mmsi),
    v as (select mmsi, count(*) as positions, min(d_km) as d_min, max(ts_epoch) - min(ts_epoch) as span_s, arg_min(vessel_type, (ts_epoch, seq)) filter (vessel_type is not null and vessel_type <> '') as vessel_type from dist group by mmsi having count(*) >= 2),
    fa as (select v.mmsi, positions, d_min, coalesce(gaps, 0) as gaps, coalesce(max_gap_min, 0.0::double) as max_gap_min, exp(-d_min / 15.0::double) as p, coalesce(g.g, 0.0::double) as g, {_PRIOR_SQL} as v,
        greatest(0.3::double, least(1.0::double, 0.5::double + 0.3::double * least(1.0::double, positions / greatest(span_s / 3600.0::double, 0.25::double) / 6.0::double) + 0.2::double * (0.5::double + case when vessel_type is not null then 0.5::double else 0.0::double end))) as dq
        from v left join g on v.mmsi = g.mmsi),
    sc as (select *, round(100.0::double * dq * ({d(_W['proximity'])} * p + {d(_W['ais_gap_relevance'])} * g + {d(_W['vessel_type'])} * v), 1) as score from fa)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity to a point, reporting gaps, type prior and data quality, ranked: one shuffle on mmsi."""
    steps = tracks.with_steps(boxed(spark, sf_dir)).withColumn("d_km", geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(ORIGIN[0]), F.lit(ORIGIN[1])))
    steps = steps.withColumn("near_km", F.least("d_km", F.lead("d_km").over(tracks.along())))
    expected = tracks.expected_interval_s(steps)
    found = tracks.gaps(steps, expected, (RS, RE))
    g = F.when((F.col("near_km") <= 25) & (F.col("overlap_s") > 0), F.least(F.lit(1.0), F.col("overlap_s") / (RE - RS)) * 0.7 + 0.3).when(F.col("near_km") <= 25, 0.25).otherwise(0.0)
    gaps = found.groupBy("mmsi").agg(F.count("*").alias("gaps"), (F.max("dt") / 60).alias("max_gap_min"), F.max(g).alias("g"))
    v = steps.groupBy("mmsi").agg(F.count("*").alias("positions"), F.min("d_km").alias("d_min"), (F.max("ts_epoch") - F.min("ts_epoch")).alias("span_s"), tracks.first_given("vessel_type").alias("vessel_type")).where("positions >= 2")
    fa = v.join(gaps, "mmsi", "left").select(
        "mmsi", "positions", "d_min", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("max_gap_min", F.lit(0.0)).alias("max_gap_min"), F.exp(-F.col("d_min") / 15.0).alias("p"), F.coalesce("g", F.lit(0.0)).alias("g"),
        attribution.type_prior(F.col("vessel_type")).alias("v"), attribution.data_quality(F.col("positions"), F.col("span_s"), F.lit(True), F.col("vessel_type").isNotNull()).alias("dq"))
    score = F.round(100.0 * F.col("dq") * (_W["proximity"] * F.col("p") + _W["ais_gap_relevance"] * F.col("g") + _W["vessel_type"] * F.col("v")), 1)
    return fa.withColumn("score", score)


@query(_SCORE_CTE + f" select row_number() over (order by score desc, mmsi) as rank, mmsi, positions, round(d_min, 6) as min_distance_km, gaps, round(max_gap_min, 6) as max_gap_min, round(p, 6) as p, round(g, 6) as g, round(v, 6) as v, round(dq, 6) as d, score, {_BAND_SQL} as priority from sc")
def vessel_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, sf_dir)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "mmsi")).cast("long")
    return out.select(rank.alias("rank"), "mmsi", "positions", r6("d_min").alias("min_distance_km"), "gaps", r6("max_gap_min").alias("max_gap_min"), r6("p").alias("p"), r6("g").alias("g"), r6("v").alias("v"), r6("dq").alias("d"), "score", attribution.priority(F.col("score")).alias("priority"))


@query(_SCORE_CTE + """ select mmsi, rank, round(new_score, 6) as new_score, new_rank, rank - new_rank as rank_change from (select *, row_number() over (order by new_score desc, rank) as new_rank from
    (select *, row_number() over (order by score desc, mmsi) as rank, 100.0::double * dq * (0.2::double * p + 0.5::double * g + 0.3::double * v) as new_score from sc) a) b""")
def whatif_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "mmsi")).cast("long"))
    out = out.withColumn("new_score", 100.0 * F.col("dq") * (0.2 * F.col("p") + 0.5 * F.col("g") + 0.3 * F.col("v")))
    out = out.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("new_score"), "rank")).cast("long"))
    return out.select("mmsi", "rank", r6("new_score").alias("new_score"), "new_rank", (F.col("rank") - F.col("new_rank")).alias("rank_change"))


@query(_SCORE_CTE + f""" select (select count(distinct mmsi) from ais) as vessels_in_dataset, (select count(distinct mmsi) from ais where ts_epoch between {d(RS - PAD)} and {d(RE + PAD)}) as vessels_in_time_window,
    (select count(distinct mmsi) from f) as vessels_in_search_region, count(*) as vessels_scored, coalesce(max(score) < 55, true) as dark_source_possible from sc""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts_epoch")
    one = fixes(spark, sf_dir).agg(F.countDistinct("mmsi").alias("vessels_in_dataset"), F.countDistinct(F.when(t.between(RS - PAD, RE + PAD), F.col("mmsi"))).alias("vessels_in_time_window"))
    two = boxed(spark, sf_dir).agg(F.countDistinct("mmsi").alias("vessels_in_search_region"))
    three = scored(spark, sf_dir).agg(F.count("*").alias("vessels_scored"), F.coalesce(F.max("score") < 55, F.lit(True)).alias("dark_source_possible"))
    return one.join(two).join(three)


@query(f"with {AIS} select coalesce(vessel_type, '') as vessel_type, round({_PRIOR_SQL}, 6) as prior, count(*) as n from ais group by all")
def type_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).groupBy(F.coalesce("vessel_type", F.lit("")).alias("vessel_type"), r6(attribution.type_prior(F.col("vessel_type"))).alias("prior")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ tracks


@query(f"with {AIS}, {BOXED} select seq, mmsi, ts_epoch, round(lon, 6) as lon, round(lat, 6) as lat from f")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(spark, sf_dir).select("seq", "mmsi", "ts_epoch", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query(f"with {AIS} select mmsi, count(*) as positions, min(ts_epoch) as t0, max(ts_epoch) as t1, arg_min(vessel_name, (ts_epoch, seq)) as vessel_name, arg_min(vessel_type, (ts_epoch, seq)) filter (vessel_type is not null) as vessel_type from ais group by mmsi order by mmsi limit 300")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixes(spark, sf_dir).withColumn("length_m", F.lit(None).cast("double"))
    return tracks.track_summary(rows, 300).drop("length_m")


@query(f"with {AIS}, f as (select * from ais), {STEPS}, {EXPECTED} select round(expected_s, 6) as expected_s from x")
def expected_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.expected_interval_s(tracks.with_steps(fixes(spark, sf_dir))).select(r6("expected_s").alias("expected_s"))


@query(f"with {AIS}, {BOXED}, {STEPS}, {EXPECTED} select mmsi, ts_epoch as gap_start, next_t as gap_end, round(dt / 60, 6) as minutes, round(greatest(0.0::double, least(next_t, {d(RE)}) - greatest(ts_epoch, {d(RS)})) / 60, 6) as overlap_min from s, x where dt > greatest(4.0::double * expected_s, 1200.0::double)")
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tracks.with_steps(boxed(spark, sf_dir))
    return tracks.gaps(steps, tracks.expected_interval_s(steps), (RS, RE)).select("mmsi", F.col("ts_epoch").alias("gap_start"), F.col("next_t").alias("gap_end"), r6(F.col("dt") / 60).alias("minutes"), r6(F.col("overlap_s") / 60).alias("overlap_min"))


@query(f"""with {AIS}, {BOXED}, {STEPS} select mmsi, round(greatest(0.0::double, least(sum(case when ts_epoch between {d(RS)} and {d(RE)} and {sql_in_ring('lon', 'lat', REGION)} then 0.5::double * (least(coalesce(next_t, ts_epoch), {d(RE)}) - greatest(coalesce(prev_t, ts_epoch), {d(RS)})) else 0.0::double end), {d(RE - RS)})), 3) as dwell_s from s group by mmsi""")
def dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.dwell_s(tracks.with_steps(boxed(spark, sf_dir)), geo.in_ring(F.col("lon"), F.col("lat"), REGION), (RS, RE))
    return out.select("mmsi", F.round("dwell_s", 3).alias("dwell_s"))


@query(f"""with {AIS}, {BOXED}, m as (select *, coalesce(sog <= 8.0::double, false) and {sql_ring_km('lon', 'lat', REGION)} <= 2.0::double as slow from f),
    s as (select mmsi, slow, coalesce(lead(slow) over w, false) as slow_next, lead(ts_epoch) over w - ts_epoch as dt from m window w as (partition by mmsi order by ts_epoch, seq))
    select mmsi, round(sum(case when slow and slow_next then least(dt, 3600.0::double) else 0.0::double end), 3) as loiter_s from s group by mmsi""")
def loiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.loiter_s(boxed(spark, sf_dir), geo.ring_distance_km(F.col("lon"), F.col("lat"), REGION), knots=8.0)
    return out.select("mmsi", F.round("loiter_s", 3).alias("loiter_s"))


@query(f"""with {AIS}, {BOXED}, dd as (select *, round({sql_ring_km('lon', 'lat', REGION)}, 6) as d from f), r as (select *, row_number() over (partition by mmsi order by d, ts_epoch, seq) as n, count(*) over (partition by mmsi) as positions from dd)
    select mmsi, positions, d as min_distance_km, ts_epoch as closest_t, round(lon, 6) as closest_lon, round(lat, 6) as closest_lat from r where n = 1""")
def closest_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.closest(boxed(spark, sf_dir), r6(geo.ring_distance_km(F.col("lon"), F.col("lat"), REGION)))
    return out.select("mmsi", "positions", "min_distance_km", "closest_t", r6("closest_lon").alias("closest_lon"), r6("closest_lat").alias("closest_lat"))


@query(f"""with {AIS}, {BOXED}, n as (select seq, first_value(lon) over w as a, first_value(lat) over w as b, last_value(lon) over w as c, last_value(lat) over w as e from f window w as (partition by mmsi order by ts_epoch, seq rows between 2 preceding and 2 following))
    select seq, round(case when {hav('a', 'b', 'c', 'e')} > 0.05::double then {BRG.format(lon1='a', lat1='b', lon2='c', lat2='e')} end, 6) as track_bearing from n""")
def neighbour_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.neighbour_bearing(boxed(spark, sf_dir)).select("seq", r6("track_bearing").alias("track_bearing"))


@query(f"with {AIS} select seq, {sql_in_ring('lon', 'lat', REGION)} as in_core, {sql_in_ring('lon', 'lat', OUTER)} as in_outer, round({sql_ring_km('lon', 'lat', REGION)}, 6) as d_core from ais")
def point_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.region_flags(fixes(spark, sf_dir), {"core": REGION, "outer": OUTER})
    return out.select("seq", "in_core", "in_outer", r6("d_core").alias("d_core"))


_CLOUD_DT, _CLOUD_N = 43200.0, 20
_CLOUD_SQL = f"cl as (select s.step::int as step, k.k::int as k, 71.7::double + k.k * 0.01::double + s.step * 0.002::double as lon, 18.3::double + ((k.k * 7) % 30) * 0.01::double + s.step * 0.001::double as lat from range(0, {_CLOUD_N + 1}) s(step), range(0, 30) k(k))"


def cloud(spark: SparkSession) -> DataFrame:
    """Thirty particles on straight courses, a step every twelve hours."""
    rows = spark.range((_CLOUD_N + 1) * 30).select(F.floor(F.col("id") / 30).cast("int").alias("step"), (F.col("id") % 30).cast("int").alias("k"))
    return rows.select("step", "k", (F.lit(71.7) + F.col("k") * F.lit(0.01) + F.col("step") * F.lit(0.002)).alias("lon"), (F.lit(18.3) + ((F.col("k") * 7) % 30) * F.lit(0.01) + F.col("step") * F.lit(0.001)).alias("lat"))


_MLON = "(111412.84::double * cos(radians({0})) - 93.5::double * cos(3 * radians({0})) + 0.118::double * cos(5 * radians({0})))"
_MLAT = "(111132.92::double - 559.82::double * cos(2 * radians({0})) + 1.175::double * cos(4 * radians({0})) - 0.0023::double * cos(6 * radians({0})))"


@query(f"""with {AIS}, {BOXED}, {_CLOUD_SQL}, a as (select *, least(ceil((ts_epoch - {d(RS)}) / {d(_CLOUD_DT)}), {_CLOUD_N})::int as j1 from f where ts_epoch between {d(RS)} and {d(RE)}),
    b as (select *, greatest(j1 - 1, 0) as j0 from a), m as (select *, case when j1 = j0 then 0.0::double else (ts_epoch - {d(RS)} - j0 * {d(_CLOUD_DT)}) / {d(_CLOUD_DT)} end as w, avg(lat) over (partition by mmsi) as mid from b),
    p as (select m.mmsi, m.seq, sqrt(power((c0.lon * (1 - w) + c1.lon * w - m.lon) * {_MLON.format('mid')}, 2) + power((c0.lat * (1 - w) + c1.lat * w - m.lat) * {_MLAT.format('mid')}, 2)) / 1000.0::double as d
        from m join cl c0 on c0.step = m.j0 join cl c1 on c1.step = m.j1 and c1.k = c0.k)
    select mmsi, seq, round(quantile_cont(d, 0.1), 6) as st_km from p group by mmsi, seq""")
def asof_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = tracks.asof_cloud(boxed(spark, sf_dir), cloud(spark), RS, RE, _CLOUD_DT)
    return near.select("mmsi", "seq", r6("st_km").alias("st_km"))


@query(f"with {AIS}, r as (select *, row_number() over (partition by mmsi order by ts_epoch, seq) as rn, count(*) over (partition by mmsi) as n from ais) select seq, mmsi from r where (rn - 1) % greatest(1, n // 5) = 0")
def stride_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.decimated(fixes(spark, sf_dir), 5).select("seq", "mmsi")


@query(f"with {AIS}, c as (select mmsi from ais where vessel_type = 'tanker' and sog < 1.0::double) select mmsi, count(*) as positions from ais where mmsi not in (select mmsi from c) group by mmsi")
def anti_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixes(spark, sf_dir)
    candidates = rows.where((F.col("vessel_type") == "tanker") & (F.col("sog") < 1.0))
    return tracks.other_tracks(rows, candidates).groupBy("mmsi").agg(F.count("*").alias("positions"))


@query(f"""with {AIS}, h as (select distinct floor(ts_epoch / 3600) * 3600 as step from ais where seq % 7 = 0), a as (select seq, ts_epoch, h1.step as lo from ais asof left join h h1 on ais.ts_epoch >= h1.step),
    b as (select a.*, h2.step as hi from a asof left join h h2 on a.ts_epoch <= h2.step) select seq, case when lo is null or hi - ts_epoch < ts_epoch - lo then hi else lo end as step from b""")
def nearest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fix the nearest hour that one in seven fixes has."""
    rows = fixes(spark, sf_dir)
    hours = rows.where("seq % 7 = 0").select((F.floor(F.col("ts_epoch") / 3600) * 3600.0).alias("step"))
    return fields.nearest_step(rows.select("seq", F.col("ts_epoch").alias("epoch")), hours, 6 * 3600.0).select("seq", "step")


@query(f"""with {AIS}, st as (select mmsi, arg_max(vessel_type, (ts_epoch, seq)) filter (vessel_type is not null and seq % 3 = 0) as s_type from ais group by mmsi)
    select seq, coalesce(case when seq % 3 = 0 then vessel_type end, s_type) as vessel_type from ais left join st using (mmsi)""")
def static_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("seq") % 3 == 0, F.col("vessel_type"))
    none = F.lit(None).cast("double")
    rows = fixes(spark, sf_dir).select("seq", "mmsi", "ts_epoch", own.alias("vessel_type"), F.lit(None).cast("string").alias("vessel_name"), none.alias("length_m"))
    static = rows.groupBy("mmsi").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts_epoch", "seq"))).alias(f"s_{c}") for c in ("vessel_name", "vessel_type", "length_m")])
    return recorder.backfilled(rows, static).select("seq", "vessel_type")


# ------------------------------------------------------------------ intake

_RAW_SQL = """raw as (select event_id as row, case when event_id % 11 = 0 then '12' when event_id % 13 = 0 then 'abc' else cast(419000000 + user_id as varchar) end as mmsi, case when event_id % 17 = 0 then 'soon' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as t,
    case when event_id % 19 = 0 then '0' when event_id % 23 = 0 then '999' else cast(70.0::double + user_id % 10 as varchar) end as lon, case when event_id % 19 = 0 then '0' else cast(10.0::double + user_id % 10 as varchar) end as lat,
    cast(value as varchar) as sog, case when event_id % 5 = 0 then '511' else cast(event_id % 360 as varchar) end as heading, event_type as vtype from events)"""
_TAGGED_SQL = f"""{_RAW_SQL}, n as (select row, try_cast(mmsi as double) as m, try_cast(t as timestamp) as ts, try_cast(lon as double) as lon, try_cast(lat as double) as lat, try_cast(sog as double) as s, try_cast(heading as double) as h from raw),
    tagged as (select *, case when m is null or m not between 1000000 and 999999999 then 'invalid_mmsi' when ts is null then 'unparseable_timestamp' when lon is null or lat is null or lon not between -180 and 180 or lat not between -90 and 90 or (lon = 0 and lat = 0) then 'invalid_position' end as reason,
        case when s between 0 and 102.2::double then s end as sog, case when h >= 0 and h < 360 then h end as heading from n)"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as text, with planted faults."""
    e = load(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    empty = F.lit("")
    return e.select(
        i.alias("row"), F.when(i % 11 == 0, "12").when(i % 13 == 0, "abc").otherwise((419000000 + u).cast("string")).alias("mmsi"), F.when(i % 17 == 0, "soon").otherwise(text.iso(F.col("ts").cast("timestamp"))).alias("timestamp_utc"),
        F.when(i % 19 == 0, "0").when(i % 23 == 0, "999").otherwise((F.lit(70.0) + u % 10).cast("string")).alias("longitude"), F.when(i % 19 == 0, "0").otherwise((F.lit(10.0) + u % 10).cast("string")).alias("latitude"),
        F.col("value").cast("string").alias("sog_knots"), empty.alias("cog_deg"), F.when(i % 5 == 0, "511").otherwise((i % 360).cast("string")).alias("heading_deg"), empty.alias("vessel_name"), F.col("event_type").alias("vessel_type"), empty.alias("length_m"), empty.alias("source"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_rows(spark, sf_dir)
    return ais_csv.normalised(rows, "analyst", ts=F.try_to_timestamp(F.col("timestamp_utc")))


@query(f"with {_TAGGED_SQL} select row, coalesce(reason, 'ok') as reason, round(sog, 6) as sog, heading from tagged")
def ais_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("row", F.coalesce("reason", F.lit("ok")).alias("reason"), r6("sog").alias("sog"), "heading")


@query(f"with {_TAGGED_SQL} select coalesce(reason, 'ok') as reason, count(*) as n, count(distinct m)::bigint as vessels, min(epoch(ts))::double as t0, max(epoch(ts))::double as t1, min(lon) as west, max(lon) as east from tagged group by all")
def ais_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged(spark, sf_dir)
    return rows.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("vessels"), F.min("ts_epoch").alias("t0"), F.max("ts_epoch").alias("t1"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query("""with n as (select event_id, case event_id % 3 when 0 then 'S1A_IW_GRDH_1SDV_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || strftime(ts, '%Y%m%dT%H%M%S') || '_004450' when 1 then 'scene_' || strftime(ts, '%Y%m%d_%H%M%S') || '-vh.tif' else 'plain_' || event_id || '.png' end as name from events)
    select event_id, case event_id % 3 when 0 then 'sentinel1_filename' when 1 then 'filename_timestamp' end as label, case when event_id % 3 < 2 then epoch(try_strptime(replace(regexp_replace(regexp_extract(name, '(\\d{8}[T_]\\d{6})', 1), '[T_]', ''), 'x', ''), '%Y%m%d%H%M%S'))::bigint end as t, case when event_id % 3 = 1 then 'VH' end as polarisation from n""")
def filename_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    s = F.date_format(ts, "yyyyMMdd'T'HHmmss")
    name = F.when(i % 3 == 0, F.concat(F.lit("S1A_IW_GRDH_1SDV_"), s, F.lit("_"), s, F.lit("_004450"))).when(i % 3 == 1, F.concat(F.lit("scene_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("-vh.tif"))).otherwise(F.concat(F.lit("plain_"), i.cast("string"), F.lit(".png")))
    one = e.select("event_id", name.alias("name"))
    t, label = text.filename_time(F.col("name"))
    return one.select("event_id", label.alias("label"), F.unix_seconds(t).alias("t"), text.polarisation(F.create_map().cast("map<string,string>"), F.col("name")).alias("polarisation"))


@query("select distinct event_type as data_mode from events order by 1")
def distinct_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("data_mode")).distinct().orderBy("data_mode")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.missing') as missing from events order by k, event_id")
def json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing")).orderBy("k", "event_id")


@query("""with r as (select s_suppkey % 7 + 1 as mmsi, case when s_suppkey % 2 = 0 then s_name end as registry_name, 'R' || s_suppkey as reported_name, s_nationkey as flag, s_suppkey as pos from supplier),
    b as (select *, row_number() over (partition by mmsi order by pos) as n from r), c as (select c_custkey as mmsi, case when c_custkey % 3 > 0 then c_name end as vessel_name from customer)
    select c.mmsi, coalesce(vessel_name, coalesce(registry_name, reported_name)) as vessel_name, cast(flag as varchar) as flag from c left join b on c.mmsi = b.mmsi and n = 1""")
def registry_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    reg = load(spark, sf_dir, "supplier").select((k % 7 + 1).alias("reg_mmsi"), F.when(k % 2 == 0, F.col("s_name")).alias("registry_name"), F.concat(F.lit("R"), k.cast("string")).alias("reported_name"), F.col("s_nationkey").cast("string").alias("flag"), F.lit(None).cast("string").alias("imo"), F.lit(None).cast("string").alias("callsign"), k.alias("pos"))
    cand = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mmsi"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("vessel_name"))
    return registry.enrich(cand, reg).select("mmsi", "vessel_name", "flag")


@query("""select event_id, case when c = 0 then null when c between 61 and 69 then 'passenger' when c between 71 and 79 then 'cargo' when c between 81 and 89 then 'tanker' when c = 30 then 'fishing' when c in (31, 32, 52) then 'tug' when c = 36 then 'sailing' when c = 37 then 'pleasure' when c = 60 then 'passenger' when c = 70 then 'cargo' when c = 80 then 'tanker' else 'other' end as label
    from (select event_id, cast(json_extract_string(props, '$.k') as int) as c from events) e""")
def ship_type_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("c"))
    return e.select("event_id", registry.ship_type_label(F.col("c")).alias("label"))


# ------------------------------------------------------------------ density and drift

_GRID = {"x0": 71.6, "y0": 18.2, "dx": 0.025, "dy": 0.025, "cells": 20, "cell_km2": 7.0}
_HIST_SQL = "h as (select cast(least(floor((lon - 71.6::double) / 0.025::double), 19) as int) as ix, cast(least(floor((lat - 18.2::double) / 0.025::double), 19) as int) as iy, count(*) as n from ais group by all)"


@query(f"with {AIS}, {_HIST_SQL} select ix, iy, n from h")
def histogram2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.histogram(fixes(spark, sf_dir), _GRID)


@query(f"with {AIS}, {_HIST_SQL}, c as (select *, (sum(n) over (order by n desc, ix, iy rows unbounded preceding) - n) / sum(n) over () as before from h) select ix, iy, n, before < 0.5 as in_50, before < 0.7 as in_70, true as in_90 from c where before < 0.9")
def hdr_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = density.mass_cells(density.histogram(fixes(spark, sf_dir), _GRID)).where("before < 0.9")
    return cells.select("ix", "iy", "n", (F.col("before") < 0.5).alias("in_50"), (F.col("before") < 0.7).alias("in_70"), F.lit(True).alias("in_90"))


def _ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of the month as a step, vessels dealt to five members and a control run."""
    rows = fixes(spark, sf_dir)
    step = F.floor((F.col("ts_epoch") - 1704067200.0) / 259200).cast("int")
    return rows.select((F.col("mmsi") % 6 - 1).cast("int").alias("member"), F.col("seq").alias("particle"), step.alias("step"), (F.lit(1704067200.0) + step * 3600.0).alias("epoch"), "lon", "lat", F.lit(False).alias("stranded"))


_ENS_SQL = "p as (select cast(mmsi % 6 - 1 as int) as member, cast(floor((ts_epoch - 1704067200.0::double) / 259200) as int) as step, lon, lat from ais)"
_CONV_SQL = f"""{_ENS_SQL}, mm as (select step, member, avg(lon) as cx, avg(lat) as cy from p where member <> -1 group by all), mid as (select step, avg(cx) as mx, avg(cy) as my, count(*) as members from mm group by step),
    sp as (select mm.step, my, members, avg(sqrt(power((cx - mx) * {_MLON.format('my')}, 2) + power((cy - my) * {_MLAT.format('my')}, 2)) / 1000) as spread_km from mm join mid using (step) group by all),
    co as (select step, var_samp(lon) as vx, var_samp(lat) as vy, covar_samp(lon, lat) as vxy from p where member = -1 group by step),
    ar as (select step, my, case when members > 1 then spread_km else 0 end as spread_km, greatest(3.141592653589793::double * sqrt(greatest((vx * vy - power(vxy, 2)) * power({_MLON.format('my')} * {_MLAT.format('my')}, 2), 1e-6::double)) / 1e6::double, 1e-4::double) as area from co join sp using (step)),
    cv as (select step, spread_km, area, first_value(area) over (order by step) / area as convergence, (step - first_value(step) over (order by step)) * 1.0::double as hours from ar),
    sc as (select *, case when hours >= 0.5 then greatest(convergence - 1, 0.0::double) else 0.0::double end as score from cv)"""


@query(f"with {AIS}, {_CONV_SQL} select step, round(spread_km, 5) as spread_km, round(area, 4) as control_area_km2, round(convergence, 5) as convergence, round(1 / (1 + spread_km / 5.0::double), 5) as agreement, round(score, 5) as score from sc")
def convergence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = density.step_metrics(_ensemble(spark, sf_dir), _GRID, 0.7)
    return out.select("step", F.round("spread_km", 5).alias("spread_km"), F.round("control_area_km2", 4).alias("control_area_km2"), F.round("convergence", 5).alias("convergence"), F.round("agreement", 5).alias("agreement"), F.round("score", 5).alias("score"))


@query(f"""with {AIS}, {_CONV_SQL}, best as (select arg_min(step, (-score, step)) as peak, max(score) as top from sc), hi as (select sc.*, peak, (score >= 0.5 * top and (hours >= 0.5 or step >= peak)) as high from sc, best where top >= 0.05),
    isl as (select *, sum(case when high then 0 else 1 end) over (order by step) as island from hi) select cast(min(step) as int) as lo, cast(max(step) as int) as hi, cast(peak as int) as peak from isl where high group by island, peak having peak between min(step) and max(step)""")
def release_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.peak_island(density.step_metrics(_ensemble(spark, sf_dir), _GRID, 0.7), least=0.05)


_FIELD_SQL = """fld as (select cast(floor(ts_epoch / 86400) as double) * 86400 as epoch, cast(k % 4 as double) as lat, cast(k // 4 % 4 as double) as lon, avg(case when seq % 3 > 0 then sog end) as v from ais group by all)"""


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixes(spark, sf_dir)
    value = F.avg(F.when(F.col("seq") % 3 > 0, F.col("sog")))
    return rows.groupBy((F.floor(F.col("ts_epoch") / 86400).cast("double") * 86400).alias("epoch"), (F.col("k") % 4).cast("double").alias("lat"), (F.floor(F.col("k") / 4) % 4).cast("double").alias("lon")).agg(value.alias("v"))


@query(f"""with {AIS}, {_FIELD_SQL}, a as (select epoch, lat, lon, coalesce(v, avg(v) over (partition by epoch)) as v, v is null as filled from fld),
    b as (select *, last_value(case when v is not null then epoch end ignore nulls) over w1 as te, last_value(v ignore nulls) over w1 as tv, first_value(case when v is not null then epoch end ignore nulls) over w2 as ue, first_value(v ignore nulls) over w2 as uv from a
        window w1 as (partition by lat, lon order by epoch rows between unbounded preceding and current row), w2 as (partition by lat, lon order by epoch rows between current row and unbounded following))
    select epoch, lat, lon, round(coalesce(v, case when ue > te then tv + (uv - tv) * (epoch - te) / (ue - te) end, tv, uv), 6) as v, filled from b""")
def nan_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _field(spark, sf_dir)
    out = fields.filled(f.select("epoch", "lat", "lon", *[F.col("v").alias(p) for p in fields.PARTS]))
    return out.select("epoch", "lat", "lon", r6("u_cur").alias("v"), "filled")


_SERIES_SQL = "s as (select cast(floor(ts_epoch / 21600) as double) * 21600 as epoch, avg(sog) as value from ais group by 1), t as (select distinct cast(floor(ts_epoch / 10000) as double) * 10000 as epoch from ais)"


@query(f"""with {AIS}, {_SERIES_SQL}, j as (select t.epoch, (select max(epoch) from s where s.epoch <= t.epoch) as ae, (select min(epoch) from s where s.epoch >= t.epoch) as be from t),
    k as (select j.*, a.value as av, b.value as bv from j left join s a on a.epoch = j.ae left join s b on b.epoch = j.be) select epoch, round(coalesce(case when be > ae then av + (bv - av) * (epoch - ae) / (be - ae) end, av, bv), 6) as value from k""")
def wind_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixes(spark, sf_dir)
    series = rows.groupBy((F.floor(F.col("ts_epoch") / 21600).cast("double") * 21600).alias("epoch")).agg(F.avg("sog").alias("value"))
    times = rows.select((F.floor(F.col("ts_epoch") / 10000).cast("double") * 10000).alias("epoch")).distinct()
    return fields.aligned(series, times).select("epoch", r6("value").alias("value"))


@query(f"""with {AIS}, c as (select seq, sog, sog * sin(radians(cog)) as u, sog * cos(radians(cog)) as v from ais)
    select seq, round(u, 6) as u_towards, round(v, 6) as v_towards, round(-u, 6) as u_from, round(-v, 6) as v_from, round(sqrt(u * u + v * v), 6) as speed, round(sog * 0.514444::double, 6) as speed_ms from c""")
def uv_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixes(spark, sf_dir)
    (u, v), (uf, vf) = met.uv_towards(F.col("sog"), F.col("cog")), met.uv_from(F.col("sog"), F.col("cog"))
    return rows.select("seq", r6(u).alias("u_towards"), r6(v).alias("v_towards"), r6(uf).alias("u_from"), r6(vf).alias("v_from"), r6(met.speed_direction(u, v)[0]).alias("speed"), r6(F.col("sog") * met.speed_factor("kn")).alias("speed_ms"))


_NODE = "(sin(e * 0.7::double) + y * 0.3::double + x * x * 0.05::double)"


@query(f"""with {AIS}, q as (select seq, greatest(0.0::double, least(3.0::double, (ts_epoch - {d(RS)}) / 86400.0::double)) as e, greatest(0.0::double, least(4.0::double, (lat - 18.2::double) / 0.1::double)) as y, greatest(0.0::double, least(4.0::double, (lon - 71.6::double) / 0.1::double)) as x from f),
    i as (select seq, least(floor(e), 2) as ei, least(floor(y), 3) as yi, least(floor(x), 3) as xi, e, y, x from q), c as (select i.*, a.a, b.b, g.g from i, (values (0), (1)) a(a), (values (0), (1)) b(b), (values (0), (1)) g(g))
    select seq, round(sum((case when a = 1 then e - ei else 1 - (e - ei) end) * (case when b = 1 then y - yi else 1 - (y - yi) end) * (case when g = 1 then x - xi else 1 - (x - xi) end) * (sin((ei + a) * 0.7::double) + (yi + b) * 0.3::double + power(xi + g, 2) * 0.05::double)), 6) as u from c group by seq""".replace("from f),", f"from (select * from ais where ts_epoch between {d(RS - PAD)} and {d(RE + PAD)}) f),"))
def field_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(4 * 5 * 5).select((F.col("id") % 4).alias("e"), (F.floor(F.col("id") / 4) % 5).alias("y"), F.floor(F.col("id") / 20).alias("x"))
    u = F.sin(F.col("e") * 0.7) + F.col("y") * 0.3 + F.pow(F.col("x"), 2.0) * 0.05
    field = nodes.select((F.lit(RS) + F.col("e") * 86400.0).alias("epoch"), (F.lit(18.2) + F.col("y") * 0.1).alias("lat"), (F.lit(71.6) + F.col("x") * 0.1).alias("lon"), *[u.alias(p) for p in fields.PARTS])
    points = tracks.in_box(fixes(spark, sf_dir), None, RS - PAD, RE + PAD).select("seq", F.col("ts_epoch").alias("epoch"), "lat", "lon")
    out = fields.sampled(field, points, {"epoch": (RS, 86400.0, 4), "lat": (18.2, 0.1, 5), "lon": (71.6, 0.1, 5)})
    return out.select("seq", r6("u_cur").alias("u"))


@query("""with recursive t as (select 0 as step, 72.0::double as lon union all select step + 1, lon + (-900.0::double) * 0.2::double / (111412.84::double * cos(radians(18.0::double)) - 93.5::double * cos(3 * radians(18.0::double)) + 0.118::double * cos(5 * radians(18.0::double))) from t where step < 96)
    select step, round(lon, 9) as lon from t""")
def const_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A particle in a steady eastward current, a day back in quarter hours, by a recursive query."""
    mlon = geo.metres_per_degree_at(18.0)[0]
    return spark.sql(f"with recursive t as (select 0 as step, 72.0D as lon union all select step + 1, lon + (-900.0D) * 0.2D / {mlon!r}D from t where step < 96) select step, round(lon, 9) as lon from t")


# ------------------------------------------------------------------ raster

_PX_SQL = "px as (select l_orderkey % 20 as scene, l_linenumber as row, l_partkey % 50 as col, l_quantity as value from lineitem)"


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("scene"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 50).alias("col"), F.col("l_quantity").alias("value"), "l_orderkey", "l_tax", "l_discount")


@query("""with s as (select n_nationkey, 700 + n_nationkey * 37 as height, 512 + n_nationkey * 53 as width from nation), a as (select *, unnest(list_distinct(list_concat(case when height > 512 then range(0, height - 512, 448) else [0] end, [greatest(height - 512, 0)]))) as r0 from s),
    b as (select *, unnest(list_distinct(list_concat(case when width > 512 then range(0, width - 512, 448) else [0] end, [greatest(width - 512, 0)]))) as c0 from a) select n_nationkey, cast(r0 as int) as r0, cast(least(r0 + 512, height) as int) as r1, cast(c0 as int) as c0, cast(least(c0 + 512, width) as int) as c1 from b""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    scenes = load(spark, sf_dir, "nation").select("n_nationkey", (700 + k * 37).alias("height"), (512 + k * 53).alias("width"))
    return raster.tile_grid(scenes, 512, 64).select("n_nationkey", *[F.col(c).cast("int").alias(c) for c in ("r0", "r1", "c0", "c1")])


@query(f"with {_PX_SQL}, w as (select scene, col, value / 50.0::double as p, greatest(0.5::double - 0.5::double * cos(2 * 3.141592653589793::double * (row + 0.5::double) / 8.0::double), 1e-3::double) as k from px) select scene, col, round(sum(p * k) / sum(k), 6) as p_oil from w group by all")
def tile_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _px(spark, sf_dir).withColumn("k", raster.blend_weight(F.col("row"), F.lit(8.0))).withColumn("p", F.col("value") / 50.0)
    return px.groupBy("scene", "col").agg(r6(F.sum(F.col("p") * F.col("k")) / F.sum("k")).alias("p_oil"))


_DB_SQL = "v as (select l_orderkey % 20 as scene, l_orderkey, l_linenumber, case l_orderkey % 20 % 4 when 0 then l_quantity when 1 then l_tax when 2 then l_tax * 100 + 0.5::double else l_quantity - 25 end as value from lineitem)"


@query(f"with {_DB_SQL}, k as (select scene, min(value) as low, max(value) as high, bool_and(value % 1 = 0) as whole from v group by scene) select scene, count(*) as n, round(sum(case when low < 0 then value when value > 0 then (case when high > 1 and whole then 20 else 10 end) * log10(greatest(value, 1e-6::double)) end), 3) as total, sum(case when low >= 0 and value <= 0 then 1 else 0 end)::bigint as gaps from v join k using (scene) group by scene")
def to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _px(spark, sf_dir)
    kind = F.col("scene") % 4
    px = px.withColumn("value", F.when(kind == 0, F.col("value")).when(kind == 1, F.col("l_tax")).when(kind == 2, F.col("l_tax") * 100 + 0.5).otherwise(F.col("value") - 25))
    return raster.decibels(px, "scene").groupBy("scene").agg(F.count("*").alias("n"), F.round(F.sum("db"), 3).alias("total"), F.count_if(F.col("db").isNull()).alias("gaps"))


@query(f"with {_PX_SQL}, m as (select scene, quantile_cont(value, 0.5) as m from px group by scene) select scene, round(greatest(1.4826::double * quantile_cont(abs(value - m), 0.5), 1e-3::double), 6) as sigma from px join m using (scene) group by scene")
def mad_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.robust_sigma(_px(spark, sf_dir), "value", "scene").select("scene", r6("sigma").alias("sigma"))


@query(f"with {_PX_SQL}, r as (select scene, row // 4 as block_row, col // 4 as block_col, row, avg(value) as m from px group by all) select scene, cast(block_row as bigint) as block_row, cast(block_col as bigint) as block_col, round(avg(m), 6) as value from r group by all")
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _px(spark, sf_dir).withColumnRenamed("scene", "scene_id")
    out = raster.block_means(px, 4)
    return out.select(F.col("scene_id").alias("scene"), F.col("by").alias("block_row"), F.col("bx").alias("block_col"), r6("value").alias("value"))


@query("select l_suppkey as region, count(*) as pixel_count, round(avg(l_discount * 10), 6) as prob_mean, round(max(l_discount * 10), 6) as prob_max, round(quantile_cont(l_discount * 10, 0.75), 6) as confidence from lineitem group by all")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = load(spark, sf_dir, "lineitem").select(F.lit("s").alias("scene_id"), F.lit("oil").alias("class"), F.col("l_suppkey").alias("region"), (F.col("l_discount") * 10).alias("p_oil"), F.lit(None).cast("double").alias("p_la"))
    return raster.zonal(px).select("region", "pixel_count", r6("prob_mean").alias("prob_mean"), r6("prob_max").alias("prob_max"), r6("confidence").alias("confidence"))


@query("""with p as (select p_partkey, p_size * 0.2::double as coast, (p_partkey % 30) / 10.0::double as elongation, (p_partkey % 7) / 10.0::double as la from part),
    q as (select p_partkey, case when coast <= 2 then 2 when coast <= 5 then 1 else 0 end + case when elongation < 1.5 then 1 else 0 end + case when la > 0.3::double then 2 else 0 end as points from p) select p_partkey, case when points >= 3 then 'high' when points = 2 then 'medium' else 'low' end as risk from q""")
def risk_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", raster.risk_label(F.col("p_size") * 0.2, (k % 30) / F.lit(10.0), (k % 7) / F.lit(10.0)).alias("risk"))


@query("""with s as (select p_partkey as slick_id, case when p_partkey % 4 = 0 then 'uncertain' else 'oil' end as class, p_retailprice as confidence, p_size as area from part)
    select slick_id, class, row_number() over (order by case when class = 'oil' then 0 else 1 end, confidence * area desc, slick_id) as rank from s qualify rank <= 25""")
def slick_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("slick_id"), F.when(F.col("p_partkey") % 4 == 0, "uncertain").otherwise("oil").alias("class"), (F.col("p_retailprice") * F.col("p_size")).alias("weight"))
    top = s.orderBy(F.when(F.col("class") == "oil", 0).otherwise(1), F.desc("weight"), "slick_id").limit(25)
    w = Window.orderBy(F.when(F.col("class") == "oil", 0).otherwise(1), F.desc("weight"), "slick_id")
    return top.select("slick_id", "class", F.row_number().over(w).cast("long").alias("rank"))


# ------------------------------------------------------------------ store


@query("select c_custkey as case_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as run_id, count(o_orderkey) as n_runs from customer left join orders on c_custkey = o_custkey group by all")
def latest_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    last = store.newest(orders, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("run_id"))
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n_runs"))
    cases = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    runs = last.join(n, "o_custkey")
    return cases.join(runs, F.col("case_id") == F.col("o_custkey"), "left").select("case_id", "run_id", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


@query("""with l as (select l_orderkey, count(*) as lines, sum(cast(l_quantity as bigint)) as qty from lineitem group by all)
    select c_custkey as case_id, n_name as area, count(distinct o_orderkey) as runs, coalesce(sum(lines), 0)::bigint as slicks, coalesce(sum(qty), 0)::bigint as pixels, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as states
    from customer left join nation on c_nationkey = n_nationkey left join orders on c_custkey = o_custkey left join l on l_orderkey = o_orderkey group by all""")
def case_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    slicks = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    runs = load(spark, sf_dir, "orders").join(slicks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = runs.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("runs"), F.sum("lines").alias("slicks"), F.sum("qty").alias("pixels"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("states"))
    cases = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    zero = F.lit(0).cast("long")
    return cases.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("case_id"), F.col("n_name").alias("area"), F.coalesce("runs", zero).alias("runs"), F.coalesce("slicks", zero).alias("slicks"), F.coalesce("pixels", zero).alias("pixels"), "states")


@query(f"""with {AIS} select 'slick' as layer, cast(p_partkey as varchar) as id, p_size::double as size from part union all select 'origin_region', cast(n_nationkey as varchar), 0.7::double from nation union all
    select 'candidate_track', cast(mmsi as varchar), count(*)::double from ais group by mmsi""")
def feature_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    def layer(name: str, frame: DataFrame, key: str, size: Column) -> DataFrame:
        return frame.select(F.lit(name).alias("layer"), F.col(key).cast("string").alias("id"), size.cast("double").alias("size"))

    vessels = fixes(spark, sf_dir).groupBy("mmsi").agg(F.count("*").alias("n"))
    parts = [layer("slick", load(spark, sf_dir, "part"), "p_partkey", F.col("p_size")), layer("origin_region", load(spark, sf_dir, "nation"), "n_nationkey", F.lit(0.7)), layer("candidate_track", vessels, "mmsi", F.col("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""with {AIS}, {BOXED}, {STEPS}, {EXPECTED}, g as (select mmsi, ts_epoch, next_t, row_number() over (partition by mmsi order by ts_epoch, seq) as n from s, x where dt > greatest(4.0::double * expected_s, 1200.0::double)) select mmsi, n as gap_no, ts_epoch as gap_start, next_t as gap_end from g""")
def candidate_gap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tracks.with_steps(boxed(spark, sf_dir))
    return tracks.gap_lines(tracks.gaps(steps, tracks.expected_interval_s(steps), (RS, RE)))


@query("select (o_custkey % 60 + 1)::int as zone, (case when o_custkey % 2 = 0 then 32600 else 32700 end + (o_custkey % 60 + 1))::int as epsg, count(*) as n from orders group by all")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    lon, lat = (F.col("o_custkey") % 60) * 6.0 - 177.0, F.when(F.col("o_custkey") % 2 == 0, 10.0).otherwise(-10.0)
    return o.select((F.col("o_custkey") % 60 + 1).cast("int").alias("zone"), geo.utm_epsg(lon, lat).cast("int").alias("epsg")).groupBy("zone", "epsg").agg(F.count("*").alias("n"))


@query(f"""with {AIS}, q as (select seq, lon + 0.00131::double as lon, lat from ais), p as (select floor(lon / 0.1::double)::int as cx, floor(lat / 0.1::double)::int as cy, * from q) select seq, (cx + cy) % 2 = 0 and (lon - cx * 0.1::double) + (lat - cy * 0.1::double) < 0.1::double as on_land from p""")
def land_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against polygon pieces by equality of grid cells, then the exact test."""
    rows = []
    for cx in range(715, 722):
        for cy in range(181, 189):
            if (cx + cy) % 2 == 0:
                x, y = cx * 0.1, cy * 0.1
                rows.append((cx, cy, cx * 1000 + cy, [[(x, y), (x + 0.1, y), (x, y + 0.1), (x, y)]]))
    pieces = spark.createDataFrame(rows, land.PIECES)
    return land.on_land(fixes(spark, sf_dir).withColumn("lon", F.col("lon") + 0.00131), pieces, 0.1).select("seq", "on_land")
