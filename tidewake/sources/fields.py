"""Currents and winds on a grid: providers, gap filling, interpolation and checks.

A field is a long table (epoch, lat, lon, u_cur, v_cur, u_wind, v_wind) on regular axes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS
from tidewake.functions.met import speed_direction, speed_factor, uv_from, uv_towards
from tidewake.session import settled

PARTS = ("u_cur", "v_cur", "u_wind", "v_wind")
# Names of the parts and axes in met-ocean files.
VARIABLES = {
    "u_cur": ("u_current", "uo", "u", "eastward_sea_water_velocity"), "v_cur": ("v_current", "vo", "v", "northward_sea_water_velocity"),
    "u_wind": ("u10_wind", "u10", "eastward_wind"), "v_wind": ("v10_wind", "v10", "northward_wind"),
}
AXES = {"lat": ("latitude", "lat", "y"), "lon": ("longitude", "lon", "x"), "epoch": ("time", "t", "epoch")}


class NoField(RuntimeError):
    """A provider that can't give the field."""


def constant(spark: SparkSession, bounds: list[float], t0: float, t1: float, values: dict[str, float] = DEFAULTS["environment"]["constant"]) -> DataFrame:
    """The same current and wind over the area and a degree around it, an hour before to an hour after."""
    west, south, east, north = bounds

    def axis(name: str, low: float, high: float, n: int) -> DataFrame:
        return spark.range(n).select((F.lit(low) + F.col("id") * ((high - low) / (n - 1))).alias(name))

    grid = axis("epoch", t0 - 3600, t1 + 3600, 2).crossJoin(axis("lat", south - 1, north + 1, 3)).crossJoin(axis("lon", west - 1, east + 1, 3))
    return grid.select("epoch", "lat", "lon", *[F.lit(float(values[k])).alias(p) for p, k in zip(PARTS, ("u_current", "v_current", "u_wind", "v_wind"), strict=True)])


def from_table(table: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """A field from any table with known axis and variable names; speeds become metres per second."""
    present = {c.lower(): c for c in table.columns}

    def pick(names: tuple[str, ...], what: str) -> Column:
        for n in names:
            if n in present:
                return F.col(present[n])
        raise NoField(f"no {what} among {table.columns}")

    axes = [pick(v, k).cast("double").alias(k) for k, v in AXES.items()]
    return table.select(*axes, *[(pick(v, k) * speed_factor((units or {}).get(k))).cast("double").alias(k) for k, v in VARIABLES.items()]).select("epoch", "lat", "lon", *PARTS)


def from_hourly_json(points: DataFrame, current_unit: str = "km/h", wind_unit: str = "km/h") -> DataFrame:
    """A field from landed responses of a point forecast service.

    ``points`` is (lat, lon, hourly struct<time, current_velocity,
    current_direction, wind_speed, wind_direction>), arrays side by side;
    currents flow towards their direction, winds blow from it.
    """
    h = points.select("lat", "lon", F.explode(F.arrays_zip("hourly.time", "hourly.current_velocity", "hourly.current_direction", "hourly.wind_speed", "hourly.wind_direction")).alias("h"))
    uc, vc = uv_towards(F.col("h.current_velocity") * speed_factor(current_unit), F.col("h.current_direction"))
    uw, vw = uv_from(F.col("h.wind_speed") * speed_factor(wind_unit), F.col("h.wind_direction"))
    return h.select(F.col("h.time").cast("double").alias("epoch"), "lat", "lon", uc.alias("u_cur"), vc.alias("v_cur"), uw.alias("u_wind"), vw.alias("v_wind"))


def request_grid(bounds: list[float], cfg: dict = DEFAULTS["environment"]["open_meteo"]) -> list[tuple[float, float]]:
    """(lat, lon) points to ask a point service for: n x n over the padded area."""
    pad, n = cfg["aoi_pad_deg"], cfg["grid_points_per_axis"]
    lats, lons = np.linspace(bounds[1] - pad, bounds[3] + pad, n), np.linspace(bounds[0] - pad, bounds[2] + pad, n)
    return [(float(y), float(x)) for y in lats for x in lons]


def endpoint(t_end: float, now: float, cfg: dict = DEFAULTS["environment"]["open_meteo"]) -> str:
    """Winds of days past come from the archive, later ones from the forecast."""
    return "archive" if t_end < now - cfg["archive_lag_days"] * 86400 else "forecast"


def _missing(spark: SparkSession, **_: object) -> DataFrame:
    raise NoField("this provider needs a landed table: pass it to from_table or from_hourly_json")


def from_netcdf(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The field of a NetCDF file; options as in ``netcdf.FieldSource``."""
    from tidewake.sources import netcdf  # which reads this module's names

    netcdf.register(spark)
    return spark.read.format("netcdf_field").options(**options).load(path)


PROVIDERS = {"constant": constant, "netcdf_upload": from_netcdf, "open_meteo": _missing}


def provider(name: str):
    if name not in PROVIDERS:
        raise ValueError(f"no provider of fields is called {name!r}")
    return PROVIDERS[name]


def filled(field: DataFrame) -> DataFrame:
    """Gaps filled by the mean of the time step, steps without any value by time between their neighbours.

    ``filled`` says whether any part of a row was made up.
    """
    step = Window.partitionBy("epoch")
    node = Window.partitionBy("lat", "lon").orderBy("epoch")
    back, ahead = node.rowsBetween(Window.unboundedPreceding, 0), node.rowsBetween(0, Window.unboundedFollowing)
    out = field.withColumn("filled", F.greatest(*[F.col(p).isNull() for p in PARTS]))
    for p in PARTS:
        out = out.withColumn(p, F.coalesce(p, F.avg(p).over(step)))
    for p in PARTS:
        known = F.when(F.col(p).isNotNull(), F.struct("epoch", p))
        a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        span = b["epoch"] - a["epoch"]
        lerp = F.when(span > 0, a[p] + (b[p] - a[p]) * (F.col("epoch") - a["epoch"]) / span)
        out = out.withColumn(p, F.coalesce(p, lerp, a[p], b[p]))
    return out


def _interpolated(carried: dict[int, tuple]):
    """Values at the asked epochs of a sorted partition, from its own points and the nearest ones of other partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for batch in batches]
        if not rows:
            return
        epoch, value, asked, part = (np.concatenate(c) for c in zip(*rows, strict=True))
        for p in np.unique(part):
            mine = part == p
            e, v, q = epoch[mine], value[mine], asked[mine].astype(bool)
            ends = [x for x in carried.get(int(p), (None, None))]
            known = ~np.isnan(v)
            xs = np.concatenate([[x[0] for x in ends[:1] if x], e[known], [x[0] for x in ends[1:] if x]])
            ys = np.concatenate([[x[1] for x in ends[:1] if x], v[known], [x[1] for x in ends[1:] if x]])
            at = e[q]
            if len(xs):
                i = np.searchsorted(xs, at, side="right") - 1
                low, high = np.maximum(i, 0), np.minimum(i + 1, len(xs) - 1)
                low, span = np.where(i < 0, high, low), xs[high] - xs[np.where(i < 0, high, low)]
                got = pa.array(ys[low] + np.where(span > 0, (ys[high] - ys[low]) * (at - xs[low]) / np.where(span > 0, span, 1.0), 0.0))
            else:
                got = pa.nulls(len(at), pa.float64())
            yield pa.record_batch([pa.array(at), got], names=["epoch", "value"])

    return run


def aligned(series: DataFrame, times: DataFrame) -> DataFrame:
    """(epoch, value) of ``series`` at ``times``, linear between its points and flat beyond its ends.

    Points and times are range-sorted together.  Of every partition the driver
    learns its first and its last point, so each knows the points next to it in
    other partitions; no task sees more than its range.
    """
    both = series.select("epoch", "value", F.lit(False).alias("asked")).unionByName(times.select("epoch", F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked")))
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(both.repartitionByRange(n, "epoch", "asked").sortWithinPartitions("epoch", "asked")).withColumn("part", F.spark_partition_id())
    point = F.struct("epoch", "value")
    ends = dealt.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("part").agg(F.min_by(point, "epoch").alias("first"), F.max_by(point, "epoch").alias("last")).collect()  # a row a partition
    firsts, lasts = ({r["part"]: tuple(r[c]) for r in ends} for c in ("first", "last"))
    carried = {p: (lasts.get(max((q for q in lasts if q < p), default=-1)), firsts.get(min((q for q in firsts if q > p), default=-1))) for p in range(n)}
    return dealt.select("epoch", "value", "asked", "part").mapInArrow(_interpolated(carried), "epoch double, value double")


def nearest_step(asked: DataFrame, steps: DataFrame, width: float) -> DataFrame:
    """``asked`` (with epoch) and the nearest ``step`` of steps(step), the earlier of equals.

    Time is cut into cells of ``width``; each cell knows the last step before it
    and the first after it, so a row meets only the steps of its own cell and
    those two, by equality.  Steps are a short axis, so the small side is the
    optimiser's to broadcast, and rows are never sorted.
    """
    cells = steps.select("step", F.floor(F.col("step") / width).alias("__cell")).distinct()
    order = Window.orderBy("__cell")
    ends = cells.groupBy("__cell").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.collect_set("step").alias("own"))
    span = ends.select("*", F.lead("__cell").over(order).alias("__next"), F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    # Cells without a step up to the next that has one share its neighbours.
    gap = span.where("__next > __cell + 1").select(F.explode(F.sequence(F.col("__cell") + 1, F.col("__next") - 1)).alias("__cell"), F.array_compact(F.array("last", "after")).alias("__near"))
    near = span.select("__cell", F.array_compact(F.concat(F.array("before"), "own", F.array("after"))).alias("__near")).unionByName(gap)
    low, high = ends.agg(F.min("__cell")).scalar(), ends.agg(F.max("__cell")).scalar()
    cell = F.greatest(low, F.least(high, F.floor(F.col("epoch") / width)))
    best = F.array_min(F.transform("__near", lambda s: F.struct(F.abs(s - F.col("epoch")).alias("d"), s.alias("s"))))["s"]
    return asked.withColumn("__cell", cell).join(near, "__cell").withColumn("step", best).drop("__cell", "__near")


def checksum(field: DataFrame) -> str:
    """SHA-256 of a field, whatever the order of its rows: of the sorted digests of its epochs."""
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("epoch", "lat", "lon", *PARTS)])
    per = field.groupBy("epoch", "lat").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("h"))
    per = per.groupBy("epoch").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256)).first()[0]


def summary(field: DataFrame) -> DataFrame:
    """One row: mean and largest speeds, extent."""
    current, wind = speed_direction(F.col("u_cur"), F.col("v_cur"))[0], speed_direction(F.col("u_wind"), F.col("v_wind"))[0]
    return field.agg(
        F.avg(current).alias("mean_current_ms"), F.max(current).alias("max_current_ms"), F.avg(wind).alias("mean_wind_ms"), F.max(wind).alias("max_wind_ms"),
        F.min("epoch").alias("time_start"), F.max("epoch").alias("time_end"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
    )


def problems(field: DataFrame, bounds: list[float], t0: float, t1: float, slack_s: float = 1800.0, slack_deg: float = 0.05) -> list[str]:
    """What the field doesn't cover, with a little slack."""
    s = summary(field).first()
    out = []
    if s["time_start"] is None:
        return ["the field is empty"]
    if s["time_start"] > t0 + slack_s or s["time_end"] < t1 - slack_s:
        out.append("the field ends within the time asked for")
    if s["west"] > bounds[0] + slack_deg or s["east"] < bounds[2] - slack_deg or s["south"] > bounds[1] + slack_deg or s["north"] < bounds[3] - slack_deg:
        out.append("the field ends within the area asked for")
    return out


def mean_vector(field: DataFrame) -> DataFrame:
    """Domain means of current and wind as speed and direction."""
    m = field.agg(*[F.avg(p).alias(p) for p in PARTS])
    (cs, cd), (ws, wd) = speed_direction(F.col("u_cur"), F.col("v_cur")), speed_direction(F.col("u_wind"), F.col("v_wind"))
    return m.select(cs.alias("current_ms"), cd.alias("current_towards_deg"), ws.alias("wind_ms"), wd.alias("wind_towards_deg"))


@dataclass
class Grid:
    """A field as dense arrays, for tasks: the default field is a few hundred nodes."""

    epochs: np.ndarray
    lats: np.ndarray
    lons: np.ndarray
    values: np.ndarray  # (4, T, NY, NX)

    @classmethod
    def of(cls, field: DataFrame, most_nodes: int = 4_000_000) -> Grid:
        """Collects a field; a larger one than ``most_nodes`` is refused."""
        if field.count() > most_nodes:
            raise ValueError(f"a field of over {most_nodes} nodes must be cut to the area first")
        rows = np.array([tuple(r) for r in field.select("epoch", "lat", "lon", *PARTS).collect()], float)
        axes = [np.unique(rows[:, k]) for k in range(3)]
        values = np.full((4, *map(len, axes)), np.nan)
        at = tuple(np.searchsorted(a, rows[:, k]) for k, a in enumerate(axes))
        values[(slice(None), *at)] = rows[:, 3:].T
        return cls(*axes, values)

    def sample(self, lon: np.ndarray, lat: np.ndarray, epoch: float) -> np.ndarray:
        """(4, n) by trilinear interpolation, positions outside moved to the edge."""

        def place(axis: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = np.clip(x, axis[0], axis[-1])
            i = np.clip(np.searchsorted(axis, x, side="right") - 1, 0, max(len(axis) - 2, 0))
            j = np.minimum(i + 1, len(axis) - 1)
            return i, np.where(j > i, (x - axis[i]) / np.where(j > i, axis[j] - axis[i], 1.0), 0.0)

        (t, ft), (y, fy), (x, fx) = place(self.epochs, np.array([epoch])), place(self.lats, lat), place(self.lons, lon)
        out = np.zeros((4, len(lon)))
        for dt, wt in ((0, 1 - ft[0]), (1, ft[0])):
            for dy, wy in ((0, 1 - fy), (1, fy)):
                for dx, wx in ((0, 1 - fx), (1, fx)):
                    corner = self.values[:, min(t[0] + dt, len(self.epochs) - 1), np.minimum(y + dy, len(self.lats) - 1), np.minimum(x + dx, len(self.lons) - 1)]
                    out += corner * (wt * wy * wx)
        return out


def sampled(field: DataFrame, points: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """points(epoch, lat, lon, ...) with the field's parts, all in the plan.

    ``axes`` gives (first, step, count) of each axis.  Cell numbers are
    arithmetic, so the eight corners are an equality join.
    """
    out = points.withColumn("__id", F.monotonically_increasing_id())
    for name, (first, step, n) in axes.items():
        x = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(name) - first) / step))
        i = F.least(F.floor(x), F.lit(max(n - 2, 0)))
        out = out.withColumn(f"__i_{name}", i.cast("int")).withColumn(f"__f_{name}", x - i)
    corners = F.array(*[F.struct(*[F.lit(bit >> k & 1).alias(name) for k, name in enumerate(axes)]) for bit in range(8)])
    out = out.withColumn("__c", F.explode(corners))
    weight = F.lit(1.0)
    keys = []
    for name in axes:
        weight = weight * F.when(F.col(f"__c.{name}") == 1, F.col(f"__f_{name}")).otherwise(1 - F.col(f"__f_{name}"))
        out = out.withColumn(f"__k_{name}", F.col(f"__i_{name}") + F.col(f"__c.{name}"))
        keys.append(f"__k_{name}")
    nodes = field.select(*[F.round((F.col(n) - axes[n][0]) / axes[n][1]).cast("int").alias(f"__k_{n}") for n in axes], *PARTS)
    joined = out.withColumn("__w", weight).join(nodes, keys)
    return joined.groupBy("__id", *points.columns).agg(*[F.sum(F.col("__w") * F.col(p)).alias(p) for p in PARTS]).drop("__id")


def vectors(spark: SparkSession, grid: Grid, epochs: list[float], bbox: list[float], nx: int = 9, ny: int = 7) -> DataFrame:
    """(epoch, lat, lon, parts) on an nx x ny grid for every time asked for."""
    lons, lats = np.linspace(bbox[0], bbox[2], nx), np.linspace(bbox[1], bbox[3], ny)
    x, y = (a.ravel() for a in np.meshgrid(lons, lats))
    rows = [(float(t), float(b), float(a), *map(float, v)) for t in epochs for a, b, v in zip(x, y, np.round(grid.sample(x, y, t), 3).T, strict=True)]
    return spark.createDataFrame(rows, "epoch double, lat double, lon double, " + ", ".join(f"{p} double" for p in PARTS))
