"""Queries over scene and field files that Spark writes from the benchmark tables and reads again, with DuckDB SQL."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import raster, warp
from tidewake.queries import AIS, d, fixes, load, query, r6
from tidewake.session import shared_dir
from tidewake.sources import fields, netcdf, scene_files
from tidewake.sources.images import Raster
from tidewake.sources.places import mounted

_WIDE = 300


def _folder(spark: SparkSession, kind: str) -> str:
    return os.path.join(mounted(shared_dir(spark)), f"{kind}-{uuid.uuid4().hex}")


@query(f"""with px as (select l_orderkey // 100 as row, l_partkey % {_WIDE} as col, avg(l_quantity)::float as v from lineitem group by all), h as (select max(row) + 1 as h from px)
    select (row // 2)::int as row, (col // 2)::int as col, round((sum(v::double) / 4)::float::double, 3) as value from px, h where row // 2 < h // 2 group by row // 2, col // 2 having sum(v) <> 0""")
def scene_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the pixels of a scene: written as GeoTIFF by the tasks, read again in tiles at half the size."""
    scene_files.register(spark)
    px = load(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 100).cast("int").alias("row"), (F.col("l_partkey") % _WIDE).cast("int").alias("col")).agg(F.avg("l_quantity").alias("value")).withColumn("scene_id", F.lit("s"))
    height = px.agg(F.max("row") + 1).first()[0]
    path = _folder(spark, "scene") + "/image.tif"
    raster.tiled_to(raster.tiled(px, 64), height, _WIDE).write.format("geotiff").options(width=_WIDE, height=height, bounds="71.6,18.2,72.1,18.7").mode("overwrite").save(path)
    small = spark.read.format("scene").options(size=96, overlap=0, factor=2, bands=1).load(path)
    # The last tiles of an axis lie flush with the edge, over those before.
    return raster.pixels(small).where(~F.isnan("value")).dropDuplicates(["row", "col"]).select("row", "col", F.round(F.col("value").cast("double"), 3).alias("value"))


_ROWS, _COLS = 120, 160
#: Degrees of a pixel corner of the slanted scene: an affine map, told by four control points.
_SLANT = np.array([[0.004, 0.0007, 71.5], [0.0005, -0.004, 18.9], [0.0, 0.0, 1.0]])
_INFO = Raster(_COLS, _ROWS, 1, np.dtype("f4"), epsg=4326, control=[(c, r, *map(float, (_SLANT @ (c, r, 1))[:2])) for c in (0.0, float(_COLS)) for r in (0.0, float(_ROWS))])
_CORNERS = np.array([(_SLANT @ (c, r, 1))[:2] for c in (0, _COLS) for r in (0, _ROWS)])
_WEST, _SOUTH, _EAST, _NORTH = *_CORNERS.min(axis=0), *_CORNERS.max(axis=0)
_PIXEL = float(np.hypot(_EAST - _WEST, _NORTH - _SOUTH) / np.hypot(_COLS, _ROWS))
_BACK = np.linalg.inv(_SLANT)
_TW, _TH = round((_EAST - _WEST) / _PIXEL), round((_NORTH - _SOUTH) / _PIXEL)
_XY = [f"({d(float(m[0]))} * lon + {d(float(m[1]))} * lat + {d(float(m[2]))})" for m in _BACK[:2]]


@query(f"""with px as (select l_orderkey % {_ROWS} as row, l_partkey % {_COLS} as col, avg(l_quantity)::float::double as v from lineitem group by all),
    t as (select r, c, {d(float(_WEST))} + (c + 0.5::double) * {d(_PIXEL)} as lon, {d(float(_NORTH))} - (r + 0.5::double) * {d(_PIXEL)} as lat from range({_TH}) a(r), range({_TW}) b(c)),
    s as (select r, c, {_XY[0]} as x, {_XY[1]} as y from t), i as (select *, floor(y - 0.5::double)::int as i, floor(x - 0.5::double)::int as j from s where x between 0 and {_COLS} and y between 0 and {_ROWS}),
    k as (select i.*, di, dj, (case when di = 1 then y - 0.5::double - i else 1 - (y - 0.5::double - i) end) * (case when dj = 1 then x - 0.5::double - j else 1 - (x - 0.5::double - j) end) as w from i, range(2) p(di), range(2) q(dj))
    select r::int as row, c::int as col, round((sum(v * w) / sum(w))::float::double, 2) as value from k join px on px.row = i + di and px.col = j + dj group by r, c having sum(w) > 1e-6""")
def warped_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slanted scene with four control points on a north-up grid; source tiles meet target tiles by equality."""
    px = load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % _ROWS).cast("int").alias("row"), (F.col("l_partkey") % _COLS).cast("int").alias("col")).agg(F.avg("l_quantity").alias("value")).withColumn("scene_id", F.lit("s"))
    gaps = raster.tiled_to(raster.tiled(px, 40), _ROWS, _COLS).withColumns({"pixels": F.transform("pixels", lambda v: F.when(v != 0, v).otherwise(F.lit(float("nan")))), "band": F.lit(1)})
    moved, _ = warp.north_up(gaps, _INFO, size=48, source_size=40)
    return raster.pixels(moved).where(~F.isnan("value")).dropDuplicates(["row", "col"]).select("row", "col", F.round(F.col("value").cast("double"), 2).alias("value"))


_NODES = f"""f0 as (select cast(floor(ts_epoch / 86400) as double) * 86400 as epoch, (k % 4)::double + 17 as lat, (k // 4 % 4) * 0.5::double + 70 as lon, avg(sog) as u_cur, avg(cog) / 100 as v_cur, avg(value) / 100 as u_wind, avg(k) / 10 as v_wind from ais group by all),
    fl as (select e.epoch, y.y + 17.0::double as lat, x.x * 0.5::double + 70 as lon, u_cur, v_cur, u_wind, v_wind from (select distinct epoch from f0) e, range(4) y(y), range(4) x(x) left join f0 on f0.epoch = e.epoch and f0.lat = y.y + 17.0::double and f0.lon = x.x * 0.5::double + 70)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the fixes by day and a 4 x 4 grid; nodes without fixes are null."""
    k = F.col("k")
    found = fixes(spark, sf_dir).groupBy((F.floor(F.col("ts_epoch") / 86400).cast("double") * 86400).alias("epoch"), ((k % 4).cast("double") + 17).alias("lat"), (F.floor(k / 4) % 4 * F.lit(0.5) + 70).alias("lon")).agg(
        F.avg("sog").alias("u_cur"), (F.avg("cog") / 100).alias("v_cur"), (F.avg("value") / 100).alias("u_wind"), (F.avg("k") / 10).alias("v_wind"))
    grid = found.select("epoch").distinct().select("epoch", F.explode(F.array(*[F.lit(17.0 + i) for i in range(4)])).alias("lat")).select("epoch", "lat", F.explode(F.array(*[F.lit(70.0 + 0.5 * i) for i in range(4)])).alias("lon"))
    return grid.join(found, ["epoch", "lat", "lon"], "left")


@query(f"with {AIS}, {_NODES} select epoch, lat, lon, round(u_cur, 6) as u_cur, round(v_cur, 6) as v_cur, round(u_wind, 6) as u_wind, round(v_wind, 6) as v_wind from fl where lat >= 18 and lon between 70.4::double and 71.1::double")
def field_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field written as NetCDF by the tasks and read again within an area."""
    path = _folder(spark, "field") + "/field.nc"
    netcdf.write_field(_nodes(spark, sf_dir), path)
    part = fields.from_netcdf(spark, path, slab_nodes=32, bounds="70.4,18,71.1,90")
    return part.select("epoch", "lat", "lon", *[r6(p).alias(p) for p in fields.PARTS])
