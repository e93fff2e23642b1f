"""Scene intake and catalogue: metadata, size reduction, previews and item search."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS, bbox
from tidewake.functions.geo import metres_per_degree_at
from tidewake.functions.text import polarisation, scene_time


class SceneInvalid(ValueError):
    """A scene without the georeference or data that the engine needs."""


def reduced(image: np.ndarray, most: int = DEFAULTS["scene"]["max_analysis_px"]) -> tuple[np.ndarray, int]:
    """Block averages by the least whole factor that brings the longer side under ``most``."""
    f = -(-max(image.shape) // most)
    if f == 1:
        return image, 1
    h, w = (n // f * f for n in image.shape)
    blocks = image[:h, :w].reshape(h // f, f, w // f, f)
    ok = np.isfinite(blocks) & (blocks != 0)
    n = ok.sum(axis=(1, 3))
    return np.where(n > 0, np.where(ok, blocks, 0).sum(axis=(1, 3)) / np.maximum(n, 1), np.nan).astype(np.float32), f


def check_name(name: str) -> None:
    allowed = DEFAULTS["scene"]["allowed_extensions"]
    if PurePath(name).suffix.lower() not in allowed:
        raise SceneInvalid(f"file must be one of {', '.join(allowed)}")


def metadata(spark: SparkSession, name: str, bounds: list[float] | None, shape: tuple[int, int], tags: dict[str, str] | None = None, acquisition: str | None = None) -> dict:
    """Bounds, time with its origin, polarisation, pixel size and warnings of one scene."""
    if bounds is None:
        raise SceneInvalid("the image has no georeference: give bounds=west,south,east,north")
    west, south, east, north = bbox(bounds)
    one = spark.createDataFrame([(name, tags or {}, acquisition)], "name string, tags map<string, string>, given string")
    t, label = scene_time(F.to_timestamp("given"), F.col("tags"), F.col("name"))
    r = one.select(t.alias("t"), label.alias("label"), polarisation(F.col("tags"), F.col("name")).alias("pol")).first()
    mx, my = metres_per_degree_at((south + north) / 2)
    warnings = ["no acquisition time found: the present is assumed"] if r["label"] == "assumed_now" else []
    return {"bounds": [west, south, east, north], "acquisition_time": r["t"], "time_source": r["label"], "polarization": r["pol"], "shape": list(shape), "pixel_size_m": [(east - west) / shape[1] * mx, (north - south) / shape[0] * my], "warnings": warnings}


def footprint(bounds: list[float]) -> dict:
    west, south, east, north = bounds
    return {"type": "Polygon", "coordinates": [[[west, south], [east, south], [east, north], [west, north], [west, south]]]}


def preview(image: np.ndarray) -> np.ndarray:
    """Grey levels between the 2nd and 98th percentile, in decibels if the values look like power."""
    ok = np.isfinite(image)
    if not ok.any():
        return np.zeros(image.shape, np.uint8)
    v = image.astype(float)
    if image[ok].min() >= 0 and image[ok].max() > 1 and not (image[ok].max() <= 255 and np.issubdtype(image.dtype, np.integer)):
        ok &= image > 0
        v = np.where(ok, 10 * np.log10(np.maximum(np.where(ok, v, 1), 1e-6)), np.nan)
    if not ok.any():
        return np.zeros(image.shape, np.uint8)
    lo, hi = np.percentile(v[ok], [2, 98])
    return np.where(ok, np.clip((np.where(ok, v, lo) - lo) / max(hi - lo, 1e-6), 0, 1) * 255, 0).astype(np.uint8)


def _shrunk(factor: int):
    """Each tile's sums and numbers of pixels with data by block of the shrunk scene."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r0, c0, h, w = (batch.column(k)[i].as_py() for k in range(1, 5))
                v = batch.column(5)[i].values.to_numpy(zero_copy_only=False).reshape(h, w).astype(np.float64)
                ok = np.isfinite(v) & (v != 0)
                ys, xs = np.arange(r0, r0 + h) // factor, np.arange(c0, c0 + w) // factor
                cut_y, cut_x = np.flatnonzero(np.diff(ys, prepend=-1)), np.flatnonzero(np.diff(xs, prepend=-1))
                total, count = (np.add.reduceat(np.add.reduceat(x, cut_y, axis=0), cut_x, axis=1) for x in (np.where(ok, v, 0.0), ok.astype(np.float64)))
                ints = [pa.array([x], pa.int32()) for x in (ys[0], xs[0], *total.shape)]
                yield pa.record_batch([batch.column(0).slice(i, 1), *ints, *(pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel())) for x in (total, count))], names=["scene_id", "r0", "c0", "h", "w", "total", "count"])

    return run


def previewed(tiles: DataFrame, shape: tuple[int, int], most: int = DEFAULTS["scene"]["preview_max_px"]) -> DataFrame:
    """(scene_id, h, w, grey, shown) of each scene of ``tiles``, its longer side at most ``most`` pixels.

    Tiles shrink where they lie; one task sees no more than ``most`` squared
    values.  Overlapping tiles may count a pixel twice, always with its value.
    """
    factor = max(1, -(-max(shape) // most))
    height, width = -(-shape[0] // factor), -(-shape[1] // factor)
    parts = tiles.select("scene_id", "r0", "c0", "h", "w", "pixels").mapInArrow(_shrunk(factor), "scene_id string, r0 int, c0 int, h int, w int, total array<double>, count array<double>")

    def whole(group: pa.Table) -> pa.Table:
        total, count = np.zeros((height, width)), np.zeros((height, width))
        boxes = zip(*(group.column(c).to_pylist() for c in ("r0", "c0", "h", "w")), strict=True)
        for i, (r, c, h, w) in enumerate(boxes):
            for into, name in ((total, "total"), (count, "count")):
                into[r : r + h, c : c + w] += group.column(name)[i].values.to_numpy(zero_copy_only=False).reshape(h, w)
        mean = np.divide(total, count, out=np.full(total.shape, np.nan), where=count > 0)
        grey = preview(mean.astype(np.float32))
        return pa.table({"scene_id": group.column("scene_id")[:1], "h": pa.array([height], pa.int32()), "w": pa.array([width], pa.int32()), "grey": [grey.tobytes()], "shown": [(count > 0).astype(np.uint8).tobytes()]})

    return parts.groupBy("scene_id").applyInArrow(whole, "scene_id string, h int, w int, grey binary, shown binary")


def png(grey: np.ndarray, shown: np.ndarray | None = None) -> bytes:
    """A grey image as a PNG file; with ``shown`` it gets an alpha channel."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = grey.shape
    values = grey.astype(np.uint8) if shown is None else np.stack([grey.astype(np.uint8), np.where(shown, 255, 0).astype(np.uint8)], axis=2).reshape(h, -1)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), values], axis=1)  # a filter byte before each row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if shown is None else 4, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def signed(items: DataFrame, token: str) -> DataFrame:
    """Catalogue items whose links carry a query string that gives access."""
    joint = F.when(F.col("href").contains("?"), "&").otherwise("?")
    return items.withColumn("href", F.concat("href", joint, F.lit(token.lstrip("?&"))))


CATALOGUE = "item_id string, collection string, acquired timestamp, west double, south double, east double, north double, platform string, mode string, polarizations array<string>, orbit string, href string"


def search(items: DataFrame, area: list[float], start: str, end: str, limit: int = 20, collection: str = "sentinel-1-grd") -> DataFrame:
    """Items that meet the area in the time, newest first; plain predicates, so they reach the scan."""
    west, south, east, north = bbox(area)
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie in [1, 100]")
    meets = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    when = F.col("acquired").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return items.where((F.col("collection") == collection) & meets & when).orderBy(F.desc("acquired"), "item_id").limit(limit)


def subset(px: DataFrame, shape: tuple[int, int], bounds: list[float], area: list[float], margin: int = 50, most: int = 3000) -> tuple[DataFrame, list[float], int]:
    """Pixels of a window with a margin, reduced to ``most``; an almost empty window is an error."""
    west, south, east, north = bounds
    a = bbox(area, 4.0)
    dx, dy = (east - west) / shape[1], (north - south) / shape[0]
    c0, c1 = max(0, int((a[0] - west) / dx) - margin), min(shape[1], int((a[2] - west) / dx) + 1 + margin)
    r0, r1 = max(0, int((north - a[3]) / dy) - margin), min(shape[0], int((north - a[1]) / dy) + 1 + margin)
    if c0 >= c1 or r0 >= r1:
        raise SceneInvalid("the area lies outside the scene")
    f = -(-max(c1 - c0, r1 - r0) // most)
    inside = px.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
    share = inside.agg(F.avg((F.coalesce("value", F.lit(0.0)) > 0).cast("double"))).first()[0] or 0.0
    if share < 0.01:
        raise SceneInvalid("under one percent of the window holds data")
    out = inside.groupBy("scene_id", F.floor((F.col("row") - r0) / f).cast("int").alias("row"), F.floor((F.col("col") - c0) / f).cast("int").alias("col")).agg(F.avg("value").alias("value"))
    return out, [west + c0 * dx, north - r1 * dy, west + c1 * dx, north - r0 * dy], f
