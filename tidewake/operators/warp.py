"""Rasters moved to a north-up grid in degrees, from control points or another projection.

The target grid is cut into tiles; each finds the source tiles that its pixels
come from, meets them by an equality join and samples them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.geo import from_utm, to_utm
from tidewake.sources.images import Raster
from tidewake.sources.scene_files import SCHEMA, spans


def _terms(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    return np.stack([x**i * y**j for n in range(order + 1) for i, j in ((n - k, k) for k in range(n + 1))], axis=-1)


@dataclass
class Polynomial:
    """A least-squares polynomial from one pair of coordinates to another, both scaled to about one."""

    middle: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    order: int

    @classmethod
    def fit(cls, given: np.ndarray, wanted: np.ndarray) -> Polynomial:
        """Of the second order if there are six points or more, else of the first."""
        if len(given) < 3:
            raise ValueError("at least three control points are needed")
        middle, scale = given.mean(axis=0), np.maximum(np.ptp(given, axis=0) / 2, 1e-12)
        order = 2 if len(given) >= 6 else 1
        a = _terms(*((given - middle) / scale).T, order)
        found, _, rank, _ = np.linalg.lstsq(a, wanted, rcond=None)
        if rank < a.shape[1]:
            if order == 1:
                raise ValueError("the control points lie on a line")
            order, a = 1, _terms(*((given - middle) / scale).T, 1)
            found = np.linalg.lstsq(a, wanted, rcond=None)[0]
        return cls(middle, scale, found, order)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = _terms((x - self.middle[0]) / self.scale[0], (y - self.middle[1]) / self.scale[1], self.order) @ self.coefficients
        return out[..., 0], out[..., 1]


@dataclass
class Affine:
    """Pixels by a matrix from degrees or, with the code of a UTM zone, from its metres; and back."""

    matrix: np.ndarray
    epsg: int
    back: bool = False

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        utm = self.epsg != 4326
        if not self.back and utm:
            x, y = to_utm(x, y, self.epsg)
        x, y = (m[0] * x + m[1] * y + m[2] for m in self.matrix[:2])
        return from_utm(x, y, self.epsg) if self.back and utm else (x, y)


def mappings(info: Raster, factor: int = 1):
    """(degrees to pixels, pixels to degrees) of a scene that was reduced by ``factor``."""
    epsg = info.epsg or 4326
    if epsg != 4326 and not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"coordinates of EPSG:{epsg} are not read: only degrees and UTM zones")
    if info.matrix is not None:
        m = np.vstack([np.asarray(info.matrix, float) @ np.diag([factor, factor, 1.0]), [0, 0, 1]])
        return Affine(np.linalg.inv(m), epsg), Affine(m, epsg, back=True)
    if not info.control:
        raise ValueError("the image has no georeference")
    if epsg != 4326:
        raise ValueError("control points must be in degrees")
    points = np.asarray(info.control, float)
    pixel, degree = points[:, :2] / factor, points[:, 2:]
    return Polynomial.fit(degree, pixel), Polynomial.fit(pixel, degree)


@dataclass
class Target:
    """A north-up grid in degrees."""

    west: float
    north: float
    pixel: tuple[float, float]
    width: int
    height: int

    @property
    def bounds(self) -> list[float]:
        return [self.west, self.north - self.height * self.pixel[1], self.west + self.width * self.pixel[0], self.north]


def target_of(to_degrees, width: int, height: int) -> Target:
    """Square pixels as large, along the diagonal, as those of the source, over all of its outline."""
    at = np.linspace(0, 1, 33)
    edge = np.concatenate([[at * width, 0 * at], [at * width, 0 * at + height], [0 * at, at * height], [0 * at + width, at * height]], axis=1)
    x, y = to_degrees(*edge)
    west, east, south, north = float(x.min()), float(x.max()), float(y.min()), float(y.max())
    pixel = float(np.hypot(east - west, north - south) / np.hypot(width, height))
    return Target(west, north, (pixel, pixel), max(1, round((east - west) / pixel)), max(1, round((north - south) / pixel)))


def _centres(target: Target, r0: int, r1: int, c0: int, c1: int) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(target.west + (np.arange(c0, c1) + 0.5) * target.pixel[0], target.north - (np.arange(r0, r1) + 0.5) * target.pixel[1])


def _needed(target: Target, place, rows: list[tuple[int, int]], cols: list[tuple[int, int]], source_rows: list[tuple[int, int]], source_cols: list[tuple[int, int]]):
    """Each target tile with the source tiles that bilinear sampling of its pixels touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for k in batch.column(0).to_pylist():
                (r0, r1), (c0, c1) = rows[k // len(cols)], cols[k % len(cols)]
                x, y = place(*_centres(target, r0, r1, c0, c1))
                x0, x1, y0, y1 = x.min() - 1.5, x.max() + 1.5, y.min() - 1.5, y.max() + 1.5
                out += [(r0, r1, c0, c1, a, c) for a, b in source_rows if b > y0 and a < y1 for c, d in source_cols if d > x0 and c < x1]
            yield pa.record_batch([pa.array([o[i] for o in out], pa.int32()) for i in range(6)], names=["t_r0", "t_r1", "t_c0", "t_c1", "r0", "c0"])

    return run


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at pixel-corner coordinates from the four pixels around, those without data left out."""
    h, w = image.shape
    x, y = x - 0.5, y - 0.5
    i, j = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    total, weight = np.zeros(x.shape), np.zeros(x.shape)
    for di, fy in ((0, 1 - (y - i)), (1, y - i)):
        for dj, fx in ((0, 1 - (x - j)), (1, x - j)):
            a, b = i + di, j + dj
            inside = (a >= 0) & (a < h) & (b >= 0) & (b < w)
            v = image[np.where(inside, a, 0), np.where(inside, b, 0)]
            ok = inside & np.isfinite(v)
            total += np.where(ok, v, 0.0) * fx * fy * ok
            weight += fx * fy * ok
    beyond = (x < -0.5) | (y < -0.5) | (x > w - 0.5) | (y > h - 0.5)
    return np.where((weight > 1e-6) & ~beyond, total / np.maximum(weight, 1e-12), np.nan)


def _resampled(target: Target, place, shape: tuple[int, int]):
    def run(group: pa.Table) -> pa.Table:
        first = {c: group.column(c)[0].as_py() for c in ("scene_id", "band", "t_r0", "t_r1", "t_c0", "t_c1")}
        boxes = list(zip(*(group.column(c).to_pylist() for c in ("r0", "c0", "h", "w")), strict=True))
        top, left = min(b[0] for b in boxes), min(b[1] for b in boxes)
        image = np.full((max(b[0] + b[2] for b in boxes) - top, max(b[1] + b[3] for b in boxes) - left), np.nan, np.float32)
        for (r, c, h, w), pixels in zip(boxes, group.column("pixels"), strict=True):
            image[r - top : r - top + h, c - left : c - left + w] = pixels.values.to_numpy(zero_copy_only=False).reshape(h, w)
        x, y = place(*_centres(target, first["t_r0"], first["t_r1"], first["t_c0"], first["t_c1"]))
        value = bilinear(image, x - left, y - top)
        value[(x < 0) | (y < 0) | (x > shape[1]) | (y > shape[0])] = np.nan
        value = value.astype(np.float32)
        ints = [pa.array([v], pa.int32()) for v in (first["band"], first["t_r0"], first["t_c0"], *value.shape)]
        return pa.table([pa.array([first["scene_id"]]), *ints, pa.ListArray.from_arrays(pa.array([0, value.size], pa.int32()), pa.array(value.ravel()))], names=["scene_id", "band", "r0", "c0", "h", "w", "pixels"])

    return run


def warp(tiles: DataFrame, shape: tuple[int, int], place, target: Target, size: int = 512, overlap: int = 0, source_size: int = 512, source_overlap: int = 0) -> DataFrame:
    """``tiles`` of a scene of ``shape`` (height, width), cut as ``scene_files.spans`` does, on the ``target`` grid.

    A target tile without source tiles gives no row; pixels without data are
    NaN.  A tile's task holds the few source tiles under it and nothing else.
    """
    rows, cols = spans(target.height, size, overlap), spans(target.width, size, overlap)
    wanted = tiles.sparkSession.range(len(rows) * len(cols)).mapInArrow(
        _needed(target, place, rows, cols, spans(shape[0], source_size, source_overlap), spans(shape[1], source_size, source_overlap)), "t_r0 int, t_r1 int, t_c0 int, t_c1 int, r0 int, c0 int"
    )
    met = tiles.select("scene_id", "band", "r0", "c0", "h", "w", "pixels").join(wanted, ["r0", "c0"])
    return met.groupBy("scene_id", "band", "t_r0", "t_c0").applyInArrow(_resampled(target, place, shape), SCHEMA)


def is_north_up(info: Raster) -> bool:
    """Whether a scene lies in degrees without rotation already."""
    m = info.matrix
    return m is not None and (info.epsg or 4326) == 4326 and m[0][1] == m[1][0] == 0 and m[0][0] > 0 > m[1][1]


def north_up(tiles: DataFrame, info: Raster, factor: int = 1, size: int = 512, overlap: int = 0, source_size: int = 512) -> tuple[DataFrame, Target]:
    """A scene on a grid in degrees, and the grid; ``tiles`` were reduced by ``factor`` and cut to ``source_size``."""
    height, width = max(1, info.height // factor), max(1, info.width // factor)
    place, back = mappings(info, factor)
    target = target_of(back, width, height)
    return warp(tiles, (height, width), place, target, size, overlap, source_size), target
