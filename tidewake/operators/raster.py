"""Radar scenes as tile tables: detection of dark spots, mosaics, regions and their description."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS
from tidewake.functions.geo import Ring, metres_per_degree_at, shape_metrics, simplified
from tidewake.session import settled
from tidewake.sources.scene_files import spans

TILES = "scene_id string, r0 int, c0 int, h int, w int, pixels array<float>"
PROBABILITIES = "scene_id string, r0 int, c0 int, h int, w int, p_oil array<float>, p_la array<float>"
LEAST_VALID = 0.02


# ------------------------------------------------------------------ tiles


def tile_table(spark: SparkSession, scene_id: str, image: np.ndarray, size: int, overlap: int) -> DataFrame:
    """An image as overlapping tiles; 0 and non-finite pixels are kept and mean no data."""
    rows = [(scene_id, r0, c0, r1 - r0, c1 - c0, image[r0:r1, c0:c1].astype(np.float32).ravel().tolist()) for r0, r1 in spans(image.shape[0], size, overlap) for c0, c1 in spans(image.shape[1], size, overlap)]
    return spark.createDataFrame(rows, TILES)


def tiled(px: DataFrame, size: int = 256) -> DataFrame:
    """Pixels (scene_id, row, col, value) as tiles of ``size`` on a regular grid; pixels that aren't there are 0, no data.

    A tile's pixels are one group, so a task holds one tile at a time.
    """

    def fill(group: pa.Table) -> pa.Table:
        at = group.column("at").to_numpy()
        values = np.zeros(size * size, np.float32)
        values[at] = group.column("value").to_numpy()
        one = {c: group.column(c)[:1] for c in ("scene_id", "r0", "c0")}
        ends = pa.array([0, size * size], pa.int32())
        side = pa.array([size], pa.int32())
        return pa.table(one | {"h": side, "w": side, "pixels": pa.ListArray.from_arrays(ends, pa.array(values))})

    r0, c0 = (F.floor(F.col(c) / size).cast("int") * size for c in ("row", "col"))
    cut = px.select(F.col("scene_id").cast("string"), r0.alias("r0"), c0.alias("c0"), ((F.col("row") - r0) * size + F.col("col") - c0).cast("int").alias("at"), F.col("value").cast("float").alias("value"))
    return cut.groupBy("scene_id", "r0", "c0").applyInArrow(fill, TILES)


def tiled_to(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles cut to an image of ``height`` by ``width``; those that lie outside go."""
    inside = tiles.where((F.col("r0") < height) & (F.col("c0") < width))
    sized = inside.select("scene_id", "r0", "c0", F.least(F.col("h"), height - F.col("r0")).alias("h"), F.least(F.col("w"), width - F.col("c0")).alias("w"), F.col("w").alias("__whole"), "pixels")
    rows = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda r: F.slice("pixels", r * F.col("__whole") + 1, F.col("w")))
    return sized.select("scene_id", "r0", "c0", "h", "w", F.flatten(rows).alias("pixels"))


def tile_grid(scenes: DataFrame, size: int, overlap: int) -> DataFrame:
    """(scene columns, r0, r1, c0, c1) from scenes with height and width, without collecting them."""

    def starts(n: Column) -> Column:
        regular = F.when(n - size > 0, F.sequence(F.lit(0), F.greatest(n - size - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array(F.lit(0)))
        return F.array_distinct(F.concat(regular, F.array(F.greatest(n - size, F.lit(0)))))

    out = scenes.withColumn("r0", F.explode(starts(F.col("height")))).withColumn("c0", F.explode(starts(F.col("width"))))
    return out.withColumn("r1", F.least(F.col("r0") + size, F.col("height"))).withColumn("c1", F.least(F.col("c0") + size, F.col("width")))


def pixels(tiles: DataFrame, value: str = "pixels") -> DataFrame:
    """One row a pixel: scene_id, row, col, value."""
    out = tiles.select("scene_id", "r0", "c0", "w", F.posexplode(value).alias("i", "value"))
    return out.select("scene_id", (F.col("r0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("row"), (F.col("c0") + F.col("i") % F.col("w")).cast("int").alias("col"), "value")


def block_means(px: DataFrame, factor: int) -> DataFrame:
    """Mean of the row means of each block, gaps left out of both."""
    rows = px.groupBy("scene_id", F.floor(F.col("row") / factor).alias("by"), F.floor(F.col("col") / factor).alias("bx"), "row").agg(F.avg("value").alias("m"))
    return rows.groupBy("scene_id", "by", "bx").agg(F.avg("m").alias("value"))


# ------------------------------------------------------------------ values


def decibels(px: DataFrame, *by: str) -> DataFrame:
    """Pixels of each group in decibels, by what the group's values look like.

    Any negative value: decibels already.  All up to 1: power.  All whole
    numbers: amplitudes.  Else power.  Zero and less is no data.
    """
    kind = px.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.bool_and(F.col("value") % 1 == 0).alias("whole"))
    factor = F.when((F.col("high") > 1) & F.col("whole"), 20.0).otherwise(10.0)
    scaled = F.when(F.col("value") > 0, factor * F.log10(F.greatest(F.col("value").cast("double"), F.lit(1e-6))))
    return px.join(kind, list(by)).withColumn("db", F.when(F.col("low") < 0, F.col("value").cast("double")).otherwise(scaled)).drop("low", "high", "whole")


def robust_sigma(values: DataFrame, value: str, *by: str) -> DataFrame:
    """1.4826 times the median absolute deviation of each group, at least 0.001."""
    mid = values.groupBy(*by).agg(F.percentile(value, 0.5).alias("m"))
    return values.join(mid, list(by)).groupBy(*by).agg(F.greatest(1.4826 * F.percentile(F.abs(F.col(value) - F.col("m")), 0.5), F.lit(1e-3)).alias("sigma"))


def stretched(px: DataFrame, *by: str) -> DataFrame:
    """Pixels as 0 to 255 between the 2nd and 98th percentile of their group."""
    cut = px.groupBy(*by).agg(F.percentile("db", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    lo, hi = F.col("p")[0], F.greatest(F.col("p")[1], F.col("p")[0] + 1e-6)
    return px.join(cut, list(by)).withColumn("grey", F.coalesce(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("db") - lo) / (hi - lo))) * 255), F.lit(0)).cast("int")).drop("p")


def to_db(tile: np.ndarray) -> np.ndarray:
    ok = np.isfinite(tile)
    if not ok.any() or tile[ok].min() < 0:
        return np.where(ok, tile, np.nan)
    v = tile[ok]
    factor = 20.0 if v.max() > 1 and np.all(v % 1 == 0) else 10.0
    return np.where(ok & (tile > 0), factor * np.log10(np.maximum(np.where(ok, tile, 1), 1e-6)), np.nan)


# ------------------------------------------------------------------ filters


def _windows(x: np.ndarray, size: int, mode: str) -> np.ndarray:
    before = (size - 1) // 2
    padded = np.pad(x, ((before, size - 1 - before),) * 2, mode=mode) if mode != "constant" else np.pad(x, ((before, size - 1 - before),) * 2)
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size))


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, cut at four deviations, edges mirrored."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (r, r)
        p = np.pad(x, width, mode="symmetric")
        x = sum(w * np.take(p, np.arange(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(k))
    return x


def eroded(m: np.ndarray, size: int) -> np.ndarray:
    return _windows(m, size, "constant").all(axis=(2, 3))


def dilated(m: np.ndarray, size: int) -> np.ndarray:
    return _windows(m, size, "constant").any(axis=(2, 3))


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected regions, numbered from 1: runs of each row joined to touching runs of the row above."""
    labels = np.zeros(mask.shape, np.int32)
    parent = [0]

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    before: list[tuple[int, int, int]] = []
    for r in range(mask.shape[0]):
        edge = np.diff(np.concatenate([[0], mask[r].astype(np.int8), [0]]))
        now = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            touching = {root(k) for s, e, k in before if s <= b and e >= a}
            k = min(touching, default=len(parent))
            if not touching:
                parent.append(k)
            for t in touching:
                parent[t] = k
            labels[r, a:b] = k
            now.append((a, b, k))
        before = now
    roots = np.array([root(k) for k in range(len(parent))])
    _, dense = np.unique(roots, return_inverse=True)
    return dense[labels], int(dense.max())


def background(x: np.ndarray, valid: np.ndarray, window: int, factor: int = 8) -> tuple[np.ndarray, float]:
    """Local median on a coarse grid, brought back to full size, and the robust noise around it."""
    h, w = x.shape
    H, W = -(-h // factor), -(-w // factor)
    pad = np.full((H * factor, W * factor), np.nan)
    pad[:h, :w] = np.where(valid, x, np.nan)
    blocks = pad.reshape(H, factor, W, factor)
    with np.errstate(invalid="ignore"):
        n = np.isfinite(blocks).sum(axis=3)
        rows = np.where(n > 0, np.nansum(blocks, axis=3) / np.maximum(n, 1), np.nan)
        m = np.isfinite(rows).sum(axis=1)
        coarse = np.where(m > 0, np.nansum(rows, axis=1) / np.maximum(m, 1), np.nan)
    known = np.argwhere(np.isfinite(coarse))
    if not len(known):
        return np.full(x.shape, np.nan), 1.0
    for i, j in np.argwhere(~np.isfinite(coarse)):
        coarse[i, j] = coarse[tuple(known[np.argmin(((known - (i, j)) ** 2).sum(axis=1))])]
    size = max(3, round(window / factor) | 1)
    mode = "symmetric"
    med = np.median(_windows(coarse, size, mode), axis=(2, 3))
    ys, xs = (np.arange(n * factor) * ((n - 1) / max(n * factor - 1, 1)) for n in (H, W))

    def lerp(a: np.ndarray, at: np.ndarray) -> np.ndarray:
        i = np.minimum(at.astype(int), max(a.shape[0] - 2, 0))
        f = (at - i)[:, None]
        return a[i] * (1 - f) + a[np.minimum(i + 1, a.shape[0] - 1)] * f

    bg = lerp(lerp(med, ys).T, xs).T[:h, :w]
    resid = (x - bg)[valid]
    sigma = 1.4826 * float(np.median(np.abs(resid - np.median(resid)))) if len(resid) else 1.0
    return bg, max(sigma, 1e-3)


# ------------------------------------------------------------------ adapters


class Adapter(Protocol):
    """Probability of oil for every pixel of a tile, and of look-alikes if the model tells them."""

    name: str
    tile_size: int
    tile_overlap: int

    def predict(self, tile: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]: ...


class Classical:
    """Dark spots: contrast to a robust background, hysteresis, cleaning, and a calibrated table."""

    name = "classical"

    def __init__(self, cfg: dict = DEFAULTS["detection"]["classical"]):
        self.cfg, self.tile_size, self.tile_overlap = cfg, cfg["tile_size"], cfg["tile_overlap"]

    def predict(self, tile: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, None]:
        c = self.cfg
        db = to_db(tile.astype(float))
        valid = valid & np.isfinite(db)
        out = np.zeros(tile.shape)
        if valid.sum() < 200:
            return out, None
        x = smoothed(np.where(valid, db, np.median(db[valid])), c["smooth_sigma_px"])
        bg, sigma = background(x, valid, c["window_px"] | 1)
        contrast = bg - x
        strong = valid & (contrast / sigma > c["k_sigma"]) & (contrast > c["min_contrast_db"])
        weak = valid & (contrast / sigma > c["k_sigma"] / 2) & (contrast > c["min_contrast_db"] / 2)
        if (k := c["morphology_px"]) > 0:
            weak = dilated(eroded(weak, k), k)
            weak = eroded(dilated(weak, k), k) & valid
        labels, n = labelled(weak)
        sizes = np.bincount(labels.ravel(), minlength=n + 1)
        seeds = np.bincount(labels.ravel(), weights=strong.ravel(), minlength=n + 1)
        mean = np.bincount(labels.ravel(), weights=contrast.ravel(), minlength=n + 1) / np.maximum(sizes, 1)
        low = 0.40 + 0.09 * np.clip(mean / c["min_contrast_db"], 0, 1)
        high = 0.5 + 0.5 * np.clip(mean / c["contrast_full_conf_db"], 0, 1)
        table = np.where((sizes >= c["min_region_px"]) & (seeds > 0), np.where(mean < c["min_contrast_db"], low, high), 0.0)
        table[0] = 0.0
        return np.where(valid, table[labels], 0.0), None


def normalised(tile: np.ndarray, valid: np.ndarray, how: str) -> np.ndarray:
    """Model input: gaps at the median, then min-max over 1-99 %, z-score, or as it is."""
    v = tile[valid]
    x = np.where(valid, tile, np.median(v) if len(v) else 0.0)
    if how == "minmax" and len(v):
        lo, hi = np.percentile(v, [1, 99])
        return np.clip((x - lo) / max(hi - lo, 1e-6), 0, 1)
    return (x - v.mean()) / max(v.std(), 1e-6) if how == "zscore" and len(v) else x


class Onnx:
    """A segmentation network in ONNX form; each worker process loads it once."""

    name = "onnx"
    _sessions: dict[str, object] = {}

    def __init__(self, model_path: str, cfg: dict = DEFAULTS["detection"]["onnx"]):
        self.path, self.cfg, self.tile_size, self.tile_overlap = model_path, cfg, cfg["input_size"], cfg["tile_overlap"]

    def predict(self, tile: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        if self.path not in self._sessions:
            import onnxruntime

            self._sessions[self.path] = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        session = self._sessions[self.path]
        n, (h, w) = self.cfg["input_size"], tile.shape
        x = np.pad(normalised(tile.astype(float), valid, self.cfg["normalize"]), ((0, max(0, n - h)), (0, max(0, n - w))), mode="symmetric")
        x = np.repeat(x[None].astype(np.float32), self.cfg["input_channels"], axis=0)
        x = x if self.cfg["input_layout"] == "NCHW" else np.moveaxis(x, 0, -1)
        out = np.asarray(session.run(None, {session.get_inputs()[0].name: x[None]})[0])[0]
        out = np.moveaxis(out, -1, 0) if self.cfg["input_layout"] == "NHWC" and out.ndim == 3 else out
        out = out[None] if out.ndim == 2 else out
        how = self.cfg["output_activation"]
        if how == "auto":
            how = "softmax" if len(out) > 1 else "prob" if 0 <= out.min() and out.max() <= 1 else "sigmoid"
        if how == "softmax":
            e = np.exp(out - out.max(axis=0))
            out = e / e.sum(axis=0)
        elif how == "sigmoid":
            out = 1 / (1 + np.exp(-out))
        oil = out[self.cfg["class_index_oil"] if len(out) > 1 else 0][:h, :w]
        other = self.cfg["class_index_lookalike"]
        return np.where(valid, oil, 0.0), out[other][:h, :w] if len(out) > 1 and other >= 0 else None


def adapter(name: str = "auto", onnx_path: str | None = None) -> Adapter:
    """The one asked for; ``auto`` takes the network if its file is there."""
    import os

    if name == "onnx" or name == "auto" and onnx_path and os.path.exists(onnx_path):
        if not onnx_path or not os.path.exists(onnx_path):
            raise ValueError("no model file for the onnx adapter")
        return Onnx(onnx_path)
    if name not in ("auto", "classical"):
        raise ValueError(f"unknown adapter {name!r}")
    return Classical()


def predict(tiles: DataFrame, model: Adapter) -> DataFrame:
    """Probabilities of every tile with enough data; tiles are independent tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t in frame.itertuples(index=False):
                image = np.asarray(t.pixels, np.float32).reshape(t.h, t.w)
                valid = np.isfinite(image) & (image != 0)
                if valid.mean() < LEAST_VALID:
                    continue
                oil, la = model.predict(image, valid)
                oil = np.where(valid, oil, 0.0)
                rows.append((t.scene_id, t.r0, t.c0, t.h, t.w, oil.astype(np.float32).ravel(), None if la is None else la.astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=["scene_id", "r0", "c0", "h", "w", "p_oil", "p_la"])

    return tiles.mapInPandas(run, PROBABILITIES)


def blend_weight(i: Column, n: Column) -> Column:
    """Raised-cosine window along one axis, at least 0.001."""
    return F.greatest(0.5 - 0.5 * F.cos(2 * 3.141592653589793 * (i + 0.5) / n), F.lit(1e-3))


def mosaic(probabilities: DataFrame) -> DataFrame:
    """(scene_id, row, col, p_oil, p_la): overlapping tiles blended by their windows."""
    both = F.arrays_zip("p_oil", F.coalesce("p_la", F.array_repeat(F.lit(None).cast("float"), F.size("p_oil"))).alias("p_la"))
    px = probabilities.select("scene_id", "r0", "c0", "h", "w", F.posexplode(both).alias("i", "p"))
    r, c = F.floor(F.col("i") / F.col("w")), F.col("i") % F.col("w")
    weight = blend_weight(r, F.col("h")) * blend_weight(c, F.col("w"))
    px = px.select("scene_id", (F.col("r0") + r).cast("int").alias("row"), (F.col("c0") + c).cast("int").alias("col"), F.col("p.p_oil").alias("o"), F.col("p.p_la").alias("l"), weight.alias("k"))
    return px.groupBy("scene_id", "row", "col").agg((F.sum(F.col("o") * F.col("k")) / F.sum("k")).alias("p_oil"), (F.sum(F.col("l") * F.col("k")) / F.sum(F.when(F.col("l").isNotNull(), F.col("k")))).alias("p_la"))


def classed(px: DataFrame, threshold: float = 0.5, band: tuple[float, float] = (0.35, 0.5)) -> DataFrame:
    """Pixels of oil, and uncertain ones between the band's lower end and the threshold."""
    kind = F.when(F.col("p_oil") >= threshold, "oil").when(F.col("p_oil") >= band[0], "uncertain")
    return px.withColumn("class", kind).where("class is not null")


BLOCK = 512


def components(px: DataFrame) -> DataFrame:
    """(scene_id, class, row, col, ..., region): 8-connected regions over any number of tiles.

    Blocks are labelled in tasks; labels of touching pixels on either side of a
    seam are links, and connected links one region, named by its least label.
    """
    keyed = px.withColumn("br", F.floor(F.col("row") / BLOCK).cast("int")).withColumn("bc", F.floor(F.col("col") / BLOCK).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", label string"

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["row"].to_numpy() % BLOCK, frame["col"].to_numpy() % BLOCK
        mask = np.zeros((BLOCK, BLOCK), bool)
        mask[r, c] = True
        labels = labelled(mask)[0][r, c]
        prefix = f"{frame['br'].iloc[0]:08d}-{frame['bc'].iloc[0]:08d}-"
        return frame.assign(label=[f"{prefix}{k:08d}" for k in labels])

    out = keyed.groupBy("scene_id", "class", "br", "bc").applyInPandas(local, schema)
    out = settled(out)
    key = ["scene_id", "class", "row", "col"]
    seam = out.where(((F.col("row") % BLOCK).isin(0, BLOCK - 1)) | ((F.col("col") % BLOCK).isin(0, BLOCK - 1))).select(*key, "label", "br", "bc")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    moved = seam.withColumn("d", around).select("scene_id", "class", (F.col("row") + F.col("d.a")).alias("row"), (F.col("col") + F.col("d.b")).alias("col"), F.col("label").alias("other"), F.col("br").alias("obr"), F.col("bc").alias("obc"))
    links = settled(seam.join(moved, key).where((F.col("br") != F.col("obr")) | (F.col("bc") != F.col("obc"))).select("scene_id", "class", "label", "other").distinct())
    names = settled(out.select("scene_id", "class", "label").distinct().withColumn("region", F.col("label")))
    of = ["scene_id", "class"]
    while True:
        # The least name among the neighbours', then that name's own name: distances to the root halve.
        near = links.join(names.select(*of, F.col("label").alias("other"), "region"), [*of, "other"]).groupBy(*of, "label").agg(F.min("region").alias("n"))
        best = names.join(near, [*of, "label"], "left").select(*of, "label", "region", F.least("region", F.coalesce("n", "region")).alias("best"))
        jump = names.select(*of, F.col("label").alias("best"), F.col("region").alias("far"))
        new = settled(best.join(jump, [*of, "best"]).select(*of, "label", F.least("best", "far").alias("new"), (F.least("best", "far") < F.col("region")).alias("moved")).withColumnRenamed("new", "region"))
        names = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return out.join(names, [*of, "label"]).drop("br", "bc", "label")


def outlines(cells: DataFrame) -> DataFrame:
    """(scene_id, class, region, edges): the edges of a region's cells that no two cells share, as (x1, y1, x2, y2) around it.

    Shared edges cancel out in the plan, so what is gathered for a region is
    its outline, not its pixels.
    """
    r, c = F.col("row"), F.col("col")

    def edge(kind: int, i: Column, j: Column, way: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(way).alias("way"))

    around = F.array(edge(0, c, r, 1), edge(1, c + 1, r, 1), edge(0, c, r + 1, -1), edge(1, c, r, -1))
    by = ["scene_id", "class", "region"]
    edges = cells.select(*by, F.explode(around).alias("e")).groupBy(*by, "e.kind", "e.i", "e.j").agg(F.count("*").alias("n"), F.first("e.way").alias("way")).where("n = 1")
    return edges.groupBy(*by).agg(F.collect_list(F.struct("kind", "i", "j", "way")).alias("edges"))


def rings_of(edges: list[tuple[int, int, int, int]], west: float, north: float, dx: float, dy: float) -> list[Ring]:
    """Closed rings from a region's outline; rows run south."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for kind, i, j, way in edges:
        a, b = (i, j), (i + 1, j) if kind == 0 else (i, j + 1)
        a, b = (a, b) if way > 0 else (b, a)
        after.setdefault(a, []).append(b)
    rings: list[Ring] = []
    while after:
        start = at = min(after)
        ring = [at]
        while True:
            nexts = after[at]
            step = nexts.pop()
            if not nexts:
                del after[at]
            at = step
            ring.append(at)
            if at == start:
                break
        rings.append([(west + i * dx, north - j * dy) for i, j in ring][::-1])
    return rings


def model_hash(spark: SparkSession, path: str) -> str:
    """The first digits of the SHA-256 of a model's file, to tell which one gave a result."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 16)).first()[0]


def zonal(regions: DataFrame) -> DataFrame:
    """Per region: pixels, mean, greatest and 75th percentile of the probability, mean look-alike probability."""
    return regions.groupBy("scene_id", "class", "region").agg(
        F.count("*").alias("pixel_count"), F.avg("p_oil").alias("prob_mean"), F.max("p_oil").alias("prob_max"), F.percentile("p_oil", 0.75).alias("confidence"), F.avg("p_la").alias("look_alike_prob"))


def risk_label(coast_km: Column, elongation: Column, look_alike: Column) -> Column:
    """Points for a near coast, a compact shape and a look-alike signal, as low, medium or high."""
    points = F.when(coast_km <= 2, 2).when(coast_km <= 5, 1).otherwise(0) + F.when(F.coalesce(elongation, F.lit(1.0)) < 1.5, 1).otherwise(0) + F.when(look_alike > 0.3, 2).otherwise(0)
    return F.when(points >= 3, "high").when(points == 2, "medium").otherwise("low")


def detection_limits(kind: str, adapter_name: str, coast_km: float | None) -> list[str]:
    out = ["Dark areas may be oil or something that looks like it; an analyst must check."]
    if coast_km is not None and coast_km <= 2:
        out.append("Close to the coast, where calm water often looks like a slick.")
    if adapter_name == "classical":
        out.append("Found by contrast alone, without a trained network.")
    if kind == "uncertain":
        out.append("Below the threshold for oil.")
    return out


def detect(tiles: DataFrame, shape: tuple[int, int], bounds: tuple[float, float, float, float], model: Adapter, post: dict | None = None, land: Callable | None = None, keep: str | None = None) -> list[dict]:
    """Slicks of one scene, best first: oil before others, then by confidence times area.

    Regions come to the driver as outlines, some hundred at a time in that
    order, until there are enough that lie at sea and are large enough.  The
    probabilities of all pixels are kept at ``keep``, if given.
    """
    cfg = DEFAULTS["detection"]["postprocess"] | (post or {})
    west, south, east, north = bounds
    dx, dy = (east - west) / shape[1], (north - south) / shape[0]
    px = mosaic(predict(tiles, model))
    if keep:
        px.write.mode("overwrite").parquet(keep)
        px = tiles.sparkSession.read.parquet(keep)
    regions = components(classed(px, cfg["prob_threshold"], tuple(cfg["uncertain_band"]))).cache()
    mx, my = metres_per_degree_at((south + north) / 2)
    least_px = max(1, int(0.5 * cfg["min_area_km2"] * 1e6 / (dx * mx * dy * my)))
    like = F.coalesce(F.col("look_alike_prob") > F.col("confidence"), F.lit(False))
    large = zonal(regions).where(F.col("pixel_count") >= least_px).withColumn("kind", F.when(like, "look_alike").otherwise(F.col("class"))).cache()
    order = [(F.col("kind") != "oil").asc(), F.desc(F.col("pixel_count") * F.col("confidence")), F.col("region").asc()]
    found: list[dict] = []
    at, some = 0, 4 * cfg["max_features"]
    while len(found) < cfg["max_features"]:
        chosen = large.orderBy(*order).offset(at).limit(some)
        by = ["scene_id", "class", "region"]
        rows = outlines(regions.join(F.broadcast(chosen.select(*by)), by)).join(chosen, by).orderBy(*order).collect()
        if not rows:
            break
        at += some
        for r in rows:
            ring: Ring = max(rings_of([tuple(e) for e in r["edges"]], west, north, dx, dy), key=len)
            m = shape_metrics(ring)
            if not m or m["area_km2"] < cfg["min_area_km2"]:
                continue
            coast = None
            if land is not None and cfg["land_mask"]:
                cx, cy = m["centroid"]
                if land(np.array([cx]), np.array([cy]))[0]:
                    continue
                coast = land.distance_km(cx, cy)
            found.append({"class": r["kind"], "confidence": round(r["confidence"], 3), "prob_mean": round(r["prob_mean"], 3), "prob_max": round(r["prob_max"], 3), "look_alike_prob": r["look_alike_prob"], "pixel_count": r["pixel_count"],
                          "ring": simplified(ring, cfg["simplify_tolerance_m"]), "coast_distance_km": coast, "limitations": detection_limits(r["kind"], model.name, coast), **m})
    found.sort(key=lambda s: (s["class"] != "oil", -s["confidence"] * s["area_km2"]))
    for n, s in enumerate(found, 1):
        points = (2 if s["coast_distance_km"] is not None and s["coast_distance_km"] <= 2 else 1 if s["coast_distance_km"] is not None and s["coast_distance_km"] <= 5 else 0) + (s["elongation"] < 1.5) + 2 * ((s["look_alike_prob"] or 0) > 0.3)
        s |= {"rank": n, "look_alike_risk": "high" if points >= 3 else "medium" if points == 2 else "low"}
    return found[: cfg["max_features"]]
