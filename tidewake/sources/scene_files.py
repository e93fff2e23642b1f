"""Scenes as Spark tables: ``spark.read.format("scene")`` reads tiles of a raster, ``write.format("geotiff")`` writes them.

    register(spark)
    tiles = spark.read.format("scene").option("most", 4000).load("/data/scene.tif")
    tiles.write.format("geotiff").option("height", h).option("width", w).option("bounds", "71.6,18.2,72.1,18.7").mode("overwrite").save("/data/out.tif")
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewake.sources import images
from tidewake.sources.places import Bytes, Draft

SCHEMA = "scene_id string, band int, r0 int, c0 int, h int, w int, pixels array<float>"
MOST_BANDS = 2
WRITTEN_TILE = 256


def spans(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of tiles along an axis; the last one lies flush with the edge."""
    if n <= size:
        return [(0, n)]
    starts = [*range(0, n - size, size - overlap), n - size]
    return [(a, a + size) for a in dict.fromkeys(starts)]


def factor_of(width: int, height: int, most: int) -> int:
    """The least whole factor that brings the longer side to ``most`` pixels."""
    return max(1, -(-max(width, height) // most))


@dataclass
class Band(InputPartition):
    """A row of tiles of one band."""

    band: int
    r0: int
    r1: int


class SceneReader(DataSourceReader):
    """Tiles of a TIFF or PNG file; every row of tiles of a band is a partition that reads its own blocks.

    Pixels without data (no-data value, not finite, zero) are NaN.  What is
    left out by options is never read.  (Conditions are not taken from the
    plan: a scan of the same table without them would then lack rows.)
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size, self.overlap = int(options.get("size", 512)), int(options.get("overlap", 0))
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must lie in [0, size)")
        self.scene_id = options.get("scene_id", os.path.basename(self.path))
        self.bands = int(options.get("bands", MOST_BANDS))
        self.info = images.describe(self.path)
        self.factor = int(options["factor"]) if "factor" in options else factor_of(self.info.width, self.info.height, int(options.get("most", 1 << 31)))
        # In pixels of the reduced scene: tiles that don't meet it are not read.
        self.window = [int(x) for x in options.get("window", f"0,0,{1 << 31},{1 << 31}").split(",")]

    def partitions(self) -> list[Band]:
        height = max(1, self.info.height // self.factor)
        rows = [(a, b) for a, b in spans(height, self.size, self.overlap) if b > self.window[0] and a < self.window[2]]
        return [Band(b, *s) for b in range(1, min(self.bands, self.info.bands) + 1) for s in rows] or [Band(0, 0, 0)]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        if not partition.band:
            return
        with Bytes(self.path) as source:
            image = images.opened(source)
            pixels = images.averaged(image, partition.band - 1, (partition.r0, partition.r1), self.factor)
        for c0, c1 in spans(pixels.shape[1], self.size, self.overlap):
            if c1 > self.window[1] and c0 < self.window[3]:
                tile = np.ascontiguousarray(pixels[:, c0:c1])
                values = pa.ListArray.from_arrays(pa.array([0, tile.size], pa.int32()), pa.array(tile.ravel()))
                ints = [pa.array([v], pa.int32()) for v in (partition.band, partition.r0, c0, *tile.shape)]
                yield pa.record_batch([pa.array([self.scene_id]), *ints, values], names=["scene_id", "band", "r0", "c0", "h", "w", "pixels"])


class SceneSource(DataSource):
    """Options: path, size (512), overlap (0), bands (2), most (longest side) or factor, window "r0,c0,r1,c1" (rows and columns, ends excluded), scene_id."""

    @classmethod
    def name(cls) -> str:
        return "scene"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SceneReader:
        return SceneReader(dict(self.options))


def header(width: int, height: int, bands: int, bounds: list[float], tags: dict[str, str], tile: int = WRITTEN_TILE, epsg: int = 4326) -> tuple[bytes, int, int]:
    """(directory, place of the first tile, length of the file) of a BigTIFF of float tiles, band by band.

    Tiles aren't compressed, so all places are known before a pixel is.
    """
    across, down = -(-width // tile), -(-height // tile)
    n, room = across * down * bands, tile * tile * 4
    west, south, east, north = bounds
    items = "".join(f'<Item name="{k}">{escape(v)}</Item>' for k, v in tags.items())
    entries: list[tuple[int, str, list | bytes]] = [
        (images.WIDTH, "I", [width]), (images.HEIGHT, "I", [height]), (images.BITS, "H", [32] * bands), (images.COMPRESSION, "H", [images.PLAIN]), (262, "H", [1]), (images.SAMPLES, "H", [bands]), (images.PLANAR, "H", [2]),
        (images.TILE_WIDTH, "I", [tile]), (images.TILE_HEIGHT, "I", [tile]), (images.TILE_AT, "Q", [0] * n), (images.TILE_LENGTH, "Q", [room] * n), (images.SAMPLE_FORMAT, "H", [3] * bands),
        (images.PIXEL_SCALE, "d", [(east - west) / width, (north - south) / height, 0.0]), (images.TIEPOINTS, "d", [0.0, 0.0, 0.0, west, north, 0.0]),
        (images.GEO_KEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, images.GEOGRAPHIC, 0, 1, epsg]), (images.GDAL_TAGS, "s", f"<GDALMetadata>{items}</GDALMetadata>\0".encode()), (images.GDAL_NODATA, "s", b"nan\0"),
    ]
    kinds = {"I": 4, "H": 3, "Q": 16, "d": 12, "s": 2}
    packed = lambda code, v: bytes(v) if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
    directory = 16
    free = directory + 8 + 20 * len(entries) + 8
    sizes = [len(packed(code, v)) for _, code, v in entries]
    first = -(-(free + sum(-(-s // 8) * 8 for s in sizes if s > 8)) // 4096) * 4096
    places = [first + i * room for i in range(n)]
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, directory) + struct.pack("<Q", len(entries)))
    beyond = bytearray()
    for tag, code, v in entries:
        data = packed(code, places if tag == images.TILE_AT else v)
        out += struct.pack("<HHQ", tag, kinds[code], len(v))
        if len(data) > 8:
            out += struct.pack("<Q", free + len(beyond))
            beyond += data + bytes(-len(data) % 8)
        else:
            out += data + bytes(8 - len(data))
    out += struct.pack("<Q", 0) + beyond
    return bytes(out), first, first + n * room


class TiffWriter(DataSourceArrowWriter):
    """Tasks write their pixels to fixed places of a draft, the commit gives it its name."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.width, self.height, self.bands = int(options["width"]), int(options["height"]), int(options.get("bands", 1))
        self.draft = Draft(options["path"])
        if os.path.exists(self.draft.path) and not overwrite:
            raise ValueError(f"{self.draft.path} is there already")
        tags = {k.removeprefix("tag.").upper(): v for k, v in options.items() if k.startswith("tag.")}
        head, self.first, length = header(self.width, self.height, self.bands, [float(x) for x in options["bounds"].split(",")], tags)
        self.draft.begin(head, length)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        t, across, down = WRITTEN_TILE, -(-self.width // WRITTEN_TILE), -(-self.height // WRITTEN_TILE)
        file = self.draft.open()
        try:
            for batch in iterator:
                names = batch.schema.names
                for i in range(batch.num_rows):
                    r0, c0, h, w = (batch.column(names.index(c))[i].as_py() for c in ("r0", "c0", "h", "w"))
                    band = batch.column(names.index("band"))[i].as_py() if "band" in names else 1
                    pixels = batch.column(names.index("pixels"))[i].values.to_numpy(zero_copy_only=False).astype("<f4").reshape(h, w)
                    if r0 < 0 or c0 < 0 or r0 + h > self.height or c0 + w > self.width or not 1 <= band <= self.bands:
                        raise ValueError(f"the tile at {r0}, {c0} of band {band} lies outside the image")
                    for y in range(r0 // t, -(-(r0 + h) // t)):
                        for x in range(c0 // t, -(-(c0 + w) // t)):
                            y0, y1, x0, x1 = max(r0, y * t), min(r0 + h, y * t + t), max(c0, x * t), min(c0 + w, x * t + t)
                            place = self.first + ((band - 1) * across * down + y * across + x) * t * t * 4
                            part = np.ascontiguousarray(pixels[y0 - r0 : y1 - r0, x0 - c0 : x1 - c0])
                            if x1 - x0 == t:
                                os.pwrite(file, part.tobytes(), place + (y0 - y * t) * t * 4)
                            else:
                                for k in range(y1 - y0):
                                    os.pwrite(file, part[k].tobytes(), place + ((y0 + k - y * t) * t + x0 - x * t) * 4)
            os.fsync(file)
        finally:
            os.close(file)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        self.draft.commit()

    def abort(self, messages: list) -> None:
        self.draft.abort()


class TiffSink(DataSource):
    """Options: path on a mounted folder, width, height, bands (1), bounds "west,south,east,north", and tags as ``tag.NAME``.

    Rows are tiles (band,) r0, c0, h, w, pixels of any size and order; pixels
    that no tile covers are zero, which means no data.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (SceneSource, TiffSink):
        spark.dataSource.register(source)
