"""Rasters in TIFF and PNG files: their directory, blocks of pixels and georeference.

Only the header and the blocks that are asked for are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import unescape

import numpy as np

from tidewake.sources.places import Bytes

# Fixed values of the TIFF, GeoTIFF and PNG formats.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_LENGTH, PLANAR, DATE = 256, 257, 258, 259, 270, 273, 277, 278, 279, 284, 306
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_LENGTH, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINTS, MATRIX, GEO_KEYS, GDAL_TAGS, GDAL_NODATA = 33550, 33922, 34264, 34735, 42112, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
GEOGRAPHIC, PROJECTED = 2048, 3072


class UnreadableImage(ValueError):
    """A file that is no raster of the kinds read here."""


@dataclass
class Raster:
    """What a header tells; ``matrix`` maps (col, row, 1) of pixel corners to x and y."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    tags: dict[str, str] = field(default_factory=dict)
    nodata: float | None = None
    epsg: int | None = None
    matrix: list[list[float]] | None = None
    #: (col, row, x, y) of ground control points.
    control: list[tuple[float, float, float, float]] = field(default_factory=list)

    @property
    def bounds(self) -> list[float] | None:
        if self.matrix is None:
            return None
        xs, ys = zip(*[(m := np.asarray(self.matrix) @ (c, r, 1.0)) for c, r in ((0, 0), (self.width, 0), (0, self.height), (self.width, self.height))], strict=True)
        return [float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys))]


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the highest bit on, widened one code early."""
    out = bytearray()
    clear, end = 256, 257
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, before = list(first), 9, 0, 0, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == clear:
            table, width, before = list(first), 9, b""
            continue
        if code == end:
            break
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise UnreadableImage("a damaged LZW block")
        out += entry
        if before:
            table.append(before + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        before = entry
    return bytes(out)


class Tiff:
    """A TIFF or BigTIFF file of either byte order."""

    def __init__(self, source: Bytes) -> None:
        self.source = source
        mark = source.at(0, 16 if source.size >= 16 else 8)
        if mark[:2] not in (b"II", b"MM"):
            raise UnreadableImage("no TIFF file")
        self.order = "<" if mark[:2] == b"II" else ">"
        kind = struct.unpack(self.order + "H", mark[2:4])[0]
        if kind not in (42, 43):
            raise UnreadableImage("no TIFF file")
        self.big = kind == 43
        self.entries = self._directory(struct.unpack(self.order + ("Q" if self.big else "I"), mark[8:16] if self.big else mark[4:8])[0])
        e = self.entries
        bits, form = e.get(BITS, (1,))[0], e.get(SAMPLE_FORMAT, (1,))[0]
        if (form, bits) not in _SAMPLES:
            raise UnreadableImage(f"samples of format {form} and {bits} bits are not read")
        self.compression, self.predictor = e.get(COMPRESSION, (PLAIN,))[0], e.get(PREDICTOR, (1,))[0]
        if self.compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE):
            raise UnreadableImage(f"compression {self.compression} is not read")
        self.samples = e.get(SAMPLES, (1,))[0]
        self.apart = e.get(PLANAR, (1,))[0] == 2
        self.tiled = TILE_AT in e
        width, height = e[WIDTH][0], e[HEIGHT][0]
        self.block_w = e[TILE_WIDTH][0] if self.tiled else width
        self.block_h = e[TILE_HEIGHT][0] if self.tiled else min(e.get(STRIP_ROWS, (height,))[0], height)
        self.across, self.down = -(-width // self.block_w), -(-height // self.block_h)
        self.places = list(zip(e[TILE_AT if self.tiled else STRIP_AT], e[TILE_LENGTH if self.tiled else STRIP_LENGTH], strict=True))
        self.info = Raster(width, height, self.samples, np.dtype(_SAMPLES[form, bits]), *self._georeference())

    def _directory(self, at: int) -> dict[int, tuple]:
        count, size = ("Q", 20) if self.big else ("H", 12)
        n = struct.unpack(self.order + count, self.source.at(at, struct.calcsize(count)))[0]
        data = self.source.at(at + struct.calcsize(count), n * size)
        out = {}
        for i in range(n):
            tag, kind = struct.unpack_from(self.order + "HH", data, i * size)
            many = struct.unpack_from(self.order + ("Q" if self.big else "I"), data, i * size + 4)[0]
            if kind not in _TYPES:
                continue
            code, room = _TYPES[kind], 8 if self.big else 4
            length = many * struct.calcsize(code if code == "s" else self.order + code)
            value = data[i * size + size - room :][:room]
            if length > room:
                value = self.source.at(struct.unpack(self.order + ("Q" if self.big else "I"), value)[0], length)
            out[tag] = (value[:length].split(b"\0")[0].decode("utf-8", "replace"),) if code == "s" else struct.unpack(self.order + (code * many if code == "II" else f"{many}{code}"), value[:length])
        return out

    def _georeference(self) -> tuple:
        e, tags = self.entries, {}
        for name, tag in (("TIFFTAG_DATETIME", DATE), ("TIFFTAG_IMAGEDESCRIPTION", DESCRIPTION)):
            if tag in e:
                tags[name] = e[tag][0]
        for name, value in re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', e.get(GDAL_TAGS, ("",))[0]):
            tags[name] = unescape(value)
        nodata = None
        if GDAL_NODATA in e:
            try:
                nodata = float(e[GDAL_NODATA][0])
            except ValueError:
                nodata = None
        keys, epsg = e.get(GEO_KEYS, ()), None
        for i in range(4, len(keys) - 3, 4):
            if keys[i] in (GEOGRAPHIC, PROJECTED) and keys[i + 1] == 0 and 0 < keys[i + 3] < 32767:
                epsg = keys[i + 3] if keys[i] == PROJECTED or epsg is None else epsg
        ties, scale, full = e.get(TIEPOINTS, ()), e.get(PIXEL_SCALE), e.get(MATRIX)
        points = [(ties[i], ties[i + 1], ties[i + 3], ties[i + 4]) for i in range(0, len(ties) - 5, 6)]
        if full:
            return tags, nodata, epsg, [[full[0], full[1], full[3]], [full[4], full[5], full[7]]], []
        if scale and points:
            c, r, x, y = points[0]
            return tags, nodata, epsg, [[scale[0], 0.0, x - c * scale[0]], [0.0, -scale[1], y + r * scale[1]]], []
        return tags, nodata, epsg, None, points if len(points) > 2 else []

    def _block(self, number: int, rows: int, samples: int) -> np.ndarray:
        at, length = self.places[number]
        shape = (rows, self.block_w, samples)
        kind = self.info.dtype.newbyteorder(self.order)
        size = int(np.prod(shape)) * kind.itemsize
        if not length:  # a block that was never written
            return np.zeros(shape, self.info.dtype)
        data = self.source.at(at, length)
        if self.compression == LZW:
            data = lzw(data)
        elif self.compression != PLAIN:
            data = zlib.decompress(data)
        if len(data) < size:
            raise UnreadableImage("a block is shorter than its pixels")
        if self.predictor == 3:  # bytes of a row by significance, differences between neighbours
            planes = np.frombuffer(data, np.uint8, size).reshape(rows, -1).copy()
            flat = np.add.accumulate(planes.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
            return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(np.dtype(self.info.dtype).newbyteorder(">")).reshape(shape)
        block = np.frombuffer(data, kind, int(np.prod(shape))).reshape(shape)
        return np.add.accumulate(block, axis=1, dtype=self.info.dtype) if self.predictor == 2 else block

    def blocks(self, band: int, r0: int, r1: int, c0: int, c1: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, col, pixels) of the blocks of a band (from 0) that meet a window, cut to the image."""
        for by in range(r0 // self.block_h, -(-min(r1, self.info.height) // self.block_h)):
            top = by * self.block_h
            rows = self.block_h if self.tiled else min(self.block_h, self.info.height - top)
            for bx in range(c0 // self.block_w, -(-min(c1, self.info.width) // self.block_w)):
                number = by * self.across + bx + (band * self.across * self.down if self.apart else 0)
                block = self._block(number, rows, 1 if self.apart else self.samples)[..., 0 if self.apart else band]
                left = bx * self.block_w
                yield top, left, block[: self.info.height - top, : self.info.width - left]


class Png:
    """A PNG file without interlacing; its pixels are one stream, read from the top."""

    def __init__(self, source: Bytes) -> None:
        if source.at(0, 8) != b"\x89PNG\r\n\x1a\n":
            raise UnreadableImage("no PNG file")
        self.source = source
        tags, at = {}, 8
        self.parts: list[tuple[int, int]] = []
        while at + 12 <= source.size:
            length, kind = struct.unpack(">I4s", source.at(at, 8))
            if kind == b"IHDR":
                self.w, self.h, self.depth, self.color, _, _, laced = struct.unpack(">IIBBBBB", source.at(at + 8, 13))
            elif kind == b"IDAT":
                self.parts.append((at + 8, length))
            elif kind == b"tEXt":
                name, _, value = source.at(at + 8, length).partition(b"\0")
                tags[name.decode("latin-1")] = value.decode("latin-1")
            elif kind == b"IEND":
                break
            at += length + 12
        if self.color not in _PNG_CHANNELS or self.depth not in (8, 16) or laced:
            raise UnreadableImage("only PNG files of 8 or 16 bits, grey or colour, without interlacing are read")
        self.channels = _PNG_CHANNELS[self.color]
        # Grey with alpha and colour files count as their first bands without alpha.
        self.info = Raster(self.w, self.h, self.channels - (self.color in (4, 6)), np.dtype("u1" if self.depth == 8 else "u2"), tags)

    def _rows(self) -> Iterator[np.ndarray]:
        step = self.channels * self.depth // 8
        size, above, data = self.w * step, None, b""
        unpack = zlib.decompressobj()
        above = np.zeros(size, np.uint8)

        def lines() -> Iterator[bytes]:
            nonlocal data
            for at, length in self.parts:
                data += unpack.decompress(self.source.at(at, length))
                n = len(data) // (size + 1)
                for i in range(n):
                    yield data[i * (size + 1) : (i + 1) * (size + 1)]
                data = data[n * (size + 1) :]

        for line in lines():
            kind, row = line[0], np.frombuffer(line, np.uint8, size, 1)
            if kind == 0:
                row = row.copy()
            elif kind == 1:
                row = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            elif kind == 2:
                row = row + above
            elif kind in (3, 4):
                row = _left_and_above(row, above, step, kind)
            else:
                raise UnreadableImage("an unknown PNG filter")
            above = row
            yield row.view(self.info.dtype.newbyteorder(">")).reshape(self.w, self.channels)

    def blocks(self, band: int, r0: int, r1: int, c0: int, c1: int) -> Iterator[tuple[int, int, np.ndarray]]:
        held: list[np.ndarray] = []
        top = r0
        for r, row in enumerate(self._rows()):
            if r >= r1:
                break
            if r >= r0:
                held.append(row[None, :, band])
            if len(held) == 256:
                yield top, 0, np.concatenate(held)
                top, held = r + 1, []
        if held:
            yield top, 0, np.concatenate(held)


def _left_and_above(row: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    """PNG's average and Paeth filters, whose every byte needs the one before."""
    out, up = bytearray(row.tobytes()), above.tobytes()
    for i, x in enumerate(out):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            out[i] = (x + (a + b) // 2) & 255
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[i] = (x + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.frombuffer(bytes(out), np.uint8)


def opened(source: Bytes) -> Tiff | Png:
    return Png(source) if source.at(0, min(8, source.size)) == b"\x89PNG\r\n\x1a\n" else Tiff(source)


def averaged(image: Tiff | Png, band: int, rows: tuple[int, int], factor: int) -> np.ndarray:
    """Rows of a band reduced by a whole factor: means of the pixels that hold data, zero and no data as NaN.

    Blocks are added to the sums one after the other, so only one is held.
    """
    info = image.info
    width = info.width // factor
    total, count = np.zeros((rows[1] - rows[0], width)), np.zeros((rows[1] - rows[0], width), np.int64)
    for top, left, block in image.blocks(band, rows[0] * factor, rows[1] * factor, 0, width * factor):
        y0, y1 = max(top, rows[0] * factor), min(top + block.shape[0], rows[1] * factor)
        x1 = min(left + block.shape[1], width * factor)
        if y0 >= y1 or left >= x1:
            continue
        value = block[y0 - top : y1 - top, : x1 - left].astype(np.float64)
        ok = np.isfinite(value)
        if info.nodata is not None and not np.isnan(info.nodata):
            ok &= value != info.nodata
        value = np.where(ok, value, 0.0)
        ys, xs = np.arange(y0, y1) // factor - rows[0], np.arange(left, x1) // factor
        cut_y, cut_x = np.flatnonzero(np.diff(ys, prepend=-1)), np.flatnonzero(np.diff(xs, prepend=-1))
        at = np.ix_(ys[cut_y], xs[cut_x])
        total[at] += np.add.reduceat(np.add.reduceat(value, cut_y, axis=0), cut_x, axis=1)
        count[at] += np.add.reduceat(np.add.reduceat(ok.astype(np.int64), cut_y, axis=0), cut_x, axis=1)
    mean = np.divide(total, count, out=np.full(total.shape, np.nan), where=count > 0)
    return np.where(mean == 0, np.nan, mean).astype(np.float32)


def describe(path: str) -> Raster:
    with Bytes(path) as source:
        return opened(source).info
