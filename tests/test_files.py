"""Scene and field files: planted TIFF, PNG and NetCDF files read by Spark, written by Spark and warped."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import raster, warp
from tidewake.sources import fields, images, netcdf, scene_files, scenes
from tidewake.sources.places import Bytes


def lzw(data):
    """A plain encoder: the dictionary is cleared before it is full."""
    bits, table, width, out = "", {bytes([i]): i for i in range(256)}, 9, []
    emit = lambda code: out.append(f"{code:0{width}b}")
    emit(256)
    size, w = 258, b""
    for b in data:
        c = w + bytes([b])
        if c in table:
            w = c
            continue
        emit(table[w])
        table[c] = size
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
        if size == 4094:
            emit(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = bytes([b])
    if w:
        emit(table[w])
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    emit(257)
    bits = "".join(out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def tiff(path, bands, order="<", compression=1, predictor=1, block=(64, 48), tiled=True, apart=False, ties=None, scale=None, keys=(), nodata=None, xml=""):
    """Writes ``bands`` (n, h, w) as a classic TIFF."""
    n, h, w = bands.shape
    bh, bw = block if tiled else (block[0], w)
    kind = bands.dtype.newbyteorder(order)
    blocks, planes = [], [bands[k : k + 1] for k in range(n)] if apart else [bands]
    for plane in planes:
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                cut = plane[:, r : r + bh, c : c + bw].transpose(1, 2, 0)
                if tiled:
                    cut = np.pad(cut, ((0, bh - cut.shape[0]), (0, bw - cut.shape[1]), (0, 0)))
                if predictor == 2:
                    cut = np.concatenate([cut[:, :1], np.diff(cut, axis=1)], axis=1)
                if predictor == 3:
                    planes8 = np.ascontiguousarray(cut.astype(bands.dtype.newbyteorder(">"))).view(np.uint8).reshape(cut.shape[0], -1, kind.itemsize).transpose(0, 2, 1).reshape(cut.shape[0], -1, cut.shape[2])
                    data = np.concatenate([planes8[:, :1], np.diff(planes8, axis=1)], axis=1).astype(np.uint8).tobytes()
                else:
                    data = np.ascontiguousarray(cut.astype(kind)).tobytes()
                blocks.append({1: lambda x: x, 5: lzw, 8: zlib.compress}[compression](data))
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b) + len(b) % 2
    lengths = [len(b) for b in blocks]
    form = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    entries = [(256, "I", [w]), (257, "I", [h]), (258, "H", [bands.dtype.itemsize * 8] * n), (259, "H", [compression]), (262, "H", [1]), (277, "H", [n]), (284, "H", [2 if apart else 1]), (317, "H", [predictor]), (339, "H", [form] * n)]
    entries += [(322, "I", [bw]), (323, "I", [bh]), (324, "I", offsets), (325, "I", lengths)] if tiled else [(273, "I", offsets), (278, "I", [bh]), (279, "I", lengths)]
    entries += [(33550, "d", list(scale))] if scale else []
    entries += [(33922, "d", list(ties))] if ties else []
    entries += [(34735, "H", list(keys))] if keys else []
    entries += [(42113, "s", f"{nodata}\0".encode())] if nodata is not None else []
    entries += [(42112, "s", xml.encode() + b"\0")] if xml else []
    entries.sort()
    free, beyond = at + 2 + 12 * len(entries) + 4, b""
    directory = struct.pack(order + "H", len(entries))
    for tag, code, v in entries:
        data = v if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
        many = len(v)
        if len(data) > 4:
            place = free + len(beyond)
            beyond += data + bytes(len(data) % 2)
            data = struct.pack(order + "I", place)
        directory += struct.pack(order + "HHI", tag, {"I": 4, "H": 3, "d": 12, "s": 2}[code], many) + data.ljust(4, b"\0")
    with open(path, "wb") as f:
        f.write((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at))
        for b in blocks:
            f.write(b + bytes(len(b) % 2))
        f.write(directory + struct.pack(order + "I", 0) + beyond)


def mosaic(rows, shape):
    out = np.full(shape, -1.0, np.float32)
    for r in rows:
        out[r["r0"] : r["r0"] + r["h"], r["c0"] : r["c0"] + r["w"]] = np.array(r["pixels"], np.float32).reshape(r["h"], r["w"])
    return out


def plain_mean(image, f, nodata=None):
    h, w = (n // f for n in image.shape)
    out = np.full((h, w), np.nan, np.float32)
    for r in range(h):
        for c in range(w):
            v = image[r * f : r * f + f, c * f : c * f + f].astype(float).ravel()
            v = v[np.isfinite(v) & (v != nodata)]
            if len(v) and v.mean() != 0:
                out[r, c] = v.mean()
    return out


KINDS = [
    {"dtype": "f4"}, {"dtype": "f4", "order": ">", "compression": 8, "predictor": 3}, {"dtype": "f8", "compression": 5, "tiled": False}, {"dtype": "u2", "compression": 5, "predictor": 2, "order": ">"},
    {"dtype": "i2", "compression": 8, "predictor": 2, "tiled": False, "block": (7, 0)}, {"dtype": "u1", "apart": True, "compression": 8}, {"dtype": "u4", "tiled": False, "apart": True}, {"dtype": "f4", "compression": 5, "predictor": 3, "tiled": False},
]


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: "-".join(map(str, k.values())))
def test_every_kind_of_tiff(spark, tmp_path, kind):
    scene_files.register(spark)
    draw = np.random.default_rng(4)
    kind = dict(kind)
    dtype = np.dtype(kind.pop("dtype"))
    bands = (draw.gamma(4, 0.02, (2, 150, 131)) if dtype.kind == "f" else draw.integers(0, 120, (2, 150, 131))).astype(dtype)
    bands[:, 10:20, 30:60] = 7
    path = str(tmp_path / "scene.tif")
    tiff(path, bands, nodata=7, scale=(0.01, 0.01, 0), ties=(0, 0, 0, 72.0, 19.0, 0), keys=(1, 1, 0, 1, 2048, 0, 1, 4326), xml='<GDALMetadata><Item name="POLARISATION">VV</Item></GDALMetadata>', **kind)
    info = images.describe(path)
    assert (info.width, info.height, info.bands, info.epsg, info.nodata, info.tags) == (131, 150, 2, 4326, 7.0, {"POLARISATION": "VV"})
    assert info.bounds == pytest.approx([72.0, 17.5, 73.31, 19.0])
    for f in (1, 3):
        table = spark.read.format("scene").option("size", 64).option("overlap", 16).option("factor", f).load(path)
        for band in (1, 2):
            got = mosaic(table.where(F.col("band") == band).collect(), (150 // f, 131 // f))
            np.testing.assert_allclose(got, plain_mean(bands[band - 1], f, 7), rtol=1e-6)
    # The tiles are those that the detector expects.
    cut = sorted((r["r0"], r["c0"], r["h"], r["w"]) for r in table.where("band = 1").select("r0", "c0", "h", "w").collect())
    assert cut == sorted((a, c, b - a, e - c) for a, b in raster.spans(50, 64, 16) for c, e in raster.spans(43, 64, 16))


def test_partitions_are_left_out(spark, tmp_path):
    scene_files.register(spark)
    path = str(tmp_path / "wide.tif")
    tiff(path, np.ones((1, 400, 90), np.float32))
    part = spark.read.format("scene").option("size", 50).option("window", "100,0,200,30").load(path)
    assert part.rdd.getNumPartitions() == 2 and part.count() == 2
    assert spark.read.format("scene").option("window", "900,0,950,30").load(path).count() == 0


def png(path, rows, depth, color, filters):
    """Writes (h, w, channels) with the given filter on each row in turn."""

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, n = rows.shape
    raw = rows.astype(">u2" if depth == 16 else "u1").tobytes()
    size, step = len(raw) // h, n * depth // 8
    out, above = b"", bytes(size)
    for r in range(h):
        line, kind = raw[r * size : (r + 1) * size], filters[r % len(filters)]
        done = bytearray()
        for i, x in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            done.append((x - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out, above = out + bytes([kind]) + bytes(done), line
    packed = zlib.compress(out)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + chunk(b"IDAT", packed[:100]) + chunk(b"IDAT", packed[100:]) + chunk(b"IEND", b""))


@pytest.mark.parametrize(("depth", "color", "n"), [(8, 0, 1), (16, 0, 1), (8, 2, 3), (8, 4, 2), (8, 6, 4)])
def test_every_filter_of_png(spark, tmp_path, depth, color, n):
    scene_files.register(spark)
    rows = np.random.default_rng(6).integers(1, 1 << depth, (61, 37, n))
    path = str(tmp_path / "chip.png")
    png(path, rows, depth, color, [0, 1, 2, 3, 4])
    table = spark.read.format("scene").option("size", 20).load(path)
    np.testing.assert_array_equal(mosaic(table.where("band = 1").collect(), (61, 37)), rows[..., 0].astype(np.float32))
    assert table.select("band").distinct().count() == min(2, n - (color in (4, 6)))
    assert images.describe(path).bounds is None


def test_unreadable_files(tmp_path):
    for data in (b"", b"II*\0", b"GIF89a..", b"II*\0\xff\xff\xff\x7f", b"\x89PNG\r\n\x1a\n"):
        (tmp_path / "x").write_bytes(data)
        with pytest.raises((ValueError, AttributeError)):
            images.describe(str(tmp_path / "x"))


def test_geotiff_written_by_tasks(spark, tmp_path):
    scene_files.register(spark)
    image = np.random.default_rng(2).gamma(4, 0.02, (530, 611)).astype(np.float32)
    path = str(tmp_path / "out" / "analysis.tif")
    tiles = raster.tile_table(spark, "s", image, 200, 30).repartition(5)

    def save(frame, mode="append"):
        frame.write.format("geotiff").option("width", 611).option("height", 530).option("bounds", "71.6,18.2,72.1,18.7").option("tag.polarisation", "VV & <VH>").mode(mode).save(path)

    save(tiles)
    info = images.describe(path)
    assert info.bounds == pytest.approx([71.6, 18.2, 72.1, 18.7]) and info.tags == {"POLARISATION": "VV & <VH>"} and info.epsg == 4326
    np.testing.assert_array_equal(mosaic(spark.read.format("scene").load(path).collect(), image.shape), image)
    with pytest.raises(Exception, match="there already"):
        save(tiles)
    with pytest.raises(Exception, match="outside the image"):
        save(tiles.withColumn("r0", F.col("r0") + 400), "overwrite")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["analysis.tif"]
    np.testing.assert_array_equal(mosaic(spark.read.format("scene").load(path).collect(), image.shape), image)


def test_preview_with_alpha():
    image = np.array([[1.0, np.nan], [30.0, 2.0]], np.float32)
    data = scenes.png(scenes.preview(image), np.isfinite(image))
    assert data[25] == 4  # grey with alpha
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert [raw[2], raw[4], raw[7], raw[9]] == [255, 0, 255, 255]


def bump(x, y):
    return np.exp(-(((x - 72.3) / 0.05) ** 2 + ((y - 18.6) / 0.04) ** 2)) + 0.2 * np.exp(-(((x - 72.12) / 0.03) ** 2 + ((y - 18.75) / 0.03) ** 2)) + 0.01


def test_control_points_bring_a_bent_scene_back(spark, tmp_path):
    """An affine and quadratic bend planted in the pixels, undone to half a pixel."""
    scene_files.register(spark)

    def degrees_of(c, r):
        u, v = c / 400, r / 300
        return 72.0 + 0.5 * u + 0.06 * v + 0.02 * u * v + 0.015 * u * u, 18.9 - 0.04 * u - 0.4 * v + 0.012 * v * v

    c, r = np.meshgrid(np.arange(400) + 0.5, np.arange(300) + 0.5)
    image = bump(*degrees_of(c, r)).astype(np.float32)
    ties = [v for a in np.linspace(0, 400, 5) for b in np.linspace(0, 300, 4) for v in (a, b, 0, *degrees_of(a, b), 0)]
    path = str(tmp_path / "gcp.tif")
    tiff(path, image[None], ties=ties, keys=(1, 1, 0, 1, 2048, 0, 1, 4326), compression=8)
    info = images.describe(path)
    assert len(info.control) == 20 and info.matrix is None
    for factor in (1, 2):
        source = spark.read.format("scene").option("size", 128).option("factor", factor).load(path)
        moved, target = warp.north_up(source, info, factor, size=100, overlap=20, source_size=128)
        got = mosaic(moved.collect(), (target.height, target.width))
        ok = np.isfinite(got) & (got >= 0)
        assert ok.mean() > 0.5
        x, y = warp._centres(target, 0, target.height, 0, target.width)
        # The peak lies where it was planted, and values differ by less than half a pixel's change.
        peak = np.unravel_index(np.where(ok, got, -1).argmax(), got.shape)
        assert abs(x[peak] - 72.3) <= target.pixel[0] / 2 + 1e-9 and abs(y[peak] - 18.6) <= target.pixel[1] / 2 + 1e-9
        step = np.hypot(*np.gradient(bump(x, y)))
        assert (np.abs(got - bump(x, y))[ok] <= step[ok] / 2 + 2e-3).all()


def test_utm_scene_becomes_degrees(spark, tmp_path):
    from tidewake.functions import geo

    scene_files.register(spark)
    east, north = geo.to_utm(72.0, 18.9, 32643)
    path = str(tmp_path / "utm.tif")
    c, r = np.meshgrid(np.arange(500) + 0.5, np.arange(400) + 0.5)
    lon, lat = geo.from_utm(east + 100 * c, north - 100 * r, 32643)
    image = bump(lon, lat).astype(np.float32)
    tiff(path, image[None], scale=(100, 100, 0), ties=(0, 0, 0, east, north, 0), keys=(1, 1, 0, 1, 3072, 0, 1, 32643))
    moved, target = warp.north_up(spark.read.format("scene").load(path), images.describe(path))
    got = mosaic(moved.collect(), (target.height, target.width))
    x, y = warp._centres(target, 0, target.height, 0, target.width)
    ok = np.isfinite(got)
    inner = ok.copy()  # at the rim a pixel has neighbours on one side only
    for axis in (0, 1):
        for step in (-2, 2):
            inner &= np.roll(ok, step, axis)
    assert ok.mean() > 0.9 and np.abs(got - bump(x, y))[ok].max() < 2e-2 and np.abs(got - bump(x, y))[inner].max() < 5e-4


def test_warp_meets_tiles_by_equality(spark, tmp_path):
    scene_files.register(spark)
    path = str(tmp_path / "x.tif")
    tiff(path, np.ones((1, 40, 40), np.float32), ties=(0, 0, 0, 72, 19, 0, 40, 0, 0, 73, 19, 0, 0, 40, 0, 72, 18, 0))
    moved, _ = warp.north_up(spark.read.format("scene").option("size", 16).load(path), images.describe(path), size=16, source_size=16)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {round(v, 5) for r in moved.collect() for v in r["pixels"] if v == v} == {1.0}


# ------------------------------------------------------------------ NetCDF


def cdf(path, dims, variables, version=1, record=None):
    """Writes a classic file: dims {name: length}, variables {name: (dims, array, attributes)}; ``record`` names the record dimension."""
    wide = version == 5
    count = lambda n: struct.pack(">q" if wide else ">i", n)
    pad = lambda b: b + bytes(-len(b) % 4)
    name = lambda s: count(len(s)) + pad(s.encode())
    codes = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}

    def attributes(values):
        out = struct.pack(">i", 12 if values else 0) + count(len(values))
        for k, v in values.items():
            out += name(k)
            if isinstance(v, str):
                out += struct.pack(">i", 2) + count(len(v)) + pad(v.encode())
            else:
                a = np.atleast_1d(v)
                out += struct.pack(">i", codes[a.dtype.str[1:]]) + count(len(a)) + pad(a.astype(a.dtype.newbyteorder(">")).tobytes())
        return out

    names = list(dims)
    raw = {k: np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">"))) for k, (_, a, _) in variables.items()}
    is_record = {k: bool(d) and d[0] == record for k, (d, _, _) in variables.items()}
    chunk = {k: len(pad(raw[k][:1].tobytes())) if is_record[k] else len(pad(raw[k].tobytes())) for k in raw}

    def laid(start):
        out = b"CDF" + bytes([version]) + count(dims[record] if record else 0) + struct.pack(">i", 10) + count(len(names)) + b"".join(name(n) + count(0 if n == record else dims[n]) for n in names)
        out += attributes({"title": "planted"}) + struct.pack(">i", 11) + count(len(variables))
        at = {}
        for k in [*(k for k in raw if not is_record[k]), *(k for k in raw if is_record[k])]:
            at[k], start = start, start + chunk[k]
        for k, (d, a, attrs) in variables.items():
            out += name(k) + count(len(d)) + b"".join(count(names.index(x)) for x in d) + attributes(attrs) + struct.pack(">i", codes[a.dtype.str[1:]]) + count(chunk[k]) + struct.pack(">i" if version == 1 else ">q", at[k])
        return out

    head = laid(len(laid(0)))
    with open(path, "wb") as f:
        f.write(head + b"".join(pad(raw[k].tobytes()) for k in raw if not is_record[k]))
        for i in range(dims[record] if record else 0):
            f.write(b"".join(pad(raw[k][i : i + 1].tobytes()) for k in raw if is_record[k]))


AXIS = {"time": np.array([3, 0, 1, 2], "f8"), "latitude": np.array([19.0, 18.5, 18.0], "f4"), "longitude": np.array([72.0, 72.25, 72.5, 72.75, 73.0], "f8")}


def planted(order, version, record=None, kind="f4", packed=False, units="m/s"):
    dims = {k: len(v) for k, v in AXIS.items()}
    t, y, x = np.meshgrid(*AXIS.values(), indexing="ij")
    base = t * 0.25 + (y - 18) * 2 + (x - 72) * 4
    out = {k: ([k], v, {"units": "hours since 2026-01-01 06:00:00 +02:00"} if k == "time" else {}) for k, v in AXIS.items()}
    for i, v in enumerate(("uo", "vo", "u10", "v10")):
        a = (base + i).transpose([list(AXIS).index(d) for d in order])
        attrs = {"units": units}
        if packed:
            a, attrs = a * 4 + 8, attrs | {"scale_factor": np.float64(0.25), "add_offset": np.float64(-2.0)}
        a = a.astype(kind)
        a[(0,) * 3] = -999
        out[v] = (list(order), a, attrs | {"_FillValue": np.array([-999], kind)})
    return dims, out, base


@pytest.mark.parametrize(
    ("order", "version", "record", "kind", "packed"),
    [(("time", "latitude", "longitude"), 1, None, "f4", False), (("longitude", "latitude", "time"), 2, None, "f8", False), (("latitude", "time", "longitude"), 5, None, "i2", True), (("time", "longitude", "latitude"), 2, "time", "i2", True), (("time", "latitude", "longitude"), 1, "time", "f4", False)],
)
def test_every_order_of_axes(spark, tmp_path, order, version, record, kind, packed):
    netcdf.register(spark)
    path = str(tmp_path / "field.nc")
    dims, variables, base = planted(order, version, record, kind, packed)
    cdf(path, dims, variables, version, record)
    table = spark.read.format("netcdf_field").option("slab_nodes", 16).load(path)
    assert table.rdd.getNumPartitions() > 1
    got = {(r["epoch"], r["lat"], r["lon"]): r for r in table.collect()}
    assert len(got) == base.size
    start = 1767240000.0  # 2026-01-01 04:00 UTC
    for i, t in enumerate(AXIS["time"]):
        for j, y in enumerate(AXIS["latitude"]):
            for k, x in enumerate(AXIS["longitude"]):
                r = got[start + t * 3600, float(y), float(x)]
                first = (i, j, k) == (0, 0, 0)
                assert [r[p] for p in fields.PARTS] == ([None] * 4 if first else pytest.approx([base[i, j, k] + n for n in range(4)]))


def test_area_and_time_narrow_the_slabs(spark, tmp_path):
    netcdf.register(spark)
    path = str(tmp_path / "field.nc")
    dims, variables, _ = planted(("time", "latitude", "longitude"), 2)
    cdf(path, dims, variables, 2)
    part = spark.read.format("netcdf_field").option("slab_nodes", 1).option("bounds", "71,18.4,72.3,18.6").option("from", 1767247200).load(path)
    assert part.rdd.getNumPartitions() == 4 and sorted((r["epoch"], r["lon"]) for r in part.collect()) == [(1767247200.0, 72.0), (1767247200.0, 72.25), (1767250800.0, 72.0), (1767250800.0, 72.25)]
    assert spark.read.format("netcdf_field").option("from", 2e9).load(path).count() == 0


def test_files_that_are_no_fields(tmp_path):
    def read(**changes):
        dims, variables, _ = planted(("time", "latitude", "longitude"), 1, units=changes.get("units", "m/s"))
        for k in changes.get("without", ()):
            del variables[k]
        if "time" in changes:
            variables["time"] = (["time"], AXIS["time"], changes["time"])
        cdf(str(tmp_path / "x.nc"), dims, variables)
        with Bytes(str(tmp_path / "x.nc")) as source:
            return netcdf.Field(source)

    assert read(units="M S-1").order == ["epoch", "lat", "lon"]
    for changes in ({"units": "knots"}, {"without": ["vo"]}, {"without": ["latitude"]}, {"time": {"units": "fortnights since 2000-01-01"}}, {"time": {"units": "days since 2000-01-01", "calendar": "noleap"}}):
        with pytest.raises(fields.NoField):
            read(**changes)
    (tmp_path / "h").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(100))
    with pytest.raises(fields.NoField), Bytes(str(tmp_path / "h")) as source:
        netcdf.Header(source)


def test_a_field_written_by_tasks(spark, tmp_path):
    netcdf.register(spark)
    nodes = spark.range(5 * 4 * 3).select((F.col("id") % 5 * 3600.0).alias("epoch"), (F.floor(F.col("id") / 5) % 4 + 17.5).alias("lat"), (F.floor(F.col("id") / 20) * 0.25 + 70).alias("lon"), *[F.when(F.col("id") % 7 > 0, F.col("id") * 0.5 + i).alias(p) for i, p in enumerate(fields.PARTS)])
    path = str(tmp_path / "out.nc")
    netcdf.write_field(nodes.repartition(6), path)
    again = spark.read.format("netcdf_field").load(path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nodes.collect())) or again.exceptAll(nodes).count() == nodes.exceptAll(again).count() == 0
    with pytest.raises(Exception, match="nodes was given"):
        netcdf.write_field(nodes.where("epoch > 0 or lat > 18"), str(tmp_path / "part.nc"))
    assert not (tmp_path / "part.nc").exists()
