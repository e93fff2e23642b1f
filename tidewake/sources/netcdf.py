"""Met-ocean fields in NetCDF files of the classic formats (CDF-1, 2 and 5).

    register(spark)
    field = spark.read.format("netcdf_field").option("bounds", "71,17,73,19").load("/data/currents.nc")
    write_field(field, "/data/copy.nc")

The header is read for its variables and axes.  Every partition is a slab
along the first axis of the file and reads its own bytes; an area and a time
given as options narrow the slabs.  Values lie where the header says, so a written
file is filled by all tasks at once.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewake.sources.fields import AXES, PARTS, VARIABLES, NoField
from tidewake.sources.places import Bytes, Draft

SCHEMA = "epoch double, lat double, lon double, " + ", ".join(f"{p} double" for p in PARTS)
# Fixed values of the classic format, and the units that a field may have.
_KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES, _DOUBLE, _CHAR = 10, 11, 12, 6, 2
SPEED_UNITS = frozenset({"m/s", "m s-1", "meter/second", "m.s-1"})
_SECONDS = {"second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400}
_CALENDARS = frozenset({"standard", "gregorian", "proleptic_gregorian"})
#: Nodes of a slab, as far as whole steps of the first axis allow.
SLAB_NODES = 1 << 18


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: np.dtype
    begin: int
    record: bool


class Header:
    """Dimensions, attributes and variables of a classic NetCDF file."""

    def __init__(self, source: Bytes) -> None:
        self.source, self.at, self.held = source, 0, b""
        mark = self._take(4)
        if mark[:3] != b"CDF" or mark[3] not in (1, 2, 5):
            raise NoField("only NetCDF files of the classic formats are read")
        self.wide, self.far = mark[3] == 5, mark[3] != 1
        self.records = self._count()
        tag, n = self._list()
        self.dims = [(self._name(), self._count()) for _ in range(n)]
        self.attributes = self._attribute_list()
        tag, n = self._list()
        raw = []
        for _ in range(n):
            name = self._name()
            dims = [self._count() for _ in range(self._count())]
            attributes, kind = self._attribute_list(), np.dtype(_KINDS[self._int()])
            self._count()  # its size, which follows from the dimensions
            begin = struct.unpack(">q" if self.far else ">i", self._take(8 if self.far else 4))[0]
            raw.append(Variable(name, dims, attributes, kind, begin, bool(dims) and self.dims[dims[0]][1] == 0))
        self.variables = {v.name: v for v in raw}
        sizes = [int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * v.kind.itemsize for v in raw if v.record]
        self.record_size = sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:  # the header is read piece by piece
            more = self.source.at(self.at + len(self.held), min(1 << 16, self.source.size - self.at - len(self.held)))
            if not more:
                raise NoField("the NetCDF header is cut off")
            self.held += more
        out, self.held, self.at = self.held[:n], self.held[n:], self.at + n
        return out

    def _int(self) -> int:
        return struct.unpack(">i", self._take(4))[0]

    def _count(self) -> int:
        return struct.unpack(">q", self._take(8))[0] if self.wide else self._int()

    def _list(self) -> tuple[int, int]:
        return self._int(), self._count()

    def _name(self) -> str:
        n = self._count()
        return self._take(-(-n // 4) * 4)[:n].decode("utf-8")

    def _attribute_list(self) -> dict:
        out = {}
        for _ in range(self._list()[1]):
            name, kind, n = self._name(), np.dtype(_KINDS[self._int()]), self._count()
            data = self._take(-(-n * kind.itemsize // 4) * 4)[: n * kind.itemsize]
            out[name] = data.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(data, kind).astype(float if kind.kind == "f" else int).tolist()
        return out

    def shape(self, v: Variable) -> list[int]:
        return [self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in v.dims]

    def names(self, v: Variable) -> list[str]:
        return [self.dims[d][0] for d in v.dims]

    def read(self, v: Variable, part: list[tuple[int, int]]) -> np.ndarray:
        """The values of a box of indexes; bytes between its runs are not read."""
        shape = self.shape(v)
        size = v.kind.itemsize
        # Axes that are read in full lie in one run with the one before them; records lie apart.
        outer = len(shape) - 1
        while outer > 0 and part[outer] == (0, shape[outer]):
            outer -= 1
        outer = max(outer, 1) if v.record else outer
        strides = [size * int(np.prod(shape[i + 1 :], dtype=np.int64)) for i in range(len(shape))]
        if v.record:
            strides[0] = self.record_size
        out = np.empty([b - a for a, b in part], np.float64)
        inner = int(np.prod([b - a for a, b in part[outer:]], dtype=np.int64))
        for index in np.ndindex(*[b - a for a, b in part[:outer]]):
            place = v.begin + sum((a + i) * s for (a, _), i, s in zip(part, index, strides, strict=False)) + (part[outer][0] * strides[outer] if outer < len(part) else 0)
            out[index] = np.frombuffer(self.source.at(place, inner * size), v.kind).reshape([b - a for a, b in part[outer:]])
        for name in ("_FillValue", "missing_value"):
            if name in v.attributes:
                out[out == v.attributes[name][0]] = np.nan
        return out * v.attributes.get("scale_factor", [1.0])[0] + v.attributes.get("add_offset", [0.0])[0]


def seconds(units: str) -> tuple[float, float]:
    """(seconds of a unit, epoch of its origin) of units like ``hours since 2024-01-01 00:00``."""
    found = re.fullmatch(r"\s*([a-z]+?)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[t ]\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?\s*(z|utc|[+-]\d{1,2}:?\d{0,2})?\s*", units.lower())
    if not found or found[1] not in _SECONDS:
        raise NoField(f"the time unit {units!r} is not known")
    year, month, day, hour, minute = (int(x or 0) for x in found.groups()[1:6])
    origin = datetime(year, month, day, hour, minute, tzinfo=timezone.utc).timestamp() + float(found[7] or 0)
    if (zone := found[8]) and zone[0] in "+-":
        h, _, m = zone[1:].partition(":")
        h, m = (h[:-2], h[-2:]) if not m and len(h) > 2 else (h, m)
        origin -= (1 if zone[0] == "+" else -1) * (int(h) * 3600 + int(m or 0) * 60)
    return float(_SECONDS[found[1]]), origin


class Field:
    """Which variables of a file are the axes and parts of a field."""

    def __init__(self, source: Bytes) -> None:
        self.header = h = Header(source)
        dims = [name for name, _ in h.dims]
        self.axes: dict[str, np.ndarray] = {}
        self.dim: dict[str, str] = {}
        for axis, names in AXES.items():
            name = next((n for n in names if n in h.variables and n in dims), None)
            if name is None:
                raise NoField(f"the file has no coordinate {' or '.join(names)}")
            v = h.variables[name]
            values = h.read(v, [(0, n) for n in h.shape(v)])
            if axis == "epoch":
                if str(v.attributes.get("calendar", "standard")).lower() not in _CALENDARS:
                    raise NoField("only the Gregorian calendar is read")
                unit, origin = seconds(str(v.attributes.get("units", "seconds since 1970-01-01")))
                values = np.floor(values * unit + origin + 1e-6)
            self.axes[axis], self.dim[axis] = values, name
        self.parts: dict[str, Variable] = {}
        for part, names in VARIABLES.items():
            name = next((n for n in names if n in h.variables and n not in dims), None)
            if name is None:
                raise NoField(f"the file has no variable for {part}; names that are known: {', '.join(names)}")
            v = h.variables[name]
            if sorted(h.names(v)) != sorted(self.dim.values()):
                raise NoField(f"{name} must lie on time, latitude and longitude")
            units = str(v.attributes.get("units", "m/s")).lower()
            if units not in SPEED_UNITS:
                raise NoField(f"{name} must be in metres a second, not in {units}")
            self.parts[part] = v

    @property
    def order(self) -> list[str]:
        """Axes of the first part, as they lie in the file."""
        back = {name: axis for axis, name in self.dim.items()}
        return [back[n] for n in self.header.names(self.parts[PARTS[0]])]

    def slab(self, box: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
        """Each part in a box of indexes, with axes in the order epoch, lat, lon."""
        back = {name: axis for axis, name in self.dim.items()}
        out = {}
        for part, v in self.parts.items():
            axes = [back[n] for n in self.header.names(v)]
            out[part] = self.header.read(v, [box[a] for a in axes]).transpose([axes.index(a) for a in ("epoch", "lat", "lon")])
        return out


@dataclass
class Slab(InputPartition):
    box: dict[str, tuple[int, int]]


class FieldReader(DataSourceReader):
    """(epoch, lat, lon, parts) of a file; missing values are null, axes may run either way."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.nodes = options["path"], int(options.get("slab_nodes", SLAB_NODES))
        west, south, east, north = (float(x) for x in options.get("bounds", "-inf,-inf,inf,inf").split(","))
        self.limits = {"epoch": (float(options.get("from", "-inf")), float(options.get("to", "inf"))), "lat": (south, north), "lon": (west, east)}
        with Bytes(self.path) as source:
            field = Field(source)
        self.axes, self.order = field.axes, field.order

    def _range(self, axis: str) -> tuple[int, int]:
        x, (low, high) = self.axes[axis], self.limits[axis]
        at = np.flatnonzero((x >= low) & (x <= high))
        return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)

    def partitions(self) -> list[Slab]:
        box = {a: self._range(a) for a in AXES}
        first, *rest = self.order
        each = int(np.prod([box[a][1] - box[a][0] for a in rest], dtype=np.int64))
        step = max(1, self.nodes // max(each, 1))
        begin, end = box[first]
        return [Slab(box | {first: (i, min(i + step, end))}) for i in range(begin, end if each else begin, step)] or [Slab({})]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if not partition.box:
            return
        with Bytes(self.path) as source:
            parts = Field(source).slab(partition.box)
        at = [self.axes[a][slice(*partition.box[a])] for a in ("epoch", "lat", "lon")]
        # Where an axis isn't sorted, a range of indexes holds others besides.
        kept = np.ix_(*[(x >= self.limits[a][0]) & (x <= self.limits[a][1]) for x, a in zip(at, ("epoch", "lat", "lon"), strict=True)])
        columns = [x[kept].ravel() for x in np.meshgrid(*at, indexing="ij")]
        parts = {p: v[kept] for p, v in parts.items()}
        names = ["epoch", "lat", "lon", *PARTS]
        yield pa.record_batch([*(pa.array(c) for c in columns), *(pa.array(parts[p].ravel(), from_pandas=True) for p in PARTS)], names=names)


class FieldSource(DataSource):
    """Options: path, slab_nodes (nodes of a partition, 262144), bounds "west,south,east,north", from and to (epochs)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_field"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FieldReader:
        return FieldReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FieldWriter:
        return FieldWriter(dict(self.options), overwrite)


def header(axes: dict[str, list[float]]) -> tuple[bytes, int]:
    """(header with the axes' values, place of the first part) of a CDF-5 file of doubles on (time, latitude, longitude)."""

    def name(text: str) -> bytes:
        raw = text.encode()
        return struct.pack(">q", len(raw)) + raw + bytes(-len(raw) % 4)

    def attributes(**values: str | float) -> bytes:
        out = struct.pack(">iq", _ATTRIBUTES, len(values))
        for key, v in values.items():
            out += name(key) + (struct.pack(">iq", _CHAR, len(v)) + v.encode() + bytes(-len(v) % 4) if isinstance(v, str) else struct.pack(">iqd", _DOUBLE, 1, v))
        return out

    lengths = [len(axes[a]) for a in ("epoch", "lat", "lon")]
    names = ["time", "latitude", "longitude"]
    units = ["seconds since 1970-01-01 00:00:00", "degrees_north", "degrees_east"]
    variables = [(n, [i], attributes(units=u), lengths[i] * 8) for i, (n, u) in enumerate(zip(names, units, strict=True))]
    variables += [(VARIABLES[p][0], [0, 1, 2], attributes(units="m/s", _FillValue=float("nan")), int(np.prod(lengths, dtype=np.int64)) * 8) for p in PARTS]

    def laid(begin: int) -> bytes:
        out = b"CDF\x05" + struct.pack(">q", 0) + struct.pack(">iq", _DIMENSIONS, 3) + b"".join(name(n) + struct.pack(">q", k) for n, k in zip(names, lengths, strict=True))
        out += attributes(Conventions="CF-1.8") + struct.pack(">iq", _VARIABLES, len(variables))
        for n, dims, attrs, size in variables:
            out += name(n) + struct.pack(f">q{len(dims)}q", len(dims), *dims) + attrs + struct.pack(">iqq", _DOUBLE, size, begin)
            begin += size
        return out

    begin = -(-len(laid(0)) // 4096) * 4096
    head = laid(begin)
    values = b"".join(np.asarray(axes[a], ">f8").tobytes() for a in ("epoch", "lat", "lon"))
    return head + bytes(begin - len(head)) + values, begin + len(values)


class FieldWriter(DataSourceArrowWriter):
    """Tasks write nodes to their places in a draft; the commit counts them and gives it its name."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.axes = {a: [float(x) for x in options[f"axis.{a}"].split(",")] for a in AXES}
        self.draft = Draft(options["path"])
        if os.path.exists(self.draft.path) and not overwrite:
            raise ValueError(f"{self.draft.path} is there already")
        head, self.first = header(self.axes)
        self.nodes = int(np.prod([len(self.axes[a]) for a in AXES], dtype=np.int64))
        self.draft.begin(head, self.first + self.nodes * 8 * len(PARTS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        axes = {a: np.asarray(v) for a, v in self.axes.items()}
        n, file = 0, self.draft.open()
        try:
            for batch in iterator:
                column = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
                t, y, x = (np.searchsorted(axes[a], column[a]) for a in ("epoch", "lat", "lon"))
                node = (t * len(axes["lat"]) + y) * len(axes["lon"]) + x
                order = np.argsort(node)
                runs = np.flatnonzero(np.diff(node[order], prepend=-2) != 1)
                for k, part in enumerate(PARTS):
                    values = column[part][order].astype(">f8")
                    for a, b in zip(runs, [*runs[1:], len(order)], strict=True):
                        os.pwrite(file, values[a:b].tobytes(), self.first + (k * self.nodes + int(node[order[a]])) * 8)
                n += len(order)
            os.fsync(file)
        finally:
            os.close(file)
        return Written(n)

    def commit(self, messages: list) -> None:
        if (n := sum(m.nodes for m in messages if m)) != self.nodes:
            self.draft.abort()
            raise ValueError(f"a regular field of {self.nodes} nodes was given {n}")
        self.draft.commit()

    def abort(self, messages: list) -> None:
        self.draft.abort()


@dataclass
class Written(WriterCommitMessage):
    nodes: int


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(FieldSource)


def write_field(field: DataFrame, path: str, mode: str = "append") -> None:
    """A whole regular field as one file on a mounted folder; only its axes come to the driver, null values are kept."""
    register(field.sparkSession)
    writer = field.select("epoch", "lat", "lon", *PARTS).sortWithinPartitions("epoch", "lat", "lon").write.format("netcdf_field").mode(mode)
    for axis in AXES:
        values = sorted(r[0] for r in field.select(axis).distinct().collect())  # an axis
        writer = writer.option(f"axis.{axis}", ",".join(map(repr, values)))
    writer.save(path)
