"""FlatGeobuf files: header and features by their public binary layout, and a Spark data source over the packed R-tree.

A file holds a header, an R-tree whose nodes lie level by level from the root down, and features in the order of the
tree's leaves.  A filter on the box of features goes down the tree: the driver reads the upper levels only, tasks read
the nodes below and those features that the box meets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tarn.sources.pmtiles import file_reader

#: Fixed values of the format: first bytes (the last is a patch number), children of a node, node layout, kinds of geometry and of columns.
MAGIC = b"fgb\x03fgb\x00"
FAN = 16
NODE = np.dtype([("min_x", "<f8"), ("min_y", "<f8"), ("max_x", "<f8"), ("max_y", "<f8"), ("offset", "<u8")])
LINE = 2
GEOMETRIES = ("Unknown", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
BYTE, UBYTE, BOOL, SHORT, USHORT, INT, UINT, LONG, ULONG, FLOAT, DOUBLE, STRING, JSON, DATETIME, BINARY = range(15)
_SCALARS = {BYTE: "<b", UBYTE: "<B", BOOL: "<?", SHORT: "<h", USHORT: "<H", INT: "<i", UINT: "<I", LONG: "<q", ULONG: "<Q", FLOAT: "<f", DOUBLE: "<d"}
#: Columns of the files that are written here.
COLUMNS = (("id", LONG), ("name", STRING), ("highway", STRING))
SCHEMA = "id long, name string, highway string, type string, coords array<struct<lng:double,lat:double>>, min_x double, min_y double, max_x double, max_y double"
BOX = ("min_x", "min_y", "max_x", "max_y")
#: Nodes that the driver goes down to at most, bytes read at once, features of a batch.
FRONTIER, READ_BYTES, BATCH = 64, 4 << 20, 4096


def level_sizes(n: int, fan: int = FAN) -> list[int]:
    """Nodes on each level, leaves first."""
    out = [n]
    while True:
        n = -(-n // fan)
        out.append(n)
        if n <= 1:
            return out


def level_starts(sizes: list[int]) -> list[int]:
    """Number of the first node of each level, leaves first; the root is node 0."""
    out, at = [], sum(sizes)
    for n in sizes:
        at -= n
        out.append(at)
    return out


class Table:
    """A table of a flat buffer: fields by number, each found through the table's list of places."""

    def __init__(self, buf: bytes, at: int):
        self.buf, self.at = buf, at
        self.places = at - struct.unpack_from("<i", buf, at)[0]
        self.n = (struct.unpack_from("<H", buf, self.places)[0] - 4) // 2

    def place(self, k: int) -> int | None:
        off = struct.unpack_from("<H", self.buf, self.places + 4 + 2 * k)[0] if k < self.n else 0
        return self.at + off if off else None

    def scalar(self, k: int, code: str, default):
        p = self.place(k)
        return default if p is None else struct.unpack_from(code, self.buf, p)[0]

    def _there(self, p: int) -> int:
        return p + struct.unpack_from("<I", self.buf, p)[0]

    def table(self, k: int) -> Table | None:
        p = self.place(k)
        return None if p is None else Table(self.buf, self._there(p))

    def vector(self, k: int, size: int) -> bytes:
        """Bytes of a vector whose items have ``size`` bytes; none if it is not there."""
        p = self.place(k)
        if p is None:
            return b""
        v = self._there(p)
        return self.buf[v + 4 : v + 4 + size * struct.unpack_from("<I", self.buf, v)[0]]

    def text(self, k: int) -> str:
        return self.vector(k, 1).decode("utf-8")

    def tables(self, k: int) -> list[Table]:
        p = self.place(k)
        if p is None:
            return []
        v = self._there(p)
        return [Table(self.buf, self._there(v + 4 + 4 * i)) for i in range(struct.unpack_from("<I", self.buf, v)[0])]


def root_table(buf: bytes) -> Table:
    return Table(buf, struct.unpack_from("<I", buf, 0)[0])


@dataclass
class Header:
    kind: int
    columns: list[tuple[str, int]]
    features: int
    fan: int
    size: int

    @property
    def nodes_at(self) -> int:
        return len(MAGIC) + 4 + self.size

    @property
    def levels(self) -> list[int]:
        return level_sizes(self.features, self.fan) if self.fan and self.features else []

    @property
    def features_at(self) -> int:
        return self.nodes_at + NODE.itemsize * sum(self.levels)

    @staticmethod
    def read(read) -> Header:
        head = read(0, len(MAGIC) + 4)
        if len(head) < len(MAGIC) + 4 or head[:3] != MAGIC[:3] or head[3] != MAGIC[3]:
            raise ValueError("not a FlatGeobuf file")
        size = struct.unpack_from("<I", head, len(MAGIC))[0]
        t = root_table(read(len(MAGIC) + 4, size))
        columns = [(c.text(0), c.scalar(1, "<B", 0)) for c in t.tables(7)]
        return Header(t.scalar(2, "<B", 0), columns, t.scalar(8, "<Q", 0), t.scalar(9, "<H", FAN), size)


def _put(buf: bytearray, fields: dict[int, tuple[str, object]]) -> int:
    """Appends a table, then what it refers to, and gives its place.  Kinds: scalars by struct code, str, f64s, tables."""
    inline = {k: struct.calcsize(f"<{kind}") if len(kind) == 1 else 4 for k, (kind, _) in fields.items()}
    offs, at = {}, 4
    for k in sorted(fields, key=lambda k: -inline[k]):
        at = -(-at // inline[k]) * inline[k]
        offs[k] = at
        at += inline[k]
    n = max(fields, default=-1) + 1
    # Whatever is widest begins on a multiple of its width.
    while (len(buf) + 4 + 2 * n) % 8:
        buf.append(0)
    places = len(buf)
    buf += struct.pack(f"<{n + 2}H", 4 + 2 * n, at, *(offs.get(k, 0) for k in range(n)))
    here = len(buf)
    buf += struct.pack("<i", here - places) + b"\0" * (at - 4)
    for k, (kind, value) in fields.items():
        p = here + offs[k]
        if len(kind) == 1:
            struct.pack_into(f"<{kind}", buf, p, value)
            continue
        if kind == "f64s":
            while (len(buf) + 4) % 8:
                buf.append(0)
        while len(buf) % 4:
            buf.append(0)
        struct.pack_into("<I", buf, p, len(buf) - p)
        v = len(buf)
        if kind == "str":
            raw = str(value).encode("utf-8")
            buf += struct.pack("<I", len(raw)) + raw + b"\0"
        elif kind == "f64s":
            buf += struct.pack(f"<I{len(value)}d", len(value), *value)
        else:
            buf += struct.pack("<I", len(value)) + b"\0" * (4 * len(value))
            for i, sub in enumerate(value):
                there = _put(buf, sub)
                struct.pack_into("<I", buf, v + 4 + 4 * i, there - (v + 4 + 4 * i))
    return here


def pack_header(name: str, envelope: tuple[float, float, float, float] | None, n: int, fan: int = FAN) -> bytes:
    """The first bytes of a file of lines with COLUMNS, up to the tree."""
    columns = [{0: ("str", c), 1: ("B", kind)} for c, kind in COLUMNS]
    fields: dict[int, tuple[str, object]] = {0: ("str", name), 2: ("B", LINE), 7: ("tables", columns), 8: ("Q", n), 9: ("H", fan)}
    if envelope is not None:
        fields[1] = ("f64s", envelope)
    buf = bytearray(8)  # the size, and where the table is
    there = _put(buf, fields)
    struct.pack_into("<I", buf, 4, there - 4)
    while len(buf) % 8:
        buf.append(0)
    struct.pack_into("<I", buf, 0, len(buf) - 4)
    return MAGIC + bytes(buf)


#: A feature up to its coordinates: size, place of its table; places of geometry and properties; the table; then the same for the geometry, which has coordinates only; their number.
_FEATURE = struct.Struct("<II4HiII4HiII")


def pack_feature(xy: np.ndarray, identity: int | None, name: str | None, highway: str | None) -> bytes:
    """A line of points (n, 2) and its properties; those that are null are left out."""
    parts = []
    if identity is not None:
        parts.append(struct.pack("<Hq", 0, identity))
    for k, v in ((1, name), (2, highway)):
        if v is not None:
            raw = v.encode("utf-8")
            parts.append(struct.pack("<HI", k, len(raw)) + raw)
    props, coords = b"".join(parts), np.ascontiguousarray(xy, "<f8").tobytes()
    size = 48 + len(coords) + 4 + len(props)
    head = _FEATURE.pack(size - 4, 12, 8, 12, 4, 8, 8, 16, 24 + len(coords), 8, 8, 0, 4, 8, 4, len(coords) // 8)
    return head + coords + struct.pack("<I", len(props)) + props


def unpack_feature(raw: bytes, columns: list[tuple[str, int]], kind: int) -> tuple[str, np.ndarray, dict]:
    """(kind of geometry, points, properties) of a feature without its size."""
    t = root_table(raw)
    shape = t.table(0)
    xy = np.frombuffer(shape.vector(1, 8), "<f8").reshape(-1, 2) if shape is not None else np.zeros((0, 2))
    own = shape.scalar(6, "<B", 0) if shape is not None else 0
    props, found, at = t.vector(1, 1), {}, 0
    listed = [(c.text(0), c.scalar(1, "<B", 0)) for c in t.tables(2)] or columns
    while at + 2 <= len(props):
        name, what = listed[struct.unpack_from("<H", props, at)[0]]
        at += 2
        if what in _SCALARS:
            found[name] = struct.unpack_from(_SCALARS[what], props, at)[0]
            at += struct.calcsize(_SCALARS[what])
        else:
            n = struct.unpack_from("<I", props, at)[0]
            body = props[at + 4 : at + 4 + n]
            found[name] = body if what == BINARY else body.decode("utf-8")
            at += 4 + n
    return GEOMETRIES[own or kind], xy, found


def register(spark: SparkSession) -> None:
    """Makes ``format("flatgeobuf")`` known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeatureSource)


class FeatureSource(DataSource):
    """``spark.read.format("flatgeobuf").load(path)``: a row a feature (`SCHEMA`), null where a property is not there."""

    @classmethod
    def name(cls) -> str:
        return "flatgeobuf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], schema)


@dataclass
class Box:
    """What filters leave: a feature's box must meet it."""

    west: float = float("-inf")
    south: float = float("-inf")
    east: float = float("inf")
    north: float = float("inf")

    def add(self, f: Filter) -> None:
        """Bounds on a side of a feature's box; others are left to Spark."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            # What lies right of a bound has its right side there, too.
            if column in ("max_x", "min_x"):
                self.west = max(self.west, f.value)
            elif column in ("max_y", "min_y"):
                self.south = max(self.south, f.value)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            if column in ("min_x", "max_x"):
                self.east = min(self.east, f.value)
            elif column in ("min_y", "max_y"):
                self.north = min(self.north, f.value)

    def meets(self, nodes: np.ndarray) -> np.ndarray:
        return (nodes["max_x"] >= self.west) & (nodes["min_x"] <= self.east) & (nodes["max_y"] >= self.south) & (nodes["min_y"] <= self.north)

    @property
    def everywhere(self) -> bool:
        return self == Box()


@dataclass
class Part(InputPartition):
    """Runs of nodes of a level whose features a task looks for; or, in a file without a tree, all of it."""

    level: int
    runs: list[tuple[int, int]] = field(default_factory=list)


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.box = path, schema, Box()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.box.add(f)
            yield f

    def _below(self, read, header: Header, level: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of nodes of the level below whose parents, in ``runs`` of ``level``, meet the box."""
        out: list[tuple[int, int]] = []
        sizes = header.levels
        start = level_starts(sizes)
        for a, b in runs:
            nodes = np.frombuffer(read(header.nodes_at + NODE.itemsize * (start[level] + a), NODE.itemsize * (b - a)), NODE)
            for k in (np.flatnonzero(self.box.meets(nodes)) + a).tolist():
                first, last = k * header.fan, min((k + 1) * header.fan, sizes[level - 1])
                if out and out[-1][1] == first:
                    out[-1] = (out[-1][0], last)
                else:
                    out.append((first, last))
        return out

    def partitions(self) -> list[Part]:
        read = file_reader(self.path)
        header = Header.read(read)
        if not header.levels:
            return [Part(-1)]
        level, runs = len(header.levels) - 1, [(0, header.levels[-1])]
        while level and sum(b - a for a, b in runs) < FRONTIER and runs:
            runs = self._below(read, header, level, runs)
            level -= 1
        # As many parts as nodes are left, or fewer.
        every = [(k, k + 1) for a, b in runs for k in range(a, b)]
        step = max(1, -(-len(every) // FRONTIER))
        return [Part(level, _joined(every[k : k + step])) for k in range(0, len(every), step)] or [Part(0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        read = file_reader(self.path)
        header = Header.read(read)
        if partition.level < 0:
            yield from self._all(read, header)
            return
        level, runs = partition.level, partition.runs
        while level:
            runs = self._below(read, header, level, runs)
            level -= 1
        start, n = level_starts(header.levels)[0], header.features
        wanted: list[tuple[int, int | None]] = []
        for a, b in runs:
            # One leaf more tells where the last feature ends.
            nodes = np.frombuffer(read(header.nodes_at + NODE.itemsize * (start + a), NODE.itemsize * (min(b + 1, n) - a)), NODE)
            begins = nodes["offset"].tolist()
            wanted += [(begins[k], begins[k + 1] if k + 1 < len(begins) else None) for k in np.flatnonzero(self.box.meets(nodes[: b - a])).tolist()]
        yield from self._batches(self._features(read, header, wanted), header)

    def _features(self, read, header: Header, wanted: list[tuple[int, int | None]]) -> Iterator[bytes]:
        k = 0
        while k < len(wanted):
            m = k + 1
            while m < len(wanted) and wanted[m][0] == wanted[m - 1][1] and wanted[m][0] - wanted[k][0] < READ_BYTES:
                m += 1
            first, last = wanted[k][0], wanted[m - 1]
            end = last[1] if last[1] is not None else last[0] + 4 + struct.unpack("<I", read(header.features_at + last[0], 4))[0]
            raw = read(header.features_at + first, end - first)
            for begin, _ in wanted[k:m]:
                at = begin - first
                yield raw[at + 4 : at + 4 + struct.unpack_from("<I", raw, at)[0]]
            k = m

    def _all(self, read, header: Header) -> Iterator[pa.RecordBatch]:
        def features() -> Iterator[bytes]:
            at = header.features_at
            while len(head := read(at, 4)) == 4:
                size = struct.unpack("<I", head)[0]
                yield read(at + 4, size)
                at += 4 + size

        yield from self._batches(features(), header)

    def _batches(self, features: Iterator[bytes], header: Header) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, np.ndarray, dict]] = []
        for raw in features:
            held.append(unpack_feature(raw, header.columns, header.kind))
            if len(held) >= BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, held: list[tuple[str, np.ndarray, dict]]) -> pa.RecordBatch:
        def whole(v):
            return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else None

        def text(v):
            return None if v is None else str(v)

        sizes = np.array([len(xy) for _, xy, _ in held])
        every = np.concatenate([xy for _, xy, _ in held])
        offs = np.concatenate(([0], np.cumsum(sizes)))
        points = pa.StructArray.from_arrays([pa.array(every[:, 0].copy()), pa.array(every[:, 1].copy())], names=["lng", "lat"])
        columns = {"id": lambda: pa.array([whole(p.get("id")) for *_, p in held], pa.int64()), "name": lambda: pa.array([text(p.get("name")) for *_, p in held], pa.string()), "highway": lambda: pa.array([text(p.get("highway")) for *_, p in held], pa.string()), "type": lambda: pa.array([kind for kind, *_ in held]), "coords": lambda: pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), points)}
        for k, name in enumerate(BOX):
            ends = np.minimum if k < 2 else np.maximum
            columns[name] = lambda k=k, ends=ends: pa.array([float(ends.reduce(xy[:, k % 2])) if len(xy) else None for _, xy, _ in held], pa.float64())
        names = self.schema.fieldNames()
        return pa.RecordBatch.from_arrays([columns[c]() for c in names], names=names)


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
