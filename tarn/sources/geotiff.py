"""Single-band GeoTIFF elevation rasters: a Spark data source with a task for some chunks, and a small writer."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: tags, sizes of field types, and the samples that are read (format, bits).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d"}
SAMPLES = {(2, 16): "i2", (2, 32): "i4", (1, 16): "u2", (1, 8): "u1", (3, 32): "f4", (3, 64): "f8"}
MAX_CHUNK_SAMPLES = 64 << 20


class TiffError(ValueError):
    """The file breaks the format or uses what is not read here."""


@dataclass(frozen=True)
class Raster:
    """What the first directory of a file says."""

    order: str
    width: int
    height: int
    chunk_width: int
    chunk_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    dtype: str
    compression: int
    predictor: int
    nodata: float | None
    west: float
    north: float
    dx: float
    dy: float

    @property
    def columns(self) -> int:
        return -(-self.width // self.chunk_width)

    def bounds(self) -> tuple[float, float, float, float]:
        return self.west, self.north - self.height * self.dy, self.west + self.width * self.dx, self.north

    def chunk(self, raw: bytes, number: int) -> tuple[int, int, np.ndarray]:
        """(first column, first row, elevations with NaN for no data) of a chunk, cut to the raster."""
        if self.compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif self.compression == 5:
            raw = unlzw(raw)
        elif self.compression != 1:
            raise TiffError(f"compression {self.compression}")
        c0, r0 = number % self.columns * self.chunk_width, number // self.columns * self.chunk_height
        values = np.frombuffer(raw, np.dtype(self.dtype).newbyteorder(self.order))
        rows = len(values) // self.chunk_width
        grid = values[: rows * self.chunk_width].reshape(rows, self.chunk_width)
        if self.predictor == 2:
            grid = np.cumsum(grid, axis=1, dtype=np.dtype(self.dtype))
        grid = grid[: self.height - r0, : self.width - c0].astype(np.float32)
        if self.nodata is not None:
            grid = np.where(grid == np.float32(self.nodata), np.float32(np.nan), grid)
        return c0, r0, grid


def unlzw(raw: bytes) -> bytes:
    """LZW as TIFF packs it: codes of 9 to 12 bits, highest bit first, the width growing one code early."""
    table: list[bytes] = []
    out, width, at, bits, last = [], 9, 0, 0, b""
    for byte in raw:
        at, bits = at << 8 | byte, bits + 8
        if bits < width:
            continue
        code = at >> (bits - width) & ((1 << width) - 1)
        bits -= width
        at &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def describe(read) -> Raster:
    """Metadata of a file; ``read(offset, length)`` gives bytes."""
    head = read(0, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
    if order is None:
        raise TiffError("not a TIFF file")
    at = struct.unpack(order + "I", head[4:])[0]
    n = struct.unpack(order + "H", read(at, 2))[0]
    tags: dict[int, tuple] = {}
    text = None
    for k in range(n):
        tag, kind, count, _ = struct.unpack(order + "HHII", entry := read(at + 2 + 12 * k, 12))
        size = TYPE_SIZE.get(kind, 0) * count
        raw = entry[8 : 8 + size] if size <= 4 else read(struct.unpack(order + "I", entry[8:])[0], size)
        if kind == 2:
            text = raw.rstrip(b"\0 ").decode("ascii", "replace") if tag == NODATA else text
        elif kind in TYPE_CODE:
            tags[tag] = struct.unpack(f"{order}{count}{TYPE_CODE[kind]}", raw)

    def one(tag: int, default=None):
        if tag not in tags and default is None:
            raise TiffError(f"tag {tag} is missing")
        return tags[tag][0] if tag in tags else default

    width, height = one(WIDTH), one(HEIGHT)
    tiled = TILE_OFFSETS in tags
    cw, ch = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not 0 < cw * ch <= MAX_CHUNK_SAMPLES:
        raise TiffError("chunk size is out of range")
    sample = SAMPLES.get((one(SAMPLE_FORMAT, 1), one(BITS)))
    if sample is None:
        raise TiffError("sample type is not supported")
    scale, tie = tags.get(PIXEL_SCALE), tags.get(TIEPOINT)
    if scale is None or tie is None:
        raise TiffError("the raster has no place on earth")
    dx, dy = scale[0], scale[1]
    return Raster(order, width, height, cw, ch, tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], sample, one(COMPRESSION, 1), one(PREDICTOR, 1), float(text) if text else None, tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy)


def _reader(path: str):
    def read(offset: int, length: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(offset)
            raw = f.read(length)
        if len(raw) != length:
            raise TiffError("file is cut off")
        return raw

    return read


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").load(path)``: px, py, elev of every pixel, null where there is no data."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "px int, py int, elev float"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("chunks_per_task", "16")))


@dataclass
class _Chunks(InputPartition):
    numbers: list[int]


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[_Chunks]:
        n = len(describe(_reader(self.path)).offsets)
        return [_Chunks(list(range(k, min(n, k + self.per_task)))) for k in range(0, n, self.per_task)]

    def read(self, partition: _Chunks):
        import pyarrow as pa

        read = _reader(self.path)
        raster = describe(read)
        for k in partition.numbers:
            c0, r0, grid = raster.chunk(read(raster.offsets[k], raster.sizes[k]), k)
            rows, cols = np.mgrid[0 : grid.shape[0], 0 : grid.shape[1]]
            elev = pa.array(grid.ravel(), pa.float32(), mask=~np.isfinite(grid.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((cols.ravel() + c0).astype(np.int32)), pa.array((rows.ravel() + r0).astype(np.int32)), elev], names=["px", "py", "elev"])


def write_geotiff(path: str, grid: np.ndarray, west: float, north: float, dx: float, dy: float, nodata: float | None = None, tile: int | None = 16, compress: bool = True) -> None:
    """A little-endian file of one band, in square tiles or, without ``tile``, in strips of 16 rows."""
    grid = np.where(np.isnan(grid), nodata if nodata is not None else 0, grid) if np.issubdtype(grid.dtype, np.floating) else grid
    h, w = grid.shape
    kind = {"i": 2, "u": 1, "f": 3}[grid.dtype.kind]
    chunks = []
    if tile:
        padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), grid.dtype)
        padded[:h, :w] = grid
        chunks = [padded[r : r + tile, c : c + tile].tobytes() for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        chunks = [np.ascontiguousarray(grid[r : r + 16]).tobytes() for r in range(0, h, 16)]
    if compress:
        chunks = [zlib.compress(c) for c in chunks]
    first, last, _ = envelope(w, h, kind, grid.dtype.itemsize * 8, list(map(len, chunks)), west, north, dx, dy, nodata, tile, compress)
    with open(path, "wb") as f:
        f.write(first + b"".join(chunks) + last)


def envelope(w: int, h: int, kind: int, bits: int, sizes: list[int], west: float, north: float, dx: float, dy: float, nodata: float | None, tile: int | None, compress: bool) -> tuple[bytes, bytes, list[int]]:
    """What comes before and after chunks of these sizes, and where each chunk begins."""
    tags: list[tuple[int, int, tuple]] = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (bits,)), (COMPRESSION, 3, (8 if compress else 1,)), (SAMPLE_FORMAT, 3, (kind,)), (PIXEL_SCALE, 12, (dx, dy, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, west, north, 0.0))]
    offsets, at = [], 8
    for size in sizes:
        offsets.append(at)
        at += size
    tags += [(TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILE_OFFSETS, 4, tuple(offsets)), (TILE_BYTES, 4, tuple(sizes))] if tile else [(STRIP_OFFSETS, 4, tuple(offsets)), (ROWS_PER_STRIP, 4, (16,)), (STRIP_BYTES, 4, tuple(sizes))]
    extra, entries = b"", b""
    directory = at + at % 2
    n = len(tags) + (nodata is not None)
    after = directory + 2 + 12 * n + 4
    packed = [(t, k, len(v), struct.pack(f"<{len(v)}{TYPE_CODE[k]}", *v)) for t, k, v in tags]
    if nodata is not None:
        raw = f"{nodata:g}".encode() + b"\0"
        packed.append((NODATA, 2, len(raw), raw))
    for t, k, count, raw in sorted(packed):
        if len(raw) <= 4:
            entries += struct.pack("<HHI", t, k, count) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", t, k, count, after + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    first = b"II*\0" + struct.pack("<I", directory)
    return first, b"\0" * (at % 2) + struct.pack("<H", n) + entries + struct.pack("<I", 0) + extra, offsets
