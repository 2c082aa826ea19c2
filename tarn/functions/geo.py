"""Projection, tile, raster and distance arithmetic as Column expressions; everything stays in generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the projection and tile scheme.
EARTH_RADIUS_M = 6_378_137.0
HALF_WORLD_M = math.pi * EARTH_RADIUS_M
MAX_LATITUDE = 85.051128779806592
HAVERSINE_RADIUS_M = 6_371_000.0
TILE_PIXELS = 256
MVT_EXTENT = 4096
MVT_BUFFER = 64
DETAIL_ZOOM = 14


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shl(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n)


def degrees_of(units: Column | str, granularity: int | Column = 100, offset: int | Column = 0) -> Column:
    """Degrees of a fixed-point coordinate: a billionth of (offset + granularity * units)."""
    g = granularity if isinstance(granularity, Column) else F.lit(granularity)
    o = offset if isinstance(offset, Column) else F.lit(offset)
    return (F.coalesce(o, F.lit(0)).cast("long") + F.coalesce(g, F.lit(100)).cast("long") * col(units)).cast("double") * F.lit(1e-9)


def mercator_x(lon: Column | str) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(col(lon))


def mercator_y(lat: Column | str) -> Column:
    """Latitudes beyond the square map are moved to its edge."""
    clamped = F.greatest(F.least(col(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    return F.lit(EARTH_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2))


def tile_extent(z: Column | str) -> Column:
    return F.lit(2 * HALF_WORLD_M) / F.pow(F.lit(2.0), col(z))


def meters_per_pixel(z: Column | str) -> Column:
    return tile_extent(z) / TILE_PIXELS


def simplify_epsilon(z: Column | str) -> Column:
    """Half a pixel."""
    return meters_per_pixel(z) / 2


def _grid(v: Column, z: Column) -> Column:
    last = shl(F.lit(1).cast("long"), z.cast("int")) - 1
    return F.least(F.greatest(F.floor(v).cast("long"), F.lit(0).cast("long")), last)


def tile_x(mx: Column | str, z: Column | str | int) -> Column:
    z = F.lit(z) if isinstance(z, int) else col(z)
    return _grid((col(mx) + HALF_WORLD_M) / tile_extent(z), z)


def tile_y(my: Column | str, z: Column | str | int) -> Column:
    z = F.lit(z) if isinstance(z, int) else col(z)
    return _grid((F.lit(HALF_WORLD_M) - col(my)) / tile_extent(z), z)


def tile_bounds(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """Struct of min_x, min_y, max_x, max_y in metres."""
    e = tile_extent(z)
    left, top = col(x) * e - HALF_WORLD_M, F.lit(HALF_WORLD_M) - col(y) * e
    return F.struct(left.alias("min_x"), (top - e).alias("min_y"), (left + e).alias("max_x"), top.alias("max_y"))


def clip_bounds(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """Tile bounds and the buffer that neighbouring features may reach into."""
    b, pad = tile_bounds(z, x, y), tile_extent(z) * (MVT_BUFFER / MVT_EXTENT)
    return F.struct((b["min_x"] - pad).alias("min_x"), (b["min_y"] - pad).alias("min_y"), (b["max_x"] + pad).alias("max_x"), (b["max_y"] + pad).alias("max_y"))


def lonlat_tile_x(lon: Column | str, z: Column | str | int) -> Column:
    z = F.lit(z) if isinstance(z, int) else col(z)
    return _grid((col(lon) + 180.0) / 360.0 * F.pow(F.lit(2.0), z), z)


def _unit_y(lat: Column) -> Column:
    r = F.radians(lat)
    return (F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2


def lonlat_tile_y(lat: Column | str, z: Column | str | int, clamp: bool = True) -> Column:
    z = F.lit(z) if isinstance(z, int) else col(z)
    lat = F.greatest(F.least(col(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE)) if clamp else col(lat)
    return _grid(_unit_y(lat) * F.pow(F.lit(2.0), z), z)


def tile_west(x: Column | str, z: Column | str) -> Column:
    return col(x) / F.pow(F.lit(2.0), col(z)) * 360.0 - 180.0


def tile_north(y: Column | str, z: Column | str) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - col(y) * 2.0 / F.pow(F.lit(2.0), col(z))))))


def pixel_lon(x: Column | str, z: Column | str, px: Column | str) -> Column:
    """Longitude of the centre of a tile's pixel column."""
    return tile_west(col(x) + (col(px) + 0.5) / TILE_PIXELS, z)


def pixel_lat(y: Column | str, z: Column | str, py: Column | str) -> Column:
    return tile_north(col(y) + (col(py) + 0.5) / TILE_PIXELS, z)


def tile_pixel(lon: Column | str, lat: Column | str, z: int) -> Column:
    """Struct of tile x, y and pixel px, py (0-255) of a position; latitude is not clamped."""
    n = float(1 << z)
    u, v = (col(lon) + 180.0) / 360.0 * n, _unit_y(col(lat)) * n

    def pixel(w: Column) -> Column:
        return F.least(F.greatest(F.floor((w - F.floor(w)) * TILE_PIXELS).cast("int"), F.lit(0)), F.lit(255))

    return F.struct(F.floor(u).cast("long").alias("x"), F.floor(v).cast("long").alias("y"), pixel(u).alias("px"), pixel(v).alias("py"))


def model_to_pixel(lon: Column, lat: Column, origin_x: float, origin_y: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Raster position of a coordinate; pixel values stand for areas, so centres are half a pixel in."""
    return (lon - origin_x) / dx - 0.5, (F.lit(origin_y) - lat) / dy - 0.5


def pixel_to_model(px: Column, py: Column, origin_x: float, origin_y: float, dx: float, dy: float) -> tuple[Column, Column]:
    return F.lit(origin_x) + (px + 0.5) * dx, F.lit(origin_y) - (py + 0.5) * dy


def terrain_code(elevation: Column | str) -> Column:
    """24-bit code of an elevation: tenths of a metre above -10000 m; what is not finite counts as 0 m."""
    e = col(elevation).cast("double")
    bad = e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
    value = F.round((F.when(bad, F.lit(0.0)).otherwise(e) + 10000.0) * 10.0)
    return F.greatest(F.least(value, F.lit(16777215.0)), F.lit(0.0)).cast("int")


def terrain_rgb(elevation: Column | str) -> Column:
    v = terrain_code(elevation)
    return F.struct(F.shiftright(v, 16).bitwiseAND(255).alias("r"), F.shiftright(v, 8).bitwiseAND(255).alias("g"), v.bitwiseAND(255).alias("b"))


def terrain_elevation(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return (col(r) * 65536 + col(g) * 256 + col(b)).cast("double") * 0.1 - 10000.0


def terrarium_elevation(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return col(r).cast("double") * 256 + col(g) + col(b).cast("double") / 256 - 32768.0


def _haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lng2 - lng1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine(lng1, lat1, lng2, lat2) -> Column:
    """Metres between two positions, by atan2."""
    h = _haversine(col(lng1), col(lat1), col(lng2), col(lat2))
    return F.lit(2 * HAVERSINE_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def haversine_asin(lng1, lat1, lng2, lat2) -> Column:
    """The same by asin, as the trip counter spells it."""
    return F.lit(2 * HAVERSINE_RADIUS_M) * F.asin(F.sqrt(_haversine(col(lng1), col(lat1), col(lng2), col(lat2))))


def closest_on_segment(px, py, ax, ay, bx, by) -> Column:
    """Struct x, y: the point of a segment that is nearest in plain coordinates; a segment of no length gives its start."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.struct((ax + t * dx).alias("x"), (ay + t * dy).alias("y"))


def zoom_base(z: Column | str) -> Column:
    """Number of tiles on all smaller zooms."""
    return ((shl(F.lit(1).cast("long"), (col(z) * 2).cast("int")) - 1) / 3).cast("long")


def hilbert_id(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """Number of a tile: smaller zooms first, along the Hilbert curve within one.  Off-grid tiles are an error."""
    z, x, y = col(z).cast("int"), col(x).cast("long"), col(y).cast("long")
    side = shl(F.lit(1).cast("long"), z)

    def walk(s: Column, k: Column) -> Column:
        bit = shl(F.lit(1).cast("long"), k.cast("int"))
        rx, ry = F.when(s["x"].bitwiseAND(bit) > 0, 1).otherwise(0).cast("long"), F.when(s["y"].bitwiseAND(bit) > 0, 1).otherwise(0).cast("long")
        d = s["d"] + bit * bit * (F.lit(3).cast("long") * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - 1 - s["x"]).otherwise(s["x"]), F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        return F.struct(d.alias("d"), F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"))

    steps = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    along = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("d"), x.alias("x"), y.alias("y")), walk, lambda s: s["d"])
    off = (x < 0) | (y < 0) | (x >= side) | (y >= side)
    return F.when(off, F.raise_error(F.lit("tile outside of the grid")).cast("long")).otherwise(zoom_base(z) + along)


def hilbert_tile(tile_id: Column | str, max_zoom: int = 26) -> Column:
    """Struct z, x, y of a tile number."""
    i = col(tile_id).cast("long")
    z = F.aggregate(F.sequence(F.lit(1), F.lit(max_zoom)), F.lit(0), lambda acc, k: acc + F.when(zoom_base(k) <= i, 1).otherwise(0))

    def walk(s: Column, k: Column) -> Column:
        bit = shl(F.lit(1).cast("long"), k.cast("int"))
        rx = F.shiftright(s["d"], 1).bitwiseAND(1)
        ry = s["d"].bitwiseXOR(rx).bitwiseAND(1)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, bit - 1 - s["x"]).otherwise(s["x"]), F.when(flip, bit - 1 - s["y"]).otherwise(s["y"])
        nx, ny = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct(F.shiftright(s["d"], 2).alias("d"), (nx + bit * rx).alias("x"), (ny + bit * ry).alias("y"))

    steps = F.when(z > 0, F.sequence(F.lit(0), z - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct((i - zoom_base(z)).alias("d"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    at = F.aggregate(steps, start, walk)
    return F.struct(z.alias("z"), at["x"].alias("x"), at["y"].alias("y"))


def quantise(m: Column | str, origin: Column | str, scale: Column | str, down: bool = False) -> Column:
    """Position on a tile's 4096 grid, halves away from zero; rows count from the top."""
    v = (col(origin) - col(m)) if down else (col(m) - col(origin))
    return F.round(v * col(scale)).cast("long")


def zigzag(v: Column | str) -> Column:
    v = col(v).cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column | str) -> Column:
    v = col(v).cast("long")
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("long")))


def deltas(values: Column | str) -> Column:
    """First value, then differences."""
    v = col(values)
    return F.transform(v, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(v, i - 1)))


def undeltas(values: Column | str) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.aggregate(col(values), empty, lambda acc, d: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + d)))


def e7(degrees: Column | str) -> Column:
    return F.round(col(degrees) * 1e7).cast("int")


def clip_segment(ax, ay, bx, by, box: Column) -> Column:
    """Struct x0, y0, x1, y1 of the part of a segment in a box, or null; ends that are not clipped stay as they are."""
    ax, ay, bx, by = map(col, (ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    sides = ((-dx, ax - box["min_x"]), (dx, box["max_x"] - ax), (-dy, ay - box["min_y"]), (dy, box["max_y"] - ay))
    enter = F.greatest(F.lit(0.0), *(F.when(p < 0, F.try_divide(q, p)).otherwise(F.lit(0.0)) for p, q in sides))
    leave = F.least(F.lit(1.0), *(F.when(p > 0, F.try_divide(q, p)).otherwise(F.lit(1.0)) for p, q in sides))
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))

    def at(t: Column, a: Column, d: Column, b: Column) -> Column:
        return F.when(t <= 0, a).when(t >= 1, b).otherwise(a + t * d)

    part = F.struct(at(enter, ax, dx, bx).alias("x0"), at(enter, ay, dy, by).alias("y0"), at(leave, ax, dx, bx).alias("x1"), at(leave, ay, dy, by).alias("y1"))
    return F.when(~outside & (enter <= leave), part)
