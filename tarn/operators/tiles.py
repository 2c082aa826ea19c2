"""Tile features, their encoding, and the bookkeeping of archives."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators import kernels, mvt

_SEGMENTS = "array<array<struct<x:double,y:double>>>"


def _lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points of all lines of an Arrow list of points, and each line's offset in them."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offs = col.offsets.to_numpy()
    flat = col.values
    xy = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)], 1)
    return xy[offs[0] : offs[-1]], (offs - offs[0]).astype(np.int64)


def _thinned(xy: np.ndarray, offs: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines without the vertices that Ramer-Douglas-Peucker drops at half a pixel of the zoom."""
    keep = kernels.keep_all(xy, offs, kernels.extent(z) / geo.TILE_PIXELS / 2)
    return xy[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


def _list(values: pa.Array, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values)


def _points(xy: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])


def simplified(lines: DataFrame, z: int = geo.DETAIL_ZOOM, column: str = "line") -> DataFrame:
    """Lines thinned by Ramer-Douglas-Peucker with half a pixel of the zoom."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            xy, offs = _thinned(*_lines(b.column(at)), z)
            yield b.set_column(at, b.schema.field(at).name, _list(_points(xy), offs))

    return lines.mapInArrow(run, lines.schema)


def _cut(xy: np.ndarray, offs: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines thinned for a zoom and cut into its tiles, see `kernels.bin_lines`."""
    return kernels.bin_lines(*_thinned(xy, offs, z), z)


def _inside(zooms: tuple[int, ...], box: tuple[float, float, float, float]) -> Column:
    w, s, e, n = (F.lit(float(v)) for v in box)
    inside = F.lit(False)
    for z in zooms:
        inside = inside | ((F.col("z") == z) & F.col("x").between(geo.lonlat_tile_x(w, z), geo.lonlat_tile_x(e, z)) & F.col("y").between(geo.lonlat_tile_y(n, z), geo.lonlat_tile_y(s, z)))
    return inside


def binned(lines: DataFrame, zooms: tuple[int, ...] = (geo.DETAIL_ZOOM,), box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """z, x, y, way_id, segments of each tile that a line reaches, simplified once for each zoom before it is cut.

    ``box`` (west, south, east, north in degrees) keeps only tiles that meet it; by default none is left out.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids, (xy, offs) = b.column(b.schema.get_field_index("way_id")), _lines(b.column(b.schema.get_field_index("line")))
                for z in zooms:
                    own, cell, row_offs, run_offs, points = _cut(xy, offs, z)
                    segments = _list(_list(_points(points), run_offs), row_offs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), z, np.int32)), pa.array(cell[:, 0]), pa.array(cell[:, 1]), ids.take(pa.array(own)), segments], names=["z", "x", "y", "way_id", "segments"])

    tiles = lines.select("way_id", "line").mapInArrow(run, f"z int, x long, y long, way_id long, segments {_SEGMENTS}")
    return tiles if box is None else tiles.where(_inside(zooms, box))


FEATURE = "z int, x long, y long, is_poi boolean, osm_id long, layer int, class string, sac_scale string, name string, kind int, geometry binary"


def _geometry(z: np.ndarray, x: np.ndarray, y: np.ndarray, rows: np.ndarray, runs: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Types and packed geometries of features on their tiles' grids, all at once; type 0 if nothing is left to draw."""
    own = np.repeat(np.arange(len(x)), np.diff(runs[rows]))
    e = 2 * geo.HALF_WORLD_M / (1 << z)
    scale = (geo.MVT_EXTENT / e)[own]
    gx = kernels.away((points[:, 0] - (x * e - geo.HALF_WORLD_M)[own]) * scale)
    gy = kernels.away(((geo.HALF_WORLD_M - y * e)[own] - points[:, 1]) * scale)
    kinds, ends, raw = mvt.geometries(rows, runs, gx, gy)
    return kinds, pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw.tobytes())])


def way_features(kept: DataFrame, lines: DataFrame, zooms: tuple[int, ...] = (geo.DETAIL_ZOOM,), box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Tile features of classified ways (columns FEATURE): ways join their lines by way, and each piece that a tile gets
    is encoded where the way was cut, so that geometry leaves the task as bytes and is shuffled once, by tile."""
    tags = ("layer", "class", "sac_scale", "name")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                xy, offs = _lines(b.column(b.schema.get_field_index("line")))
                for z in zooms:
                    own, cell, rows, runs, points = _cut(xy, offs, z)
                    zoom = np.full(len(own), z, np.int64)
                    kinds, drawn = _geometry(zoom, cell[:, 0], cell[:, 1], rows, runs, points)
                    carried = [b.column(b.schema.get_field_index(c)).take(pa.array(own)) for c in ("way_id", *tags)]
                    made = pa.RecordBatch.from_arrays([pa.array(zoom, pa.int32()), pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array(np.zeros(len(own), bool)), *carried, pa.array(kinds), drawn], names=["z", "x", "y", "is_poi", "osm_id", *tags, "kind", "geometry"])
                    yield made.filter(pa.array(kinds > 0))

    named = lines.select("way_id", "line").join(kept.select("way_id", F.col("layer").cast("int").alias("layer"), "class", "sac_scale", "name"), "way_id")
    made = named.select("way_id", "line", *tags).mapInArrow(run, FEATURE)
    return made if box is None else made.where(_inside(zooms, box))


def poi_features(pois: DataFrame, z: int = geo.DETAIL_ZOOM) -> DataFrame:
    """Tile features of peaks (columns FEATURE): each in the tile that holds it, in the natural layer."""

    def run(batches):
        for b in batches:
            x, y, mx, my = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("x", "y", "mx", "my"))
            every = np.arange(b.num_rows + 1)
            kinds, drawn = _geometry(np.full(b.num_rows, z), x, y, every, every, np.stack([mx, my], 1))
            yield b.drop_columns(["mx", "my"]).append_column("kind", pa.array(kinds)).append_column("geometry", drawn)

    none = F.lit(None).cast("string")
    placed = pois.select(F.lit(z).alias("z"), geo.tile_x("mx", z).cast("long").alias("x"), geo.tile_y("my", z).cast("long").alias("y"), F.lit(True).alias("is_poi"), F.col("node_id").alias("osm_id"), F.lit(2).alias("layer"), F.lit("peak").alias("class"), none.alias("sac_scale"), F.nullif("name", F.lit("")).alias("name"), "mx", "my")
    return placed.mapInArrow(run, FEATURE)


def encoded(features: DataFrame, compress: bool = True) -> DataFrame:
    """tile_id, z, x, y, payload: one vector tile for each tile with anything left to draw.

    Features come with their geometry as bytes; they are dealt by tile, sorted by tile, kind and id and streamed.  What
    a task holds are the tiles of one batch, and whatever batches one tile fills; all of them are encoded at once, by
    columns.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []

        def made():
            """The tiles of what is held."""
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            where = np.stack([rows.column(c).to_numpy() for c in ("z", "x", "y")], 1).astype(np.int64)
            heads = np.flatnonzero((np.diff(where, axis=0, prepend=-1) != 0).any(1))
            number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(where))))
            drawn = mvt.tiles_of(number, {c: rows.column(c).chunk(0) for c in rows.column_names[3:]})
            full = [k for k, raw in enumerate(drawn) if raw]
            z, x, y = where[heads[full]].T
            payload = [gzip.compress(drawn[k], 6, mtime=0) if compress else drawn[k] for k in full]
            return pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)), pa.array(x), pa.array(y), pa.array(payload, pa.binary())], names=["z", "x", "y", "payload"])

        for b in batches:
            if not b.num_rows:
                continue
            # The last tile of a batch may go on in the next.
            where = np.stack([b.column(k).to_numpy() for k in range(3)], 1).astype(np.int64)
            changes = np.flatnonzero((np.diff(where, axis=0) != 0).any(1)) + 1
            if held:
                last = held[-1].slice(held[-1].num_rows - 1)
                if tuple(last.column(k)[0].as_py() for k in range(3)) != tuple(where[0].tolist()):
                    yield made()
            if len(changes):
                held.append(b.slice(0, int(changes[-1])))
                yield made()
            held.append(b.slice(int(changes[-1]) if len(changes) else 0))
        if held:
            yield made()

    chosen = features.select("z", "x", "y", "is_poi", "osm_id", "layer", "kind", "geometry", "class", "sac_scale", "name")
    dealt = chosen.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "is_poi", "osm_id")
    return dealt.mapInArrow(run, "z int, x long, y long, payload binary").select(geo.hilbert_id("z", "x", "y").alias("tile_id"), "z", "x", "y", "payload")


def ring(tiles: DataFrame, z: int) -> DataFrame:
    """Tiles x, y and those around them within the grid, each once."""
    last = (1 << z) - 1
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = tiles.select("x", "y").distinct().select(F.explode(F.transform(near, lambda d: F.least(F.greatest(F.col("x") + d, F.lit(0)), F.lit(last)))).alias("x"), "y")
    return spread.select("x", F.explode(F.transform(near, lambda d: F.least(F.greatest(F.col("y") + d, F.lit(0)), F.lit(last)))).alias("y")).distinct()


#: A payload of so many tiles is joined by broadcast: of n tiles there are at most n / HOT_TILES such payloads.
HOT_TILES = 1 << 16


def first_payloads(tiles: DataFrame, key: Column | str = "key", hot_tiles: int = HOT_TILES) -> DataFrame:
    """tile_id, length and first_id, the smallest tile of the same payload; grouped by key on the map side first.

    Tiles of a payload that very many have (the empty tile) meet its first tile without a shuffle by key.
    """
    k = F.col(key) if isinstance(key, str) else key
    keyed = tiles.withColumn("__k", k.cast("string"))
    firsts = keyed.groupBy("__k").agg(F.min("tile_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    hot = firsts.where(F.col("n") >= hot_tiles).select("__k", F.col("first_id").alias("hot_id"))
    cold = firsts.where(F.col("n") < hot_tiles).select(F.col("__k").alias("__j"), "first_id")
    marked = keyed.join(F.broadcast(hot), "__k", "left")
    spread = marked.withColumn("__j", F.when(F.col("hot_id").isNull(), F.col("__k")).otherwise(F.concat(F.lit("tile "), F.col("tile_id").cast("string"))))
    return spread.join(cold, "__j", "left").select("tile_id", "length", F.coalesce("hot_id", "first_id").alias("first_id"))


def offsets(firsts: DataFrame, span: int = 1 << 20) -> DataFrame:
    """tile_id, offset, length of tiles in an archive where each payload is stored once, in order of its first tile.

    The running sum is taken within ranges of ``span`` tile ids and the sums of the ranges are summed in turn, so only
    one row a range goes through a single task.
    """
    stored = firsts.where("tile_id = first_id").select("first_id", "length", F.floor(F.col("first_id") / span).alias("part"))
    parts = stored.groupBy("part").agg(F.sum("length").alias("size"))
    begin = parts.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    within = F.coalesce(F.sum("length").over(Window.partitionBy("part").orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stored.withColumn("within", within).join(begin, "part").select("first_id", (F.col("begin") + F.col("within")).cast("long").alias("offset"))
    return firsts.join(placed, "first_id").select("tile_id", "offset", "length")


def coalesced(entries: DataFrame, span: int = 1 << 20) -> DataFrame:
    """tile_id, offset, length, run_length: neighbouring tiles of one payload as one entry.

    Islands are found by difference within ranges of ``span`` ids.  Of a range only the run at its first id and that at
    its last can go on in another, so at most two rows a range are looked at together.
    """
    w = Window.partitionBy("part", "offset", "length").orderBy("tile_id")
    ranged = entries.withColumn("part", F.floor(F.col("tile_id") / span))
    runs = ranged.withColumn("island", F.col("tile_id") - F.row_number().over(w)).groupBy("part", "offset", "length", "island").agg(F.min("tile_id").alias("first"), F.count(F.lit(1)).alias("n"))
    at_edge = (F.col("first") == F.col("part") * span) | (F.col("first") + F.col("n") == (F.col("part") + 1) * span)
    inner = runs.where(~at_edge).select(F.col("first").alias("tile_id"), "offset", "length", F.col("n").alias("run_length"))
    edge = Window.orderBy("first")
    follows = (F.lag(F.col("first") + F.col("n")).over(edge) == F.col("first")) & (F.lag("offset").over(edge) == F.col("offset")) & (F.lag("length").over(edge) == F.col("length"))
    joined = runs.where(at_edge).withColumn("starts", (~F.coalesce(follows, F.lit(False))).cast("int"))
    joined = joined.withColumn("run", F.sum("starts").over(edge.rowsBetween(Window.unboundedPreceding, 0)))
    return inner.unionByName(joined.groupBy("run", "offset", "length").agg(F.min("first").alias("tile_id"), F.sum("n").alias("run_length")).select("tile_id", "offset", "length", "run_length"))


def archive_stats(entries: DataFrame) -> DataFrame:
    zoom = geo.hilbert_tile("tile_id")["z"]
    e = entries.withColumn("zoom", zoom)
    return e.agg(F.sum("run_length").alias("addressed"), F.count(F.lit(1)).alias("entries"), F.countDistinct("offset").alias("contents"), F.min("zoom").alias("min_zoom"), F.max("zoom").alias("max_zoom"), F.coalesce(F.max(F.col("offset") + F.col("length")), F.lit(0)).alias("high_water"))


def value_pools(values: DataFrame) -> DataFrame:
    """group columns, value and value_idx: values numbered by first use within a group.  Input: tile, layer, pos, value."""
    first = values.groupBy("tile", "layer", "value").agg(F.min("pos").alias("pos"))
    return first.select("tile", "layer", "value", (F.row_number().over(Window.partitionBy("tile", "layer").orderBy("pos")) - 1).alias("value_idx"))


def lookup(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """tile_id of each query with offset and length of the entry whose run holds it, or nulls.

    Runs are cut at blocks of 4096 ids and joined by block, an equi-join, then compared within it.
    """
    block = 4096
    e = entries.select(F.col("tile_id").alias("first"), "offset", "length", "run_length")
    e = e.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("run_length") - 1) / block))))
    q = queries.withColumn("block", F.floor(F.col("tile_id") / block))
    hit = (q["block"] == e["block"]) & (q["tile_id"] >= e["first"]) & (q["tile_id"] < e["first"] + e["run_length"])
    return q.join(e, hit, "left").select(q["tile_id"], "offset", "length")


def range_tiles(boxes: DataFrame) -> DataFrame:
    """Box columns with z, x, y of every tile that meets a box (west, south, east, north, z); the far edges do not count."""
    eps = 1e-9
    z = F.col("z")
    x0 = geo.lonlat_tile_x("west", "z")
    x1 = F.greatest(geo.lonlat_tile_x(F.col("east") - eps, "z"), x0)
    y0 = geo.lonlat_tile_y("north", "z")
    y1 = F.greatest(geo.lonlat_tile_y(F.col("south") + eps, "z"), y0)
    return boxes.select("*", F.explode(F.sequence(x0, x1)).alias("x")).withColumn("y", F.explode(F.sequence(y0, y1))).withColumn("z", z)


def pyramid(boxes: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """z, x, y, tile_id of the boxes' tiles on all zooms, each once."""
    zoomed = boxes.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax))))
    return range_tiles(zoomed).select("z", "x", "y").distinct().select("z", "x", "y", geo.hilbert_id("z", "x", "y").alias("tile_id"))
