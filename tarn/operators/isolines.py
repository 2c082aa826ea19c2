"""Isolines of a raster as whole lines: pieces of chunks are joined over chunk borders, rings are told apart.

A crossing lies on an edge of the grid, and at most two cells share an edge, so edges' numbers say which ends meet,
whatever rounding makes of the coordinates.  Chunks give pieces of lines.  Then four neighbouring chunks become one, and
four of those, until one is left: each time the pieces that meet at an inner border are joined.  What travels are the
numbers of pieces and of their ends; the coordinates are put together at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators import kernels
from tarn.operators.terrain import Affine
from tarn.sources.scratch import Scratch

#: Bits of a coordinate in the number of an edge, and of a chunk's column, row and piece in the number of a piece.
EDGE_BITS, PIECE_BITS = 31, 21

PIECE = "piece long, ele double, level int, cx int, cy int, first long, last long, closed boolean, points array<struct<x:double,y:double>>"
OPEN = "ele double, level int, gx int, gy int, first long, last long, closed boolean, done boolean, parts array<struct<piece:long,back:boolean>>"


def edge_number(px: int, py: int, down: int) -> int:
    """The edge from a pixel to the next one across (0) or down (1)."""
    return ((py << EDGE_BITS | px) << 1) | down


def _chained(ends: list[tuple[int, int]]) -> list[tuple[bool, list[tuple[int, bool]]]]:
    """Joins pieces (first end, last end) that share ends: (closed, [(piece, whether it goes backwards)]) for each line.

    Lines begin at an end that no other piece has, in the order of pieces; an end belongs to two pieces at most.
    """
    at: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(k)
        at.setdefault(b, []).append(k)
    used, out = [False] * len(ends), []

    def walk(k: int, back: bool) -> list[tuple[int, bool]]:
        path = []
        while not used[k]:
            used[k] = True
            path.append((k, back))
            end = ends[k][0 if back else 1]
            onward = [m for m in at[end] if not used[m]]
            if not onward:
                break
            k = onward[0]
            back = ends[k][1] == end
        return path

    for k, (a, b) in enumerate(ends):
        if not used[k] and a != b and (len(at[a]) == 1 or len(at[b]) == 1):
            out.append((False, walk(k, len(at[a]) != 1)))
    for k in range(len(ends)):
        if not used[k]:
            out.append((True, walk(k, False)))
    return out


def pieces_of(grid: np.ndarray, level: float, c0: int, r0: int) -> list[tuple[bool, list[int], list[tuple[float, float]]]]:
    """(closed, numbers of the edges it crosses, points) of each line of a level in a chunk; a ring's first point is its last, too."""
    ends, points = [], {}
    for p, q in kernels.crossings(grid, level, edges=True):
        pair = []
        for (c, r, down), xy in (p, q):
            n = edge_number(c0 + c, r0 + r, down)
            points.setdefault(n, (xy[0] + c0, xy[1] + r0))
            pair.append(n)
        ends.append((pair[0], pair[1]))
    out = []
    for closed, path in _chained(ends):
        edges = [ends[k][1 if back else 0] for k, back in path]
        edges.append(ends[path[-1][0]][0 if path[-1][1] else 1])
        out.append((closed, edges, [points[e] for e in edges]))
    return out


def _fragments(dem: DataFrame, step: float, major: float, side: int) -> DataFrame:
    copies = F.array(*(F.struct(F.floor((F.col("px") - i) / side).cast("int").alias("cx"), F.floor((F.col("py") - j) / side).cast("int").alias("cy")) for i in (0, 1) for j in (0, 1)))
    dealt = dem.where("elev is not null and not isnan(elev)").select("px", "py", F.col("elev").cast("double").alias("elev"), F.explode(F.array_distinct(copies)).alias("c")).select("px", "py", "elev", "c.cx", "c.cy").where("cx >= 0 and cy >= 0")

    def run(key, table):
        cx, cy = (int(k.as_py()) for k in key)
        px, py, e = (table.column(c).to_numpy() for c in ("px", "py", "elev"))
        grid = np.full((side + 1, side + 1), np.nan)
        grid[py - cy * side, px - cx * side] = e
        rows: list[tuple] = []
        for level in np.arange(np.ceil(e.min() / step) * step, e.max() + 1e-9, step):
            for closed, edges, points in pieces_of(grid, float(level), cx * side, cy * side):
                piece = (cx << PIECE_BITS | cy) << PIECE_BITS | len(rows)
                rows.append((piece, float(level), int(level % major == 0), cx, cy, edges[0], edges[-1], closed, [{"x": x, "y": y} for x, y in points]))
        schema = pa.schema([("piece", pa.int64()), ("ele", pa.float64()), ("level", pa.int32()), ("cx", pa.int32()), ("cy", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("closed", pa.bool_()), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return dealt.groupBy("cx", "cy").applyInArrow(run, PIECE)


def _joiner(width: int):
    """Joins the open lines of a square of ``width`` pixels; those that do not reach its border are done."""

    def on_border(edge: int, gx: int, gy: int) -> bool:
        down, px, py = edge & 1, edge >> 1 & (1 << EDGE_BITS) - 1, edge >> 1 + EDGE_BITS
        # An edge down lies on a left or right border, an edge across on an upper or lower one.
        return (px if down else py) in ((gx * width, (gx + 1) * width) if down else (gy * width, (gy + 1) * width))

    def run(key, table):
        ele, gx, gy = (k.as_py() for k in key)
        rows = table.to_pylist()
        rows.sort(key=lambda r: r["parts"][0]["piece"])
        out = []
        for closed, path in _chained([(r["first"], r["last"]) for r in rows]):
            parts, ends = [], []
            for k, back in path:
                own = rows[k]["parts"]
                parts += [{"piece": p["piece"], "back": not p["back"]} for p in reversed(own)] if back else own
                ends.append((rows[k]["last"], rows[k]["first"]) if back else (rows[k]["first"], rows[k]["last"]))
            first, last = ends[0][0], ends[-1][1]
            done = closed or not (on_border(first, gx, gy) or on_border(last, gx, gy))
            out.append((ele, rows[0]["level"], gx, gy, first, last, closed, done, parts))
        schema = pa.schema([("ele", pa.float64()), ("level", pa.int32()), ("gx", pa.int32()), ("gy", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("closed", pa.bool_()), ("done", pa.bool_()), ("parts", pa.list_(pa.struct([("piece", pa.int64()), ("back", pa.bool_())])))])
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def isolines(dem: DataFrame, *, step: float = 20.0, major: float = 100.0, side: int = 64) -> DataFrame:
    """line, ele, level (1 for every ``major`` metres, else 0), closed, points (x, y in pixels): the lines of ``dem`` (px, py, elev).

    A line that closes has its first point at its end again; others end at the raster's edge or where it has no data.
    Rounds are as many as it takes to double ``side`` to the raster's size; a round's tables are removed after the next.
    A task of the last rounds holds the numbers of pieces of one height that reach over the middle of the raster, whose
    number grows with its side.
    """
    scratch = Scratch(dem.sparkSession, "isolines")
    made = scratch.keep("pieces", _fragments(dem, step, major, side))
    own = F.array(F.struct(F.col("piece"), F.lit(False).alias("back"))).alias("parts")
    state = made.select("ele", "level", F.col("cx").alias("gx"), F.col("cy").alias("gy"), "first", "last", "closed", F.col("closed").alias("done"), own)
    reach = made.agg(F.max(F.greatest("cx", "cy"))).first()[0] or 0
    finished, width, k = [], side, 0
    while reach >> k:
        k, width = k + 1, width * 2
        finished.append(state.where("done"))
        up = state.where("not done").withColumns({"gx": F.shiftright("gx", 1).cast("int"), "gy": F.shiftright("gy", 1).cast("int")})
        state = scratch.keep(f"round{k}", up.groupBy("ele", "gx", "gy").applyInArrow(_joiner(width), OPEN))
    for f in finished:
        state = state.unionByName(f)
    lines = state.select(F.array_min(F.transform("parts", lambda p: p["piece"])).alias("line"), "ele", "level", "closed", F.posexplode("parts").alias("pos", "p")).select("line", "ele", "level", "closed", "pos", "p.piece", "p.back")
    shapes = lines.join(made.select("piece", "points"), "piece")
    ordered = F.when(F.col("back"), F.reverse("points")).otherwise(F.col("points"))
    # Neighbouring pieces share a point.
    cut = F.when(F.col("pos") > 0, F.slice(ordered, 2, F.size("points"))).otherwise(ordered)
    whole = shapes.groupBy("line", "ele", "level", "closed").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", cut.alias("points")))), lambda s: s["points"])).alias("points"))
    result = scratch.keep("result", whole)
    scratch.drop(*(n for n in tuple(scratch.paths) if n != "result"))
    return result


def placed(lines: DataFrame, affine: Affine) -> DataFrame:
    """``lines`` with coords (lng, lat) in place of points, as exports take them; the grid's corners are centres of pixels."""
    return lines.select("line", "ele", "level", "closed", F.transform("points", lambda p: F.struct(*(c.alias(n) for c, n in zip(geo.pixel_to_model(p["x"], p["y"], affine.west, affine.north, affine.dx, affine.dy), ("lng", "lat"), strict=True)))).alias("coords"))
