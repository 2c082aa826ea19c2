"""Isolines put together over chunks against one chunk, and against counts of ends."""

from __future__ import annotations

import numpy as np
import pytest

from tarn.operators import isolines, kernels
from tarn.operators.terrain import Affine


def surface(seed, h=41, w=53, gaps=True):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    grid = 500 + sum(a * np.sin(x / b + c) * np.cos(y / d) for a, b, c, d in rng.uniform((20, 3, 0, 3), (60, 9, 6, 9), (4, 4))) + 0.37
    if gaps:
        grid[rng.random(grid.shape) < 0.01] = np.nan
    return grid


def table(spark, grid):
    rows = [(int(x), int(y), float(grid[y, x])) for y in range(grid.shape[0]) for x in range(grid.shape[1]) if np.isfinite(grid[y, x])]
    return spark.createDataFrame(rows, "px int, py int, elev double").repartition(4)


def length(points):
    p = np.array(points)
    return float(np.hypot(*np.diff(p, axis=0).T).sum())


def key(ele, closed, points):
    """A line, whatever its direction and, of a ring, its first point."""
    p = [(round(x, 9), round(y, 9)) for x, y in points]
    if closed:
        p = p[:-1]
        k = p.index(min(p))
        p = p[k:] + p[:k]
        return ele, True, min(tuple(p), (p[0], *reversed(p[1:])))
    return ele, False, min(tuple(p), tuple(reversed(p)))


@pytest.mark.parametrize(("seed", "side"), [(1, 8), (2, 16), (1, 64)])
def test_lines_are_whole(spark, seed, side):
    grid = surface(seed)
    got = isolines.isolines(table(spark, grid), side=side).collect()
    want = [(float(e), closed, points) for e in np.arange(300, 800, 20) for closed, _, points in isolines.pieces_of(grid, float(e), 0, 0)]
    assert sorted(key(r.ele, r.closed, [(p.x, p.y) for p in r.points]) for r in got) == sorted(key(*w) for w in want)
    assert len({r.line for r in got}) == len(got) and any(r.closed for r in got) and any(not r.closed for r in got)
    for r in got:
        points = [(p.x, p.y) for p in r.points]
        assert r.level == (r.ele % 100 == 0) and (points[0] == points[-1]) == r.closed and len(points) >= 2
    # No segment is lost: all lines are as long as all loose segments.
    loose = sum(np.hypot(p[0] - q[0], p[1] - q[1]) for e in np.arange(300, 800, 20) for p, q in kernels.crossings(grid, float(e)))
    assert sum(length([(p.x, p.y) for p in r.points]) for r in got) == pytest.approx(loose)


def test_levels_that_meet_corners(spark):
    """Heights that are levels themselves: edges, not points, say what meets."""
    grid = np.array([[100.0 + 20 * ((x // 3 + y // 3) % 3) for x in range(24)] for y in range(24)])
    got = isolines.isolines(table(spark, grid), side=8).collect()
    want = [(float(e), closed, points) for e in (100, 120, 140) for closed, _, points in isolines.pieces_of(grid, float(e), 0, 0)]
    assert sorted((r.ele, r.closed, round(length([(p.x, p.y) for p in r.points]), 6)) for r in got) == sorted((e, c, round(length(p), 6)) for e, c, p in want)


def test_nothing_to_draw(spark):
    flat = table(spark, np.full((20, 20), 510.0))
    assert isolines.isolines(flat, side=8).collect() == [] and isolines.isolines(flat.limit(0)).collect() == []


def test_coordinates(spark):
    grid = np.array([[0.0, 40.0], [0.0, 40.0]])
    (line,) = [r for r in isolines.placed(isolines.isolines(table(spark, grid)), Affine(10.0, 50.0, 0.5, 0.25)).collect() if r.ele == 20]
    assert sorted((p.lng, p.lat) for p in line.coords) == [(10.5, 49.625), (10.5, 49.875)]
