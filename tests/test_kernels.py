"""Kernels, codecs and formats against known values, properties and independent decoders."""

from __future__ import annotations

import gzip
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.operators import kernels, mvt, terrain
from tarn.sources import files, geotiff, pbf, pmtiles


def line(*points):
    return np.array(points, float)


def test_simplify():
    flat = line(*((x, 0) for x in range(6)))
    assert kernels.simplify(flat, 0.5).tolist() == [[0, 0], [5, 0]]
    corner = line((0, 0), (10, 0), (10, 10))
    assert len(kernels.simplify(corner, 1.0)) == 3
    bump = line((0, 0), (5, 1), (10, 0))
    assert len(kernels.simplify(bump, 2.0)) == 2 and len(kernels.simplify(bump, 0.5)) == 3
    assert len(kernels.simplify(bump, 1.0)) == 2  # strictly more than epsilon
    loop = line((0, 0), (3, 4), (0, 0))
    assert len(kernels.simplify(loop, 4.9)) == 3 and len(kernels.simplify(loop, 5.0)) == 2
    assert len(kernels.simplify(line(*((k, (-1) ** k) for k in range(30000))), 0.1)) == 30000


@given(st.lists(st.tuples(st.floats(-1e4, 1e4), st.floats(-1e4, 1e4)), min_size=1, max_size=40), st.floats(0.01, 1e3))
@settings(max_examples=80, deadline=None)
def test_simplify_keeps_ends_and_order(points, epsilon):
    a = np.array(points, float)
    keep = kernels.keep_flags(a, epsilon)
    assert keep[0] and keep[-1]
    thin = a[keep]
    # Every dropped vertex is near the chord that replaces it.
    at = np.flatnonzero(keep)
    for i, j in zip(at[:-1], at[1:], strict=True):
        d = a[j] - a[i]
        size = np.hypot(*d)
        for p in a[i + 1 : j]:
            far = abs(d[1] * (p[0] - a[i, 0]) - d[0] * (p[1] - a[i, 1])) / size if size else np.hypot(*(p - a[i]))
            assert far <= epsilon * (1 + 1e-6) + 1e-6
    assert len(thin) <= len(a)


BOX = (0.0, 0.0, 10.0, 10.0)


def test_clip():
    assert [r.tolist() for r in kernels.clip(line((-5, 5), (5, 5)), BOX)] == [[[0, 5], [5, 5]]]
    assert len(kernels.clip(line((2, 5), (20, 5), (20, 8), (2, 8)), BOX)) == 2
    assert [r.tolist() for r in kernels.clip(line((-5, -5), (15, 15)), BOX)] == [[[0, 0], [10, 10]]]
    assert kernels.clip(line((-5, 5), (5, -5)), (0.0, 0.0, 10.0, 10.0)) == []  # grazes a corner
    assert kernels.clip(line((20, 20), (30, 30)), BOX) == [] and kernels.clip(line((1, 1)), BOX) == []
    inside = line((1, 1), (2, 3), (4, 4))
    assert [r.tolist() for r in kernels.clip(inside, BOX)] == [inside.tolist()]


@given(st.lists(st.tuples(st.floats(-30, 30), st.floats(-30, 30)), min_size=2, max_size=12))
@settings(max_examples=100, deadline=None)
def test_clip_stays_inside(points):
    for run in kernels.clip(np.array(points, float), BOX):
        assert len(run) >= 2 and (run >= -1e-9).all() and (run <= 10 + 1e-9).all()


def tile_point(z, u, v):
    e = kernels.extent(z)
    return (u * e - kernels.HALF_WORLD_M, kernels.HALF_WORLD_M - v * e)


def test_traversal():
    def crossed(u0, v0, u1, v1, z=10):
        return kernels.crossed(np.array(tile_point(z, u0, v0)), np.array(tile_point(z, u1, v1)), z)

    assert len(crossed(5.2, 5.2, 5.8, 5.6)) == 1 and len(crossed(5.5, 5.5, 5.5, 5.5)) == 1
    assert crossed(3.5, 7.5, 5.5, 7.5).tolist() == [[3, 7], [4, 7], [5, 7]]
    assert crossed(5.5, 7.5, 3.5, 7.5).tolist() == [[3, 7], [4, 7], [5, 7]]
    long = crossed(10.3, 20.1, 110.7, 70.4)
    assert 101 <= len(long) <= 152 and [10, 20] in long.tolist() and [110, 70] in long.tolist()
    steps = np.abs(np.diff(long[np.lexsort((long[:, 1], long[:, 0]))], axis=0)).sum(axis=1)
    assert steps.max() <= 2


def test_way_over_an_edge_gives_two_tiles():
    e = kernels.extent(14)
    way = line((-0.4 * e, -0.5 * e), (0.4 * e, -0.5 * e))
    got = kernels.bin_line(way, 14)
    assert [(x, y) for x, y, _ in got] == [(8191, 8192), (8192, 8192)]
    assert max(got[0][2][0][:, 0]) == pytest.approx(e / 64) and min(got[1][2][0][:, 0]) == pytest.approx(-e / 64)


def test_many_lines_as_one_by_one():
    rng = np.random.default_rng(8)
    e = kernels.extent(9)
    lines = [np.cumsum(rng.normal(0, e * rng.choice([0.01, 0.3, 3]), (rng.integers(1, 12), 2)), axis=0) + rng.uniform(-1e7, 1e7, 2) for _ in range(200)]
    lines += [np.zeros((3, 2)), np.array([[0.0, 0.0], [4 * e, 0.0]]), np.array([[0.0, 3 * e], [0.0, -2 * e]]), np.array([[0.0, 0.0], [3 * e, 3 * e]]), np.array([[-3e7, 1e6], [-1.9e7, 1e6]])]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    own, cell, row_offs, run_offs, points = kernels.bin_lines(np.vstack(lines), offs, 9)
    got = {(int(i), int(x), int(y)): [points[run_offs[r] : run_offs[r + 1]].tolist() for r in range(row_offs[k], row_offs[k + 1])] for k, (i, (x, y)) in enumerate(zip(own, cell, strict=True))}
    assert got == {(i, x, y): [r.tolist() for r in runs] for i, line in enumerate(lines) for x, y, runs in kernels.bin_line(line, 9)}


def test_many_lines_thinned_as_one_by_one():
    rng = np.random.default_rng(8)
    many = [rng.normal(0, 10, (n, 2)).cumsum(axis=0).round(rng.integers(0, 3)) for n in (1, 2, 3, 5, 40, 300, 3, 2, 1)] + [np.zeros((6, 2)), np.array([[0, 0], [5, 5], [0, 0.0]]), np.zeros((0, 2))]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in many])))
    for eps in (0.5, 3.0, 20.0):
        keep = kernels.keep_all(np.vstack(many), offs, eps)
        assert [keep[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == [kernels.keep_flags(x, eps).tolist() if len(x) else [] for x in many]


def test_many_geometries_as_one_by_one():
    rng = np.random.default_rng(9)
    for trial in range(40):
        features = [[rng.integers(-3, 4, (rng.choice([1, 1, 2, 3, 30]), 2)) * int(rng.choice([1, 100, 4000])) for _ in range(rng.integers(0, 4))] for _ in range(trial)]
        runs = [r for f in features for r in f]
        rows = np.concatenate(([0], np.cumsum([len(f) for f in features], dtype=int)))
        cuts = np.concatenate(([0], np.cumsum([len(r) for r in runs], dtype=int)))
        points = np.vstack([np.zeros((0, 2), int), *runs]).astype(np.int64)
        kinds, ends, raw = mvt.geometries(rows, cuts, points[:, 0], points[:, 1])
        for k, f in enumerate(features):
            kind, numbers = mvt.commands(f) if f else (0, [])
            assert (int(kinds[k]), raw[ends[k] : ends[k + 1]].tobytes()) == (kind, mvt.packed(numbers))


def test_rounding():
    assert kernels.away(np.array([0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 0.2])).tolist() == [1, -1, 2, 3, -3, 0, 0]


def test_line_commands():
    segment = np.array([(10, 20), (15, 20), (15, 8)])
    z = mvt.zigzag
    assert mvt.commands([segment]) == (2, [9, z(10), z(20), 18, z(5), z(0), z(0), z(-12)])
    assert mvt.commands([np.array([(100, 200)])]) == (1, [9, 200, 400])
    assert mvt.commands([np.array([(1, 1), (1, 1)]), np.array([(2, 2), (2, 2), (2, 2)])]) == (0, [])


def feature(osm_id, segments, layer=0, kind="path", is_poi=False, **tags):
    return {"osm_id": osm_id, "is_poi": is_poi, "layer": layer, "class": kind, "sac_scale": None, "name": None, "segments": segments, **tags}


def test_tile_round_trip():
    z, x, y = 14, 8703, 5747
    left, low, right, top = kernels.bounds(z, x, y)
    s = 4096 / (right - left)

    def at(px, py):
        return (left + px / s, top - py / s)

    raw = mvt.encode_tile(z, x, y, [
        feature(9, [np.array([at(100, 200)])], layer=2, kind="peak", is_poi=True, name="Top"),
        feature(2, [np.array([at(0, 0), at(10, 0)]), np.array([at(5, 5), at(-64, 9)])], name="N", sac_scale="hiking"),
        feature(1, [np.array([at(1, 1), at(2, 2)])], name="N"),
        feature(3, [np.array([at(7, 7), at(7, 7)])], name="leaks not"),
    ])
    got = mvt.decode_tile(raw)
    assert [f["id"] for f in got] == [1, 2, 9 | mvt.POI_BIT]
    assert got[0]["tags"] == {"class": "path", "name": "N"} and got[1]["tags"] == {"class": "path", "sac_scale": "hiking", "name": "N"}
    assert got[1]["segments"] == [[(0, 0), (10, 0)], [(5, 5), (-64, 9)]] and got[2]["segments"] == [[(100, 200)]] and got[2]["type"] == 1
    assert b"leaks" not in raw
    assert mvt.encode_tile(z, x, y, []) is None and mvt.encode_tile(z, x, y, [feature(3, [np.array([at(7, 7), at(7, 7)])])]) is None


@given(st.lists(st.integers(0, 2**63 - 1), max_size=30))
@settings(max_examples=60, deadline=None)
def test_ref_codec(refs):
    assert mvt.undelta_bytes(mvt.delta_bytes(refs)) == refs


def test_ref_codec_limits():
    assert len(mvt.delta_bytes(list(range(10**6, 10**6 + 1000)))) < 1008
    for bad in (b"\x80", b"\xff" * 11, mvt.varint(mvt.zigzag(-1))):
        with pytest.raises(ValueError):
            mvt.undelta_bytes(bad)


def test_directories():
    entries = [pmtiles.Entry(100, 0, 10, 1), pmtiles.Entry(130, 10, 200, 1), pmtiles.Entry(131, 0, 10, 1)]
    assert pmtiles.pack_directory(entries) == bytes([3, 100, 30, 1, 1, 1, 1, 10, 0xC8, 1, 10, 1, 0, 1])
    assert pmtiles.unpack_directory(pmtiles.pack_directory(entries)) == entries
    runs = pmtiles.coalesce_runs([(100, 0, 5), (101, 0, 5), (102, 0, 5), (103, 5, 7), (105, 0, 5)])
    assert [(e.tile_id, e.run) for e in runs] == [(100, 3), (103, 1), (105, 1)]
    few = [pmtiles.Entry(k * 7, k * 9, 9, 1) for k in range(100)]
    assert pmtiles.build_directories(few)[1] == b""
    many = [pmtiles.Entry(k * 7919, k * 1000003, 1000 + k, 1) for k in range(30000)]
    root, leaves = pmtiles.build_directories(many)
    assert leaves and len(gzip.decompress(root)) <= pmtiles.ROOT_LIMIT


def test_archive(tmp_path):
    path = str(tmp_path / "a.pmtiles")
    tiles = [(k * 5 + (k % 3 == 0), f"payload {k % 900}".encode() * 3) for k in range(20000)]
    header = pmtiles.write_archive(path, tiles, (10.0, 46.5, 12.25, 48.0), pmtiles.vector_metadata("x"))
    read = pmtiles.file_reader(path)
    assert pmtiles.Header.unpack(read(0, 127)) == header and os.listdir(tmp_path) == ["a.pmtiles"]
    assert header.addressed == 20000 and header.contents == 900 and header.bounds_e7 == (100000000, 465000000, 122500000, 480000000)
    found = {}
    for e in pmtiles.read_entries(read)[1]:
        for k in range(e.run):
            found[e.tile_id + k] = read(header.data[0] + e.offset, e.length)
    assert found == dict(tiles)
    for tile, payload in random.Random(1).sample(tiles, 50):
        e = pmtiles.find_entry(read, tile)
        assert read(header.data[0] + e.offset, e.length) == payload
    assert pmtiles.find_entry(read, 3) is None
    with pytest.raises(ValueError):
        pmtiles.write_archive(path, [(2, b"a"), (1, b"b")], (0, 0, 1, 1), {})


def test_raster_codes():
    assert terrain.rgb(np.array([0.0, -10000.0, 8848.6, np.nan])).tolist() == [[1, 134, 160], [0, 0, 0], [2, 224, 70], [1, 134, 160]]
    pixels = np.random.default_rng(1).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    raw = terrain.webp(pixels)
    assert raw[:4] == b"RIFF" and raw[8:16] == b"WEBPVP8L" and int.from_bytes(raw[4:8], "little") == len(raw) - 8
    assert (terrain.unwebp(raw) == pixels).all()
    assert terrain.png(pixels)[:8] == b"\x89PNG\r\n\x1a\n"


def test_bilinear():
    grid = np.array([[500 + 10 * x + 5 * y for x in range(20)] for y in range(10)], float)
    grid[5, 5] = np.nan
    affine = terrain.Affine(11.0, 47.5, 0.01, 0.01)

    def at(x, y):
        return terrain.bilinear(grid, affine, np.array([11.0 + (x + 0.5) * 0.01]), np.array([47.5 - (y + 0.5) * 0.01]))[0]

    assert at(3, 2) == pytest.approx(540) and at(3.5, 2) == pytest.approx(545) and at(3.5, 2.5) == pytest.approx(547.5)
    assert at(5.5, 5) == pytest.approx(585) and np.isnan(at(40, 2))


def test_contours():
    ramp = np.array([[10.0 * x for x in range(5)] for _ in range(4)])
    got = kernels.crossings(ramp, 15.0)
    assert len(got) == 3 and all(p[0] == q[0] == 1.5 for p, q in got)
    assert kernels.crossings(np.full((3, 3), 7.0), 7.0) == [] and len(kernels.crossings(np.array([[1.0, 0.0], [0.0, 1.0]]), 0.5)) == 2


@pytest.mark.parametrize(("kind", "tile", "compress"), [("float32", 16, True), ("int16", None, True), ("uint8", 16, False), ("float64", None, False)])
def test_geotiff(tmp_path, kind, tile, compress):
    path = str(tmp_path / "d.tif")
    grid = (np.arange(60 * 40).reshape(40, 60) % 200).astype(kind)
    geotiff.write_geotiff(path, grid, 11.0, 47.5, 0.01, 0.02, nodata=99, tile=tile, compress=compress)
    read = geotiff._reader(path)
    r = geotiff.describe(read)
    assert (r.width, r.height, r.nodata) == (60, 40, 99.0) and r.bounds() == pytest.approx((11.0, 46.7, 11.6, 47.5))
    got = np.zeros((40, 60), np.float32)
    for k in range(len(r.offsets)):
        c0, r0, part = r.chunk(read(r.offsets[k], r.sizes[k]), k)
        got[r0 : r0 + part.shape[0], c0 : c0 + part.shape[1]] = part
    expect = np.where(grid == 99, np.nan, grid.astype(np.float32))
    assert np.array_equal(got, expect, equal_nan=True)


def test_lzw():
    # Codes 256 (clear), 65, 66, 258 ("AB"), 257 (end), nine bits each.
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 257))
    bits += "0" * (-len(bits) % 8)
    assert geotiff.unlzw(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))) == b"ABAB"


def test_pbf_blocks(tmp_path):
    path = str(tmp_path / "x.osm.pbf")
    blocks = [
        pbf.dense_block([(1000, 113900000, 472700000, []), (1005, 113900050, 472700100, [("natural", "peak"), ("name", "A"), ("name", "B")]), (900, -703450000, -338650000, [])]),
        pbf.plain_block([(7, 11390000, 47270000)], granularity=1000, lon_offset=-500, lat_offset=500),
        pbf.way_block([(500, [1000, 1005, 900], [("highway", "path")]), (501, [1, 2], [("building", "yes")]), (502, [900, 1005], [("waterway", "stream")]), (503, [1, 2], [("sac_scale", "hiking")])]),
        pbf.way_block([(600, [1, 2], [("created_by", "x")])]),
    ]
    pbf.write_pbf(path, blocks)
    raw = open(path, "rb").read()
    frames = list(pbf.scan_blocks(lambda a, n: raw[a : a + n], len(raw)))
    assert [f.kind for f in frames] == ["OSMHeader"] + ["OSMData"] * 4
    p = [pbf.Primitive(pbf.inflate(raw[f.offset : f.offset + f.length])) for f in frames[1:]]
    assert [b.relevant() for b in p] == [True, False, True, False] and p[0].has_peaks()
    nodes = list(p[0].nodes())
    assert nodes[0][:3] == (1000, pytest.approx(11.39), pytest.approx(47.27)) and nodes[2][:3] == (900, pytest.approx(-70.345), pytest.approx(-33.865))
    assert nodes[1][3] == [("natural", "peak"), ("name", "A"), ("name", "B")]
    assert list(p[1].nodes())[0][1:3] == (pytest.approx(1e-9 * (1000 * 11390000 - 500)), pytest.approx(1e-9 * (1000 * 47270000 + 500)))
    assert [(w[0], w[1]) for w in p[2].ways()][:2] == [(500, [1000, 1005, 900]), (501, [1, 2])]
    for bad in (raw[:-3], b"\0\xff\xff\xff", raw + b"\0\0"):
        with pytest.raises(ValueError):
            list(pbf.scan_blocks(lambda a, n, bad=bad: bad[a : a + n], len(bad)))
    with pytest.raises(pbf.PbfError):
        pbf.inflate(pbf.field(2, 10) + pbf.field(3, __import__("zlib").compress(b"x" * 1000)))
    with pytest.raises(pbf.PbfError):
        pbf.inflate(pbf.field(4, b"lzma"))
    assert files.payload_kind(raw[:64]) == "pbf"


def test_copies_and_ranges(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    open(a, "wb").write(b"PMTiles" + os.urandom(3000))
    assert files.copy_verified(a, b, block=1000) == 3007 and open(a, "rb").read() == open(b, "rb").read()
    assert files.read_range(a, 3000, 100) == open(a, "rb").read()[3000:] and files.read_range(a, 9999, 5) == b""
    r = files.Registry()
    r.bind("map", a)
    assert r.match("map/1/2") == a and r.read("map", 0, 7) == b"PMTiles" and (r.reads, r.total_bytes) == (1, 7)
    with pytest.raises(KeyError):
        r.match("mapx")
    open(a, "wb").write(b"<!DOCTYPE html>")
    with pytest.raises(files.PayloadError):
        r.bind("web", a)
    assert [files.plan_resume(0, 5), files.plan_resume(5, 5), files.plan_resume(3, None), files.plan_resume(9, 5)] == [("fresh", None), ("complete", None), ("resume", "bytes=3-"), ("fresh", None)]


def test_download_goes_on(tmp_path):
    body = b"PMTiles" + bytes(range(200))

    class Response:
        def __init__(self, raw, status):
            self.raw, self.status = raw, status

        def read(self, n=-1):
            out, self.raw = self.raw[:n], self.raw[n:]
            return out

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    path = str(tmp_path / "m")
    open(path + ".part", "wb").write(body[:50])

    def ranged(request):
        at = int(request.headers["Range"].removeprefix("bytes=").rstrip("-"))
        return Response(body[at:], 206)

    assert files.download("http://x/m", path, "pmtiles", ranged) == len(body) and open(path, "rb").read() == body
    open(path + ".part", "wb").write(b"old")
    assert files.download("http://x/m", path, "pmtiles", lambda r: Response(body, 200)) == len(body) and open(path, "rb").read() == body
    with pytest.raises(files.PayloadError):
        files.download("http://x/h", str(tmp_path / "h"), "tiff", lambda r: Response(b"<html>", 200))


def test_tiles_by_columns_are_those_by_features():
    rng = np.random.default_rng(8)
    words = [None, "", "path", "a", "é", "track", *(f"n{k}" for k in range(200))]
    tiles = []
    for n in (1, 40, 7, 300):
        features = []
        for _ in range(n):
            kind = int(rng.integers(1, 3))
            features.append({"is_poi": bool(rng.random() < 0.3), "osm_id": int(rng.choice([rng.integers(0, 200), rng.integers(0, 1 << 60)])), "layer": int(rng.integers(0, 4)), "kind": kind, "geometry": rng.bytes(int(rng.integers(0, 300))), **{c: words[int(rng.integers(0, 6 if c == "sac_scale" else len(words)))] for c in ("class", "sac_scale", "name")}})
        tiles.append(sorted(features, key=lambda f: (f["is_poi"], f["osm_id"])))
    number = np.repeat(np.arange(len(tiles)), [len(t) for t in tiles])
    every = [f for t in tiles for f in t]
    kinds = {"is_poi": pa.bool_(), "osm_id": pa.int64(), "layer": pa.int32(), "kind": pa.int32(), "geometry": pa.binary(), "class": pa.string(), "sac_scale": pa.string(), "name": pa.string()}
    columns = {c: pa.array([f[c] for f in every], t) for c, t in kinds.items()}
    assert mvt.tiles_of(number, columns) == [mvt.assemble_tile(t) for t in tiles]
    shifted = {c: pa.concat_arrays([v.slice(0, 1), v]).slice(1) for c, v in columns.items()}
    assert mvt.tiles_of(number, shifted) == [mvt.assemble_tile(t) for t in tiles]
    assert mvt.tiles_of(np.zeros(0, np.int64), {c: v.slice(0, 0) for c, v in columns.items()}) == []
