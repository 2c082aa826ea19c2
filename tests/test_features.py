"""Feature files: layout, round trip, and what a box query reads."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual
from pyspark.sql.types import _parse_datatype_string

from tarn.operators import features, online
from tarn.sources import feature_file as ff

TRAIL = "id long, name string, highway string, coords array<struct<lng:double,lat:double>>"


def trails(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = rng.uniform((9, 46), (13, 49)) if i % 3 else rng.normal((11, 47), 0.01)
        line = at + np.cumsum(rng.normal(0, 0.003, (int(rng.integers(1, 9)), 2)), axis=0)
        rows.append((i if i % 50 else None, f"Weg {i} é" if i % 7 else None, "path" if i % 5 else "", [(float(x), float(y)) for x, y in line]))
    return rows


def test_features_by_their_layout():
    for n in (0, 1, 5):
        xy = np.arange(2 * n, dtype=float).reshape(n, 2) - 0.5
        for props in ((7, "Wég", "path"), (None, None, ""), (-1, "", None)):
            raw = ff.pack_feature(xy, *props)
            assert struct.unpack_from("<I", raw)[0] == len(raw) - 4
            kind, got, found = ff.unpack_feature(raw[4:], list(ff.COLUMNS), ff.LINE)
            assert kind == "LineString" and np.array_equal(got, xy)
            assert found == {k: v for k, v in zip(("id", "name", "highway"), props, strict=True) if v is not None}


def test_headers_by_their_layout():
    raw = ff.pack_header("Wege", (1.0, 2.0, 3.0, 4.5), 77)
    h = ff.Header.read(lambda a, n: raw[a : a + n])
    assert (h.kind, h.columns, h.features, h.fan, h.nodes_at) == (ff.LINE, [("id", ff.LONG), ("name", ff.STRING), ("highway", ff.STRING)], 77, 16, len(raw))
    t = ff.root_table(raw[12:])
    assert t.text(0) == "Wege" and np.frombuffer(t.vector(1, 8)).tolist() == [1.0, 2.0, 3.0, 4.5] and t.vector(30, 1) == b""
    # Eight bytes wide values begin on multiples of eight, counted from the size.
    assert (t.place(8) + 4) % 8 == 0
    with pytest.raises(ValueError, match="FlatGeobuf"):
        ff.Header.read(lambda a, n: b"PMTiles" + b"\0" * 20)


def test_levels():
    assert ff.level_sizes(1) == [1, 1] and ff.level_sizes(16) == [16, 1] and ff.level_sizes(257) == [257, 17, 2, 1]
    assert ff.level_starts([257, 17, 2, 1]) == [20, 3, 1, 0]


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    ff.register(spark)


@pytest.fixture(scope="module")
def rows():
    return [*trails(), (9001, "none", "path", []), (9002, "null", "path", None)]


@pytest.fixture(scope="module")
def path(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('features')}/t.fgb"
    features.write_features(spark.createDataFrame(rows, TRAIL).repartition(5), path)
    assert os.listdir(os.path.dirname(path)) == ["t.fgb"]
    return path


def box_of(coords):
    xs, ys = [p[0] for p in coords], [p[1] for p in coords]
    return min(xs), min(ys), max(xs), max(ys)


def test_round_trip(spark, rows, path):
    got = spark.read.format("flatgeobuf").load(path).collect()
    lines = [r for r in rows if r[3]]
    assert sorted(repr((r.id, r.name, r.highway, r.type, [tuple(p) for p in r.coords], r.min_x, r.min_y, r.max_x, r.max_y)) for r in got) == sorted(repr((*r[:3], "LineString", r[3], *box_of(r[3]))) for r in lines)
    named = features.read_features(spark, path)
    assert {(r.id, r.name, r.highway) for r in named.where("id in (0, 7, 10)").collect()} >= {(7, "Unnamed Trail", "path"), (10, "Weg 10 é", "path")}
    assert named.where("id = 0 and name is not null").count() == sum(1 for r in lines if r[0] is None)


def test_tree_is_sound(path):
    """Every node's box is that of its children, the root's that of the header; leaves lie along the curve."""
    raw = open(path, "rb").read()
    h = ff.Header.read(lambda a, n: raw[a : a + n])
    nodes = np.frombuffer(raw, ff.NODE, sum(h.levels), h.nodes_at)
    start = ff.level_starts(h.levels)
    for level in range(1, len(h.levels)):
        for k in range(h.levels[level]):
            own, a = nodes[start[level] + k], start[level - 1] + k * 16
            below = nodes[a : min(a + 16, start[level - 1] + h.levels[level - 1])]
            assert own["offset"] == a
            assert (own["min_x"], own["min_y"], own["max_x"], own["max_y"]) == (below["min_x"].min(), below["min_y"].min(), below["max_x"].max(), below["max_y"].max())
    leaves = nodes[start[0] :]
    assert leaves["offset"][0] == 0 and (np.diff(leaves["offset"].astype(np.int64)) > 0).all()
    # Neighbours are near: the boxes of the lowest nodes are small together, far below those of an order by chance.
    low = nodes[start[1] : start[1] + h.levels[1]]
    assert ((low["max_x"] - low["min_x"]) * (low["max_y"] - low["min_y"])).mean() < 0.6


def counted(monkeypatch, path, filters, columns=ff.SCHEMA):
    reads = []
    plain = ff.file_reader
    monkeypatch.setattr(ff, "file_reader", lambda p: lambda offset, length: reads.append(length) or plain(p)(offset, length))
    r = ff.Reader(path, _parse_datatype_string(columns))
    assert list(r.pushFilters(filters)) == filters
    parts = r.partitions()
    driver = sum(reads)
    rows = [row for p in parts for b in r.read(p) for row in b.to_pylist()]
    monkeypatch.setattr(ff, "file_reader", plain)
    return rows, driver, sum(reads), len(parts)


def test_a_box_reads_a_share(path, rows, monkeypatch):
    size = os.path.getsize(path)
    every, driver, total, parts = counted(monkeypatch, path, [])
    assert len(every) == sum(bool(r[3]) for r in rows) and driver < size / 20 and parts > 4
    box = [GreaterThanOrEqual(("max_x",), 12.0), LessThanOrEqual(("min_x",), 12.2), GreaterThanOrEqual(("max_y",), 48.0), LessThanOrEqual(("min_y",), 48.2)]
    some, _, read, _ = counted(monkeypatch, path, box)
    want = {r[0] for r in rows if r[3] and (b := box_of(r[3])) and b[2] >= 12.0 and b[0] <= 12.2 and b[3] >= 48.0 and b[1] <= 48.2}
    assert {r["id"] for r in some} == want and len(want) > 2 and read < size / 5 < total
    assert counted(monkeypatch, path, [GreaterThanOrEqual(("min_x",), 99.0)])[0] == []


def test_filters_reach_the_source(spark, path, rows):
    found = online.viewport(features.read_features(spark, path), 46.9, 10.9, 47.0, 11.0)
    want = [r for r in rows if r[3] and (b := box_of(r[3])) and b[2] >= 10.9 and b[0] <= 11.0 and b[3] >= 46.9 and b[1] <= 47.0]
    assert found.count() == len(want) > 5 and found.rdd.getNumPartitions() <= 64
    assert spark.read.format("flatgeobuf").schema("id long").load(path).where("id = 5").count() == 1


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_files(spark, tmp_path, n):
    rows = trails(n, 5)
    features.write_features(spark.createDataFrame(rows, TRAIL), f"{tmp_path}/t.fgb")
    got = spark.read.format("flatgeobuf").load(f"{tmp_path}/t.fgb")
    assert sorted(repr([tuple(p) for p in r.coords]) for r in got.collect()) == sorted(repr(r[3]) for r in rows)


def test_one_place(spark, tmp_path):
    rows = [(k, "x", "path", [(11.0, 47.0)]) for k in range(40)]
    features.write_features(spark.createDataFrame(rows, TRAIL), f"{tmp_path}/t.fgb")
    got = spark.read.format("flatgeobuf").load(f"{tmp_path}/t.fgb").where((F.col("max_x") >= 11.0) & (F.col("min_x") <= 11.0))
    assert sorted(r.id for r in got.collect()) == list(range(40))


def test_a_file_without_a_tree(spark, path, tmp_path):
    """Other writers may leave the tree out: then all features are read in turn."""
    raw = bytearray(open(path, "rb").read())
    h = ff.Header.read(lambda a, n: bytes(raw[a : a + n]))
    place = ff.root_table(bytes(raw[12:])).place(9) + 12
    struct.pack_into("<H", raw, place, 0)
    with open(f"{tmp_path}/flat.fgb", "wb") as f:
        f.write(raw[: h.nodes_at] + raw[h.features_at :])
    got = spark.read.format("flatgeobuf").load(f"{tmp_path}/flat.fgb")
    assert got.where("max_x > 12").count() == spark.read.format("flatgeobuf").load(path).where("max_x > 12").count() and got.count() == h.features
