"""Operators on Spark: known values, the compile job end to end, sources, streams, and all queries against their SQL."""

from __future__ import annotations

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.functions import text as tx
from tarn.operators import archive, export, kernels, mvt, online, terrain, tiles, tracker, ways
from tarn.plans import compile as compiler
from tarn.plans import registry
from tarn.sources import files, geotiff, pbf, pmtiles, tile_archive
from tarn.streaming import trips

DATA = "/root/testdata/sf0.001"
ORACLES = sorted(set(registry.QUERIES) & set(registry.ORACLE_SQL))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_projection_values(spark):
    r = one(spark, geo.mercator_x(F.lit(180.0)), geo.mercator_y(F.lit(0.0)), geo.mercator_y(F.lit(90.0)), geo.mercator_y(F.lit(85.051128779806592)), geo.simplify_epsilon(F.lit(5)), geo.simplify_epsilon(F.lit(14)))
    assert r[0] == pytest.approx(20037508.342789244, abs=1e-6) and abs(r[1]) < 1e-6 and r[2] == r[3] and abs(r[4] - 2446) < 1 and abs(r[5] - 4.777) < 0.01
    assert tuple(one(spark, geo.lonlat_tile_x(F.lit(11.39), 12), geo.lonlat_tile_y(F.lit(47.26), 12))) == (2177, 1436)
    corners = [(-1.0, 1.0, 0, 0), (1.0, 1.0, 1, 0), (-1.0, -1.0, 0, 1), (1.0, -1.0, 1, 1), (1e9, -1e9, 1, 1)]
    for mx, my, x, y in corners:
        assert tuple(one(spark, geo.tile_x(F.lit(mx), 1), geo.tile_y(F.lit(my), 1))) == (x, y)
    assert tuple(one(spark, geo.degrees_of(F.lit(11390000), 1000, -500))) == (pytest.approx(0.0113899995 * 1000),)


def test_hilbert_values(spark):
    for (z, x, y), expect in {(0, 0, 0): 0, (1, 0, 0): 1, (1, 0, 1): 2, (1, 1, 1): 3, (1, 1, 0): 4, (2, 0, 0): 5, (2, 1, 0): 6, (2, 1, 1): 7}.items():
        assert one(spark, geo.hilbert_id(F.lit(z), F.lit(x), F.lit(y)))[0] == expect
    rows = spark.range(1365).select("id", geo.hilbert_tile("id").alias("t")).select("id", "t.*").orderBy("id").collect()
    last = None
    for r in rows:
        if last and last.z == r.z:
            assert abs(last.x - r.x) + abs(last.y - r.y) == 1
        last = r
    with pytest.raises(Exception, match="outside"):
        one(spark, geo.hilbert_id(F.lit(2), F.lit(4), F.lit(0)))


def test_text_values(spark):
    assert tuple(one(spark, tx.slug(F.lit("  Tirol / Süd! ")), tx.slug(F.lit("--")), tx.elapsed(F.lit(360061)), tx.xml_escape(F.lit("<a&'\">")))) == ("tirol-s-d", "region", "100:01:01", "&lt;a&amp;&apos;&quot;&gt;")
    assert one(spark, tx.pkce_challenge(F.lit("dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk")))[0] == "E9Melhoa2OwvFrEMTJguCHaoeK1t8URWbuGJSstw-cM"
    assert one(spark, tx.fnv1a(F.encode(F.lit("foobar"), "UTF-8")))[0] == "85944171f73967e8"
    assert one(spark, tx.fnv1a(F.encode(F.lit(""), "UTF-8")))[0] == "cbf29ce484222325"
    assert one(spark, tx.job_id(F.lit("A b"), F.lit(36**3)))[0] == "bg_a-b_1000"
    kinds = spark.createDataFrame([(bytearray(b"PMTiles\3"),), (bytearray(b"II*\0abcd"),), (bytearray(b"\0\0\0\x0d\n\tOSMHeader\x18 x"),), (bytearray(b" <!DOCTYPE html>"),), (bytearray(b"zzz"),)], "c binary")
    assert [r[0] for r in kinds.select(tx.payload_kind("c")).collect()] == ["pmtiles", "tiff", "pbf", "html", None]


def test_classification(spark):
    def kinds(*tags):
        df = spark.createDataFrame([(1, [{"k": k, "v": v} for k, v in tags], [1, 2])], "way_id long, tags array<struct<k:string,v:string>>, refs array<long>")
        return [tuple(r) for r in ways.keep(df).select("layer", "class", "sac_scale", "name").collect()]

    assert kinds(("natural", "wood"), ("highway", "track")) == [(0, "track", None, None)]
    assert kinds(("landuse", "meadow"), ("sac_scale", "hiking")) == [(3, "meadow", None, None)]
    assert kinds(("highway", "path"), ("highway", "x"), ("name", "a"), ("name", ""), ("sac_scale", "p"), ("sac_scale", "q")) == [(0, "path", "q", None)]
    assert kinds(("building", "yes")) == []


def test_missing_tags_are_an_error(spark):
    refs = spark.createDataFrame([(1, [1]), (2, [1])], "way_id long, refs array<long>")
    with pytest.raises(Exception, match="no tags for way 2"):
        ways.require_tags(refs, spark.createDataFrame([(1, "x")], "way_id long, tags string")).collect()


def test_pyramid_counts(spark):
    box = spark.createDataFrame([(11.11, 46.77, 11.69, 47.45)], "west double, south double, east double, north double")
    point = spark.createDataFrame([(11.0, 47.0, 11.0, 47.0)], "west double, south double, east double, north double")
    assert tiles.pyramid(point, 8, 8).count() == 1
    edge = spark.createDataFrame([(-10.0, 1.0, 0.0, 5.0)], "west double, south double, east double, north double")
    assert [(r.x, r.y) for r in tiles.pyramid(edge, 1, 1).collect()] == [(0, 0)]
    assert tiles.pyramid(box, 5, 6).count() >= 2


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_nearest_is_the_brute_force_answer(spark, spread):
    """Trails apart, and trails whose boxes lie over each other; some points are far from all of them."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        a = rng.uniform((10, 46), (12, 48))
        p = (a + np.cumsum(rng.normal(0, spread, (4, 2)), axis=0)).round(2)
        rows.append((i, f"t{i}", "path", [(float(x), float(y)) for x, y in p], *map(float, (p[:, 0].min(), p[:, 1].min(), p[:, 0].max(), p[:, 1].max()))))
    trails = spark.createDataFrame(rows, "id long, name string, highway string, coords array<struct<lng:double,lat:double>>, min_x double, min_y double, max_x double, max_y double")
    queries = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.vstack([rng.uniform((9.5, 45.5), (12.5, 48.5), (25, 2)).round(2), [[-70, -40], [11, 80]]]))]

    def place(q, coords):
        best = None
        for a, b in zip(coords, coords[1:], strict=False):
            a, b, p = np.array(a), np.array(b), np.array(q)
            d = b - a
            t = min(1, max(0, (p - a) @ d / (d @ d))) if d @ d else 0
            c = a + t * d
            m = trips.metres(q[0], q[1], c[0], c[1])
            if best is None or m < best[1]:
                best = (np.hypot(*(c - p)), m)
        return best

    def box(q, r):
        return np.hypot(max(r[4] - q[0], q[0] - r[6], 0), max(r[5] - q[1], q[1] - r[7], 0))

    got = {r.point_id: (r.trail_id, r.metres) for r in online.nearest(spark.createDataFrame(queries, "point_id long, lng double, lat double"), trails).collect()}
    for k, x, y in queries:
        near = sorted(rows, key=lambda r, q=(x, y): (box(q, r), r[0]))[:3]
        m, i = min((place((x, y), r[3])[1], r[0]) for r in near)
        assert got[k] == (i, int(m + 0.5))
    exact = {r.point_id: r.trail_id for r in online.nearest(spark.createDataFrame(queries, "point_id long, lng double, lat double"), trails, exact=True).collect()}
    assert all(exact[k] == min((place((x, y), r[3])[0], r[0]) for r in rows)[1] for k, x, y in queries)


def test_shortest_paths(spark):
    edges = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (8, 9, 1.0)]
    got = online.shortest_paths(spark.createDataFrame(edges, "a long, b long, cost double"), spark.createDataFrame([(0, 1), (7, 9)], "source long, node long"))
    assert {(r.source, r.node): r.cost for r in got.collect()} == {(0, 1): 0, (0, 2): 1, (0, 3): 2, (0, 4): 3, (7, 9): 0, (7, 8): 1}


def test_shortest_paths_of_many_edges(spark):
    chain = [(k, k + 1, 1.0) for k in range(80)]
    edges = spark.createDataFrame([*chain, (0, 70, 500.0), (80, 99, None)], "a long, b long, cost double")
    sources = spark.createDataFrame([(0, 0)], "source long, node long")
    assert {r.node: r.cost for r in online.shortest_paths(edges, sources).collect()} == {k: float(k) for k in range(81)}
    with pytest.raises(Exception, match="negative cost"):
        online.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "a long, b long, cost double"), sources).collect()


def fixture(path):
    rng = np.random.default_rng(5)
    nodes = [(k, int(113000000 + rng.integers(0, 900000)), int(472000000 + rng.integers(0, 600000)), [("natural", "peak"), ("name", f"P{k}")] if k % 40 == 0 else []) for k in range(1, 400)]
    made = [(1000 + k, [int(i) for i in rng.integers(1, 440, rng.integers(1, 9))], [(("highway", "waterway", "natural", "landuse", "building")[k % 5], "v")] + ([("name", f"W{k}")] if k % 3 == 0 else [])) for k in range(150)]
    blocks = [pbf.dense_block(nodes[k : k + 100]) for k in range(0, len(nodes), 100)] + [pbf.way_block(made[k : k + 50]) for k in range(0, 150, 50)]
    pbf.write_pbf(path, blocks)
    return nodes, made


@pytest.mark.parametrize(("n", "kinds", "dedup"), [(0, 1, True), (300, 7, True), (300, 7, False), (30_000, 9_000, True), (5_000, 1, True)])
def test_archive_by_tasks_is_that_of_the_driver(spark, tmp_path, n, kinds, dedup):
    rows = [((k * 7919 % (3 * n or 1)) * 5 + 100, f"payload {k * k % kinds}".encode() * (1 + k % kinds % 3)) for k in range(n)] if kinds > 1 else [(k + 77, b"same") for k in range(n)]
    rows = sorted(dict(rows).items())
    args = ((10.0, 46.5, 12.25, 48.0), pmtiles.vector_metadata("x"))
    want = pmtiles.write_archive(f"{tmp_path}/driver", rows, *args, dedup=dedup)
    df = spark.createDataFrame(rows, "tile_id long, payload binary").repartition(4)
    got = archive.write_archive(df, f"{tmp_path}/tasks", *args, dedup=dedup)
    assert got == want and open(f"{tmp_path}/tasks", "rb").read() == open(f"{tmp_path}/driver", "rb").read()
    assert sorted(os.listdir(tmp_path)) == ["driver", "tasks"]
    if n == 300:
        with pytest.raises(ValueError, match="twice"):
            archive.write_archive(df.unionByName(df), f"{tmp_path}/again", *args)


def test_tiles_of_an_archive_or_blank(spark, tmp_path):
    rows = [(k * 3, f"p{k}".encode()) for k in range(20_000)]
    archive.write_archive(spark.createDataFrame(rows, "tile_id long, payload binary"), f"{tmp_path}/a", (0, 0, 1, 1), {})
    assert pmtiles.Header.unpack(pmtiles.file_reader(f"{tmp_path}/a")(0, 127)).leaves[1] > 0
    asked = spark.range(0, 70_000, 7).select(F.col("id"), geo.hilbert_tile("id").alias("t")).select("id", "t.z", "t.x", "t.y", F.lit(1).alias("tile_id"))
    got = {r.id: bytes(r.payload) for r in archive.tiles_or_blank(asked, f"{tmp_path}/a").collect()}
    have = dict(rows)
    assert got == {k: have.get(k, b"") for k in range(0, 70_000, 7)}


def test_elements_of_a_busy_server(spark):
    """A server on this machine that refuses every other request."""
    import http.server
    import json
    import threading
    import urllib.parse

    seen = []

    class Busy(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["data"][0]
            seen.append(query)
            self.send_response(503 if seen.count(query) == 1 else 200)
            self.end_headers()
            if seen.count(query) > 1:
                self.wfile.write(json.dumps({"elements": [{"type": "way", "id": len(query), "tags": {"highway": "path"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Busy)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        boxes = spark.createDataFrame([(47.0, 11.0, 47.5, 11.5), (1.0, 2.0, 3.0, 4.0)], "south double, west double, north double, east double").coalesce(1)
        found = files.fetch_elements(boxes, f"http://127.0.0.1:{server.server_port}/api", wait_s=0.01).collect()
    finally:
        server.shutdown()
    assert sorted(r.id for r in found) == sorted(len(files.hiking_query(*b)) for b in ((47.0, 11.0, 47.5, 11.5), (1.0, 2.0, 3.0, 4.0))) and len(seen) == 4
    assert online.parse_elements(spark.createDataFrame(found)).first().highway == "path"


def test_gpx_document(spark, tmp_path):
    import xml.etree.ElementTree as ET
    from datetime import UTC, datetime

    rows = [(2, "b <&> c", "path", [(11.0, 47.0), (11.1, 47.1)]), (1, "a", "track", [(1.0, 2.0), (3.0, 4.0)])]
    df = spark.createDataFrame(rows, "id long, name string, highway string, coords array<struct<lng:double,lat:double>>")
    export.write_gpx(df, f"{tmp_path}/a.gpx", name="Alps & more", time=datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC))
    ns = {"g": "http://www.topografix.com/GPX/1/1"}
    root = ET.parse(f"{tmp_path}/a.gpx").getroot()
    assert [root.findtext(f"g:metadata/g:{k}", namespaces=ns) for k in ("name", "desc", "time")] == ["Alps & more", "2 trails", "2024-05-06T07:08:09.000Z"]
    assert [t.findtext("g:name", namespaces=ns) for t in root.findall("g:trk", ns)] == ["a", "b <&> c"]


def test_runs_over_the_edges_of_ranges(spark):
    rng = np.random.default_rng(5)
    rows, tile = [], 0
    for _ in range(300):
        tile += int(rng.choice([1, 1, 1, 1, 9]))
        rows.append((tile, int(rng.choice([0, 0, 0, 5])), 5))
    rows += [(2000 + k, 0, 5) for k in range(100)]
    df = spark.createDataFrame(rows, "tile_id long, offset long, length long").repartition(4)
    want = [(e.tile_id, e.offset, e.length, e.run) for e in pmtiles.coalesce_runs(rows)]
    for span in (1, 7, 16, 1 << 20):
        assert sorted(map(tuple, tiles.coalesced(df, span).select("tile_id", "offset", "length", "run_length").collect())) == want
    keyed = spark.createDataFrame([(k, 3, f"k{k % 5 if k % 2 else 0}") for k in range(200)], "tile_id long, length long, key string")
    first = {}
    for k in range(200):
        first.setdefault(k % 5 if k % 2 else 0, k)
    for hot in (1, 30, 1000):
        assert {r.tile_id: r.first_id for r in tiles.first_payloads(keyed, hot_tiles=hot).collect()} == {k: first[k % 5 if k % 2 else 0] for k in range(200)}


def test_compile_job(spark, tmp_path):
    nodes, made = fixture(str(tmp_path / "x.osm.pbf"))
    grid = np.array([[500 + 10 * x + 5 * y for x in range(60)] for y in range(40)], np.float32)
    geotiff.write_geotiff(str(tmp_path / "d.tif"), grid, 11.099861, 47.450139, 0.01, 0.01, nodata=9999)
    job = compiler.Job("job-1", str(tmp_path / "x.osm.pbf"), str(tmp_path / "out"), (11.2, 47.1, 11.5, 47.4), dem_path=str(tmp_path / "d.tif"), max_zoom=8)
    seen = []
    first = compiler.compile_chunk(spark, job, budget_s=0.0, tell=lambda p, phase: seen.append((p, phase)))
    assert first.status == compiler.YIELDED and first.phase == "Pass2Ways" and first.blocks_done == len(nodes)
    assert compiler.query_checkpoint(job).phase == "Pass2Ways"
    done = compiler.compile_chunk(spark, job, tell=lambda p, phase: seen.append((p, phase)))
    assert done.status == compiler.FINISHED and [p for p, _ in seen] == [20, 40, 60, 80, 100]
    header = pmtiles.Header.unpack(pmtiles.file_reader(done.archives[0])(0, 127))
    assert header.tile_type == pmtiles.MVT and header.min_zoom == header.max_zoom == 14
    # The archive holds every kept way and peak of the extract.
    tile_archive.register(spark)
    ids = {}
    for r in spark.read.format("pmtiles").load(done.archives[0]).collect():
        for f in mvt.decode_tile(gzip.decompress(bytes(r.payload))):
            ids.setdefault(f["layer"], set()).add(f["id"])
    known = {n[0] for n in nodes}
    # Ways that shrink to a point are not drawn.
    expect = {w[0] for w in made if w[2][0][0] == "highway" and len({r for r in w[1] if r in known}) >= 2}
    assert ids["highway"] == expect and {i & ~mvt.POI_BIT for i in ids["natural"] if i & mvt.POI_BIT} == {n[0] for n in nodes if n[3]}
    # In one go, over other partitions, the archive is the same to the byte.
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    other = compiler.Job("job-1", job.pbf_path, str(tmp_path / "again"), job.bbox, dem_path=job.dem_path, max_zoom=8)
    again = compiler.compile_chunk(spark, other)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    for a, b in zip(done.archives, again.archives, strict=True):
        assert open(a, "rb").read() == open(b, "rb").read()
    # Other options start afresh; what is wrong with a job is told.
    changed = compiler.Job("job-1", job.pbf_path, job.out_dir, (11.2, 47.1, 11.5, 47.3))
    assert compiler.compile_chunk(spark, changed, budget_s=0.0).phase == "Pass2Ways"
    compiler.purge_job(changed)
    assert not os.path.exists(changed.folder())
    assert compiler.compile_chunk(spark, compiler.Job("bad id", "x", "y", (0, 0, 1, 1))).status == compiler.FATAL
    assert compiler.compile_chunk(spark, compiler.Job("a", "x", str(tmp_path), (5, 0, 1, 1))).reason == "bounding box"


def test_checkpoint_refuses(tmp_path):
    path = str(tmp_path / "c")
    c = compiler.Checkpoint(compiler.VERSION, "j", "s", "Pass1Nodes")
    c.save(path)
    assert compiler.Checkpoint.load(path, "j") == c and compiler.Checkpoint.load(path + "x", "j") is None
    text = open(path).read()
    for bad in (text.replace("version=6", "version=5"), text + "more=1\n", text.replace("phase=Pass1Nodes\n", ""), text.replace("job_id=j", "job_id=k")):
        open(path, "w").write(bad)
        with pytest.raises(compiler.JobError):
            compiler.Checkpoint.load(path, "j")


def test_pbf_source(spark, tmp_path):
    nodes, made = fixture(str(tmp_path / "x.osm.pbf"))
    spark.dataSource.register(pbf.PbfSource)

    def view(name):
        return spark.read.format("osmpbf").option("view", name).option("blocks_per_task", 2).load(str(tmp_path / "x.osm.pbf"))

    assert {(r.node_id, round(r.lon * 1e7), round(r.lat * 1e7)) for r in view("nodes").collect()} == {n[:3] for n in nodes}
    assert {(r.way_id, tuple(r.refs), tuple(map(tuple, r.tags))) for r in view("ways").collect()} == {(w[0], tuple(w[1]), tuple(w[2])) for w in made}
    assert {r.name for r in view("peaks").collect()} == {n[3][1][1] for n in nodes if n[3]}
    assert view("blocks").count() == 8


def test_geotiff_source(spark, tmp_path):
    grid = np.array([[500 + 10 * x + 5 * y for x in range(20)] for y in range(10)], np.float32)
    grid[5, 5] = 9999
    geotiff.write_geotiff(str(tmp_path / "d.tif"), grid, 11.0, 47.5, 0.01, 0.01, nodata=9999)
    spark.dataSource.register(geotiff.GeoTiffSource)
    dem = spark.read.format("geotiff").load(str(tmp_path / "d.tif"))
    assert dem.count() == 200 and dem.where("elev is null").count() == 1
    affine = terrain.Affine(11.0, 47.5, 0.01, 0.01)
    points = spark.createDataFrame([(1, 11.04, 47.475), (2, 11.06, 47.445), (3, 99.0, 0.0)], "point_id long, lon double, lat double")
    got = {r.point_id: r.elev for r in terrain.sampled(points, dem, affine).collect()}
    assert got[1] == pytest.approx(545, abs=1e-3) and got[2] == pytest.approx(585, abs=1e-3) and got[3] is None
    tile = spark.createDataFrame([(12, 2173, 1434)], "z int, x long, y long").select("z", "x", "y")
    made = terrain.rendered(tile, dem, affine, codec="webp", size=64).first()
    pixels = terrain.unwebp(bytes(made.payload))
    assert (pixels == terrain.rgb(terrain.tile_grid(np.where(grid == 9999, np.nan, grid), affine, 12, 2173, 1434, 64))).all()


def test_contours_do_not_depend_on_chunks(spark):
    dem = terrain.synthetic_dem(spark, 40, 30)
    a = sorted(map(tuple, terrain.contours(dem, side=64).collect()))
    assert a == sorted(map(tuple, terrain.contours(dem, side=7).collect())) and a


def test_tracker_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "docs").mkdir()
    (tmp_path / "src" / "a.ts").write_text("// DEBT(D001): one — platforms: web, ios\nlet x = foo(1)\n// RULE-EXEMPT(P1): fine\nfoo(2)\n// BUG(B001): b -- severity: huge -- repro: r\n// DEBT(D1): short\n")
    (tmp_path / "docs" / "a.ts").write_text("// DEBT(D009): no — platforms: web")
    (tmp_path / "x.md").write_text("// DEBT(D008): no — platforms: web")
    lines = tracker.source_tree(spark, str(tmp_path))
    found = tracker.tags(lines)
    assert sorted((r.line, r.kind, r.error) for r in found.collect()) == [(1, "debt", None), (3, "exempt", None), (5, "bug", "invalid severity"), (6, "malformed", "malformed tag")]
    assert [(r.id, r.platform) for r in tracker.missing_mirrors(found).collect()] == [("D001", "ios")]
    rules = tracker.rules_of("rule-id: P1\nforbidden-pattern: `foo\\(`\npaths: src/**\n")
    assert [(r.rule, r.line) for r in tracker.violations(lines, rules).collect()] == [("P1", 2)]
    assert tracker.report(found).first().page == "## debt\n- D001 one [web,ios] src/a.ts:1"


def test_elements(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"version": 0.6, "elements": [{"type": "way", "id": 5, "tags": {"ref": "R1", "highway": "path"}, "geometry": [{"lat": 47.0, "lon": 11.0}, {"lat": 47.1, "lon": 11.2}]}, {"type": "way", "id": 6, "geometry": [{"lat": 1, "lon": 1}]}, {"type": "relation", "id": 7}]}')
    got = online.parse_elements(files.read_elements(spark, str(tmp_path / "r.json"))).collect()
    assert [(r.id, r.name, r.highway, r.min_x, r.max_y) for r in got] == [(5, "R1", "path", 11.0, 47.1)]
    assert files.hiking_query(1, 2, 3, 4).count("(1,2,3,4)") == 4


def test_trip_stream_is_the_batch_answer(spark, tmp_path):
    from tarn.plans import derived

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    fixes = derived.fixes(spark, DATA)
    parts = fixes.withColumn("day", F.ntile(3).over(__import__("pyspark.sql").sql.Window.orderBy("ts", "seq"))).cache()
    source = str(tmp_path / "in")
    for k in (1, 2, 3):
        parts.where(f"day = {k}").drop("day").coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(trips.FIXES).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    got = {}
    query = trips.trip_updates(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: got.update({(r.trip_id, r.segment): (r.metres, r.fixes) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {(r.trip_id, r.segment): r.metres for r in online.trip_distance(fixes).collect()}
    assert set(batch) >= {k for k, v in got.items() if v[1]}
    for k, (m, n) in got.items():
        if n:
            assert m == pytest.approx(batch[k], abs=1e-6)
    assert all(batch[k] == 0 or got[k][0] == pytest.approx(batch[k]) for k in batch)


def test_slices(spark, tmp_path):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    run = lambda options: trips.run_slices(spark, f"{tmp_path}/in/*", "id long", f"{tmp_path}/ck", options, trips.upsert_slices(f"{tmp_path}/out"), files_per_slice=2)
    assert run({"a": 1}) == 3 and run({"a": 1}) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    assert run({"a": 2}) == 3 and spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_policies(spark):
    assert [trips.slice_budget(2000, s) for s in ("nominal", "serious", "critical")] == [(2000, 0), (1000, 25), (0, 100)]
    assert [trips.worker_width(8, s) for s in ("nominal", "fair", "serious", "critical")] == [6, 3, 1, 1] and trips.worker_width(2, "nominal") == 1
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError(5, "io")
        return "ok"

    assert trips.retried(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        trips.retried(lambda: (_ for _ in ()).throw(OSError(2, "gone")), transient=lambda e: e.errno in (5, 28), sleep=waits.append)
    events = spark.createDataFrame([(1, 1, "enqueue"), (1, 2, "yield"), (1, 3, "finish"), (2, 1, "finish"), (3, 1, "enqueue"), (3, 2, "fail"), (3, 3, "acknowledge")], "job_id long, seq long, event string")
    assert {r.job_id: r.state for r in trips.job_states(events).collect()} == {1: "finished", 2: "idle", 3: "idle"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "way_id long, line array<struct<x:double,y:double>>")
    assert tiles.binned(none).count() == 0 and tiles.simplified(none).count() == 0
    assert kernels.bin_line(np.array([[0.0, 0.0], [0.0, 0.0]]), 3) == []
    e = spark.createDataFrame([], "tile_id long, length long, key string")
    assert tiles.coalesced(tiles.offsets(tiles.first_payloads(e))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expect = con.sql(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, map(tuple, expect)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_tiles_are_cut_at_the_production_zoom(spark):
    for name, zooms in {"geo03_tile_binning": {14}, "geo05_mvt_encode": {14}, "geo08_terrain_tiles": set(range(5, 13))}.items():
        assert {r.z for r in registry.QUERIES[name](spark, DATA).select("z").distinct().collect()} == zooms
    assert registry.QUERIES["gen04_grid_traversal"](spark, DATA).agg({"n_tiles": "sum"}).first()[0] > registry.QUERIES["geo03_tile_binning"](spark, DATA).count()


def test_raster_by_tasks_is_that_of_the_driver(spark, tmp_path):
    rng = np.random.default_rng(4)
    grid = rng.uniform(0, 3000, (37, 50)).astype(np.float32)
    grid[rng.random(grid.shape) < 0.1] = np.nan
    grid[16:32, 16:32] = np.nan
    rows = [(x, y, float(grid[y, x])) for y in range(37) for x in range(50) if not (16 <= x < 32 and 16 <= y < 32)]
    dem = spark.createDataFrame(rows, "px int, py int, elev double").repartition(4)
    terrain.write_raster(dem, f"{tmp_path}/tasks.tif", terrain.Affine(11.0, 47.5, 0.01, 0.02), nodata=-5)
    geotiff.write_geotiff(f"{tmp_path}/driver.tif", grid, 11.0, 47.5, 0.01, 0.02, nodata=-5)
    assert open(f"{tmp_path}/tasks.tif", "rb").read() == open(f"{tmp_path}/driver.tif", "rb").read()
    assert sorted(os.listdir(tmp_path)) == ["driver.tif", "tasks.tif"]


def test_places_in_an_order(spark):
    from tarn.operators.ranking import numbered

    rows = [(k, k * 37 % 101, "x") for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, v int, place_at string").repartition(7)
    got = {r.id: r.n for r in numbered(df, F.desc("v"), "id", name="n").collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert numbered(df.limit(0), "id").count() == 0


def test_a_pass_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    """Stopped after every block, and killed inside one: the archive is the same to the byte."""
    fixture(str(tmp_path / "x.osm.pbf"))
    blocks = pbf.block_count(str(tmp_path / "x.osm.pbf"))
    assert blocks >= 3
    plain = compiler.Job("plain", str(tmp_path / "x.osm.pbf"), str(tmp_path / "out"), (11.2, 47.1, 11.5, 47.4), max_zoom=8)
    whole = compiler.compile_chunk(spark, plain)
    job = compiler.Job("sliced", plain.pbf_path, plain.out_dir, plain.bbox, max_zoom=8, slice_blocks=1)
    first = compiler.compile_chunk(spark, job, budget_s=0.0)
    assert first.status == compiler.YIELDED and first.phase == "Pass1Nodes" and compiler.slices(job, "Pass1Nodes")[1:] == ([0], blocks)
    # Killed: the second slice is half there.
    folder = compiler.slices(job, "Pass1Nodes")[0]
    os.makedirs(f"{folder}/first=1/_temporary")
    with open(f"{folder}/first=1/part-0.parquet", "wb") as f:
        f.write(b"torn")
    assert compiler.slices(job, "Pass1Nodes")[1] == [0]
    stops, seen = 0, []
    while (now := compiler.compile_chunk(spark, job, budget_s=0.0, tell=lambda p, phase: seen.append(p))).status == compiler.YIELDED:
        stops += 1
    assert now.status == compiler.FINISHED and stops >= 2 * blocks - 2 and seen == sorted(seen) and seen[-1] == 100
    ours, theirs = (pmtiles.Header.unpack(open(a.archives[0], "rb").read(127)) for a in (now, whole))
    a, b = (open(x.archives[0], "rb").read() for x in (now, whole))
    assert a[ours.data[0] :] == b[theirs.data[0] :] and a[slice(ours.root[0], sum(ours.root))] == b[slice(theirs.root[0], sum(theirs.root))]
    assert not os.path.exists(folder)


def test_node_batches_are_the_decoded_nodes(spark, tmp_path):
    nodes = [(k * 7, 113_000_000 + k * 13, 472_000_000 - k * 5, [("natural", "peak")] if k % 9 == 0 else []) for k in range(300)]
    path = str(tmp_path / "n.osm.pbf")
    pbf.write_pbf(path, [pbf.dense_block(nodes[:200]), pbf.dense_block(nodes[200:], compress=False), pbf.plain_block([(9999, 5, 6)], 1000, 7, -8), pbf.way_block([(1, [7, 14], [("highway", "path")])])])
    spark.dataSource.register(pbf.PbfSource)
    got = sorted(map(tuple, spark.read.format("osmpbf").load(path).select("node_id", "lon", "lat").collect()))
    assert got == sorted([(i, 1e-9 * (100 * x), 1e-9 * (100 * y)) for i, x, y, _ in nodes] + [(9999, 1e-9 * (7 + 5000), 1e-9 * (6000 - 8))])
    some = spark.read.format("osmpbf").option("first_block", 1).option("blocks", 2).load(path)
    assert {r.block for r in some.select("block").distinct().collect()} == {2, 3} and some.count() == 101


def test_extract_by_tasks(spark, tmp_path):
    from tarn.operators.extract import write_extract

    nodes = [(k * 3 % 401, k, -k, [{"k": "natural", "v": "peak"}] if k % 5 == 0 else None) for k in range(400)]
    made = [(k, [k, k + 1], [{"k": "highway", "v": "path"}]) for k in range(50)]
    tags = "tags array<struct<k:string,v:string>>"
    write_extract(f"{tmp_path}/t.osm.pbf", spark.createDataFrame(nodes, f"node_id long, lon_u long, lat_u long, {tags}").repartition(4), spark.createDataFrame(made, f"way_id long, refs array<long>, {tags}"), entities=60)
    ordered = sorted(nodes)
    blocks = [pbf.dense_block([(i, x, y, [(t["k"], t["v"]) for t in own or ()]) for i, x, y, own in ordered[a : a + 60]]) for a in range(0, 400, 60)] + [pbf.way_block([(i, refs, [(t["k"], t["v"]) for t in own]) for i, refs, own in made])]
    pbf.write_pbf(f"{tmp_path}/d.osm.pbf", blocks)
    assert open(f"{tmp_path}/t.osm.pbf", "rb").read() == open(f"{tmp_path}/d.osm.pbf", "rb").read()
