"""Queries for joins, tiles, archives and aggregations (inventory groups JON, AGG, SET, GEN, GEO, SRT), with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators import archive, export, terrain, tiles, ways
from tarn.operators.tile_store import TileStore
from tarn.plans import derived as d
from tarn.plans.scalar_queries import HILBERT, W, _tx, _ty, r3
from tarn.sources.files import checkpoint_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            text = d.with_tables(sql, *tables)
            ORACLE_SQL[name] = text.replace("with ", "with recursive ", 1) if recursive else text
        return f

    return add


def _classified(spark, sf) -> DataFrame:
    return ways.keep(d.ways(spark, sf))


@query("jon01_way_geometry", "select way_id, count(*) n_vertices, arg_min(node_id, pos) first_node, arg_max(node_id, pos) last_node from line group by 1 having count(*) >= 2", "line")
def _(spark, sf):
    v = ways.vertices(d.refs(spark, sf), d.coordinates(spark, sf).select("node_id"))
    return v.groupBy("way_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.min_by("node_id", "pos").alias("first_node"), F.max_by("node_id", "pos").alias("last_node")).where("n_vertices >= 2")


@query("jon02_way_tags", "select way_id, n, k from sizes join (select way_id, count(*) k from tags group by 1) using (way_id)", "sizes", "tags")
def _(spark, sf):
    found = ways.require_tags(d.refs(spark, sf), d.tags(spark, sf))
    return found.select("way_id", F.size("refs").cast("long").alias("n"), F.size("tags").cast("long").alias("k"))


_SEGMENTS = f", g as (select way_id, pos, mx, my, {_tx('14')} tx, {_ty('14')} ty, lead(mx) over w bx, lead(my) over w by_ from line window w as (partition by way_id order by pos)), s as (select * from g where bx is not null)"


def _segments(spark, sf) -> DataFrame:
    v = ways.vertices(d.refs(spark, sf), d.coordinates(spark, sf).select("node_id", "mx", "my"))
    w = Window.partitionBy("way_id").orderBy("pos")
    return v.withColumns({"bx": F.lead("mx").over(w), "by_": F.lead("my").over(w)}).where("bx is not null")


_E = 2 * W / 16384
_BOX = {"min_x": f"(tx * {_E} - {W} - {_E / 64})", "min_y": f"({W} - (ty + 1) * {_E} - {_E / 64})", "max_x": f"((tx + 1) * {_E} - {W} + {_E / 64})", "max_y": f"({W} - ty * {_E} + {_E / 64})"}


def _clip_sql() -> str:
    sides = [("(mx - bx)", f"(mx - {_BOX['min_x']})"), ("(bx - mx)", f"({_BOX['max_x']} - mx)"), ("(my - by_)", f"(my - {_BOX['min_y']})"), ("(by_ - my)", f"({_BOX['max_y']} - my)")]
    enter = ", ".join(f"case when {p} < 0 then {q} / {p} else 0 end" for p, q in sides)
    leave = ", ".join(f"case when {p} > 0 then {q} / {p} else 1 end" for p, q in sides)
    return f"{_SEGMENTS}, t as (select *, greatest(0, {enter}) t0, least(1, {leave}) t1 from s) select way_id, pos, round(case when t0 <= 0 then mx else mx + t0 * (bx - mx) end, 3) x0, round(case when t0 <= 0 then my else my + t0 * (by_ - my) end, 3) y0, round(case when t1 >= 1 then bx else mx + t1 * (bx - mx) end, 3) x1, round(case when t1 >= 1 then by_ else my + t1 * (by_ - my) end, 3) y1 from t where t0 <= t1"


@query("geo02_segment_clip", _clip_sql(), "line")
def _(spark, sf):
    s = _segments(spark, sf).withColumn("box", geo.clip_bounds(F.lit(14), geo.tile_x("mx", 14), geo.tile_y("my", 14)))
    c = s.withColumn("c", geo.clip_segment("mx", "my", "bx", "by_", F.col("box"))).where("c is not null")
    return c.select("way_id", "pos", r3("c.x0", "x0"), r3("c.y0", "y0"), r3("c.x1", "x1"), r3("c.y1", "y1"))


@query("jon04_peak_tiles", f"select node_id osm_id, {_tx('14')} tx, {_ty('14')} ty, 'peak' class, nullif(name, '') as name from pois", "pois")
def _(spark, sf):
    return tiles.poi_features(d.pois(spark, sf)).select("osm_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "class", "name")


@query("jon05_dictionary", ", strings as (select v, row_number() over (order by v) - 1 i from (select distinct v from tags)) select way_id, tags.i pos, strings.i value_idx from tags join strings using (v)", "tags")
def _(spark, sf):
    pairs = d.tags(spark, sf).select("way_id", F.posexplode("tags").alias("p", "t")).select("way_id", "p", "t.k", "t.v")
    order = {"sac_scale": 3, "name": 5}
    pos = F.when((F.col("k") == "natural") & (F.col("v") == "wood"), 2).when((F.col("k") == "sac_scale") & (F.col("v") == "alpine_hiking"), 4).when((F.col("k") == "name") & (F.col("v") == ""), 6)
    for k, i in order.items():
        pos = pos.when(F.col("k") == k, i)
    strings = placed(pairs.select("v").distinct(), "v", F.substring("v", 1, 6)).select("v", (F.col("place") - 1).alias("value_idx"))
    return pairs.join(strings, "v").select("way_id", pos.otherwise(1).alias("pos"), F.col("value_idx").cast("long"))


_SAMPLE = f""", p as (select node_id point_id, (lon - {d.DEM_WEST}::double) / {d.DEM_STEP}::double - 0.5 u, ({d.DEM_NORTH}::double - lat) / {d.DEM_STEP}::double - 0.5 v from coordinates),
q as (select point_id, floor(u)::integer + i px, floor(v)::integer + j py, (case when i = 1 then u - floor(u) else 1 - (u - floor(u)) end) * (case when j = 1 then v - floor(v) else 1 - (v - floor(v)) end) w from p, range(2) a(i), range(2) b(j))"""


@query("jon06_dem_bilinear", f"{_SAMPLE}, m as (select point_id, round(sum(w * elev) / sum(w), 6) elev from q join dem using (px, py) where w > 0 and elev is not null group by 1) select point_id, elev from p left join m using (point_id)", "coordinates", "dem")
def _(spark, sf):
    points = d.coordinates(spark, sf).select(F.col("node_id").alias("point_id"), "lon", "lat")
    affine = terrain.Affine(d.DEM_WEST, d.DEM_NORTH, d.DEM_STEP, d.DEM_STEP)
    return terrain.sampled(points, d.dem(spark, sf), affine).select("point_id", F.round("elev", 6).alias("elev"))


@query("agg01_features_per_tile", f", f as (select layer, {_tx('14')} tx, {_ty('14')} ty, way_id from line join kinds using (way_id) where n >= 2) select layer, tx, ty, count(*) vertices, count(distinct way_id) ways from f group by 1, 2, 3", "line", "kinds")
def _(spark, sf):
    return features_per_tile(spark, sf)


def features_per_tile(spark, sf) -> DataFrame:
    v = ways.vertices(d.refs(spark, sf), d.coordinates(spark, sf).select("node_id", geo.tile_x("mx", 14).alias("tx"), geo.tile_y("my", 14).alias("ty")))
    per_way = v.groupBy("way_id", "tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    long_enough = v.groupBy("way_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("way_id")
    kinds = ways.classify(d.tags(spark, sf)).select("way_id", "layer").join(long_enough, "way_id", "left_semi")
    return per_way.join(kinds, "way_id").groupBy("layer", "tx", "ty").agg(F.sum("n").alias("vertices"), F.count(F.lit(1)).alias("ways"))


@query("agg02_features_per_layer", "select layer, count(*) n, count(sac_scale) graded, count(name) named from kept group by 1", "kept")
def _(spark, sf):
    return _classified(spark, sf).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count("sac_scale").alias("graded"), F.count("name").alias("named"))


@query("agg03_value_pools", ", v as (select way_id // 50 tile, layer, way_id * 10 pos, class v from kinds union all select way_id // 50, layer, way_id * 10 + 1, sac_scale from kinds where sac_scale is not null union all select way_id // 50, layer, way_id * 10 + 2, name from kinds where name is not null), f as (select tile, layer, v, min(pos) p from v group by all) select tile, layer, v as value, row_number() over (partition by tile, layer order by p) - 1 value_idx from f", "kinds")
def _(spark, sf):
    k = ways.classify(d.tags(spark, sf))
    values = F.array(*(F.struct((F.col("way_id") * 10 + i).alias("pos"), F.col(c).alias("value")) for i, c in enumerate(("class", "sac_scale", "name"))))
    v = k.select(F.floor(F.col("way_id") / 50).alias("tile"), "layer", F.explode(F.filter(values, lambda x: x["value"].isNotNull())).alias("v")).select("tile", "layer", "v.pos", "v.value")
    return tiles.value_pools(v).withColumn("value_idx", F.col("value_idx").cast("long"))


#: Tiles with payloads that repeat, made of orders: the payload is the day of the order.
_PAY = ", p as (select o_orderkey::bigint tile_id, o_orderpriority || (o_orderkey // 3 % 50)::varchar key, length(o_orderpriority || (o_orderkey // 3 % 50)::varchar)::bigint length from orders where o_orderkey % 7 <> 0), f as (select *, min(tile_id) over (partition by key) first_id from p)"
_OFF = _PAY + ", s as (select first_id, length, coalesce(sum(length) over (order by first_id rows between unbounded preceding and 1 preceding), 0)::bigint o from f where tile_id = first_id), e as (select f.tile_id, s.o as offs, f.length from f join s using (first_id))"
_RUN = _OFF + ", i as (select *, tile_id - row_number() over (partition by offs, length order by tile_id) g from e), c as (select min(tile_id) tile_id, offs, length, count(*) run_length from i group by offs, length, g)"


def _payloads(spark, sf) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    key = F.concat("o_orderpriority", (F.floor(k / 3) % 50).cast("string"))
    return d.read(spark, sf, "orders").where(k % 7 != 0).select(k.alias("tile_id"), key.alias("key"), F.length(key).cast("long").alias("length"))


def _entries(spark, sf) -> DataFrame:
    return tiles.offsets(tiles.first_payloads(_payloads(spark, sf)), span=512)


@query("agg04_payload_dedup", f"{_PAY} select tile_id, length, first_id from f".removeprefix(", ").replace("p as", "with p as", 1))
def _(spark, sf):
    return tiles.first_payloads(_payloads(spark, sf))


@query("agg05_run_coalesce", f"{_RUN} select tile_id, offs as offset_, length, run_length from c".removeprefix(", ").replace("p as", "with p as", 1))
def _(spark, sf):
    return tiles.coalesced(_entries(spark, sf), span=512).select("tile_id", F.col("offset").alias("offset_"), "length", "run_length")


@query("agg06_archive_offsets", f"{_OFF} select tile_id, offs as offset_, length from e".removeprefix(", ").replace("p as", "with p as", 1))
def _(spark, sf):
    return _entries(spark, sf).select("tile_id", F.col("offset").alias("offset_"), "length")


@query("agg07_archive_stats", f"{_RUN} select sum(run_length)::bigint addressed, count(*) entries, count(distinct offs) contents, max(offs + length) high_water from c".removeprefix(", ").replace("p as", "with p as", 1))
def _(spark, sf):
    return tiles.archive_stats(tiles.coalesced(_entries(spark, sf), span=512)).select("addressed", "entries", "contents", "high_water")


@query("agg08_high_water", f"{_OFF} select max(offs + length) high_water from e".removeprefix(", ").replace("p as", "with p as", 1))
def _(spark, sf):
    return _entries(spark, sf).agg(F.max(F.col("offset") + F.col("length")).alias("high_water"))


@query("jon12_tile_payload", f"{_PAY} select tile_id, key, first_id, tile_id = first_id stored from f".removeprefix(", ").replace("p as", "with p as", 1))
def _(spark, sf):
    p = _payloads(spark, sf)
    firsts = p.groupBy("key").agg(F.min("tile_id").alias("first_id"))
    return p.join(firsts, "key").select("tile_id", "key", "first_id", (F.col("tile_id") == F.col("first_id")).alias("stored"))


@query("jon13_tile_lookup", f"{_RUN}, q as (select p_partkey::bigint tile_id from part) select q.tile_id, c.offs as offset_, c.length from q left join c on q.tile_id >= c.tile_id and q.tile_id < c.tile_id + c.run_length".removeprefix(", ").replace("p as", "with p as", 1))
def _(spark, sf):
    q = d.read(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("tile_id"))
    return tiles.lookup(q, tiles.coalesced(_entries(spark, sf), span=512)).select("tile_id", F.col("offset").alias("offset_"), "length")


@query("agg09_window_range", "select px // 16 col, py // 16 row, min(elev) low, max(elev) high from dem group by 1, 2", "dem")
def _(spark, sf):
    return terrain.windows(d.dem(spark, sf))


@query("agg10_weighted_mean", f"{_SAMPLE} select point_id, count(*) n, round(sum(w), 3) weight from q join dem using (px, py) where w > 0 and elev is not null group by 1", "coordinates", "dem")
def _(spark, sf):
    points = d.coordinates(spark, sf).select(F.col("node_id").alias("point_id"), "lon", "lat")
    u, v = geo.model_to_pixel(F.col("lon"), F.col("lat"), d.DEM_WEST, d.DEM_NORTH, d.DEM_STEP, d.DEM_STEP)
    p = points.select("point_id", u.alias("u"), v.alias("v"))
    four = F.array(*(F.struct((F.floor("u").cast("int") + i).alias("px"), (F.floor("v").cast("int") + j).alias("py"), ((F.col("u") - F.floor("u") if i else 1 - (F.col("u") - F.floor("u"))) * (F.col("v") - F.floor("v") if j else 1 - (F.col("v") - F.floor("v")))).alias("w")) for i in (0, 1) for j in (0, 1)))
    q = p.select("point_id", F.explode(four).alias("q")).select("point_id", "q.*").where("w > 0")
    return q.join(d.dem(spark, sf).where("elev is not null"), ["px", "py"]).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), r3(F.sum("w"), "weight"))


@query("agg11_way_bbox", "select way_id, round(min(mx), 3) min_x, round(min(my), 3) min_y, round(max(mx), 3) max_x, round(max(my), 3) max_y from line group by 1 having count(*) >= 2", "line")
def _(spark, sf):
    v = ways.vertices(d.refs(spark, sf), d.coordinates(spark, sf).select("node_id", "mx", "my"))
    box = v.groupBy("way_id").agg(F.count(F.lit(1)).alias("n"), r3(F.min("mx"), "min_x"), r3(F.min("my"), "min_y"), r3(F.max("mx"), "max_x"), r3(F.max("my"), "max_y"))
    return box.where("n >= 2").drop("n")


@query("agg18_telemetry", "select 'nodes' phase, count(*) blocks, count(*) * 24 bytes from coordinates union all select 'ways', count(*), count(*) * 32 from kept union all select 'pois', count(*), count(*) * 64 from pois", "coordinates", "kept", "pois")
def _(spark, sf):
    parts = [(n, df, size) for n, df, size in (("nodes", d.coordinates(spark, sf), 24), ("ways", _classified(spark, sf), 32), ("pois", d.pois(spark, sf), 64))]
    out = None
    for name, df, size in parts:
        one = df.agg(F.count(F.lit(1)).alias("blocks")).select(F.lit(name).alias("phase"), "blocks", (F.col("blocks") * size).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


@query("agg19_read_telemetry", "select user_id::bigint reader, count(*) reads, sum(event_id % 1000)::bigint bytes, arg_max(event_id, ts)::bigint last_read from events group by 1")
def _(spark, sf):
    e = d.read(spark, sf, "events")
    return e.groupBy(F.col("user_id").cast("long").alias("reader")).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.col("event_id") % 1000).cast("long").alias("bytes"), F.max_by(F.col("event_id").cast("long"), "ts").alias("last_read"))


def _boxes(spark, sf) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return d.read(spark, sf, "nation").select(k.alias("box"), (k * 0.11 + 9.5).alias("west"), (k * 0.07 + 46.5).alias("south"), (k * 0.11 + 9.8).alias("east"), (k * 0.07 + 46.7).alias("north"))


def _range_sql(z: str, src: str) -> str:
    n = f"(1::bigint << {z})"
    gx = f"least(greatest(floor(({{}} + 180) / 360 * pow(2, {z}))::bigint, 0), {n} - 1)"
    gy = f"least(greatest(floor((1 - ln(tan(radians({{}})) + 1 / cos(radians({{}}))) / pi()) / 2 * pow(2, {z}))::bigint, 0), {n} - 1)"
    return f"x as (select box, z, x0, y0, greatest(x1, x0) x1, greatest(y1, y0) y1 from (select box, z, {gx.format('west')} x0, {gx.format('(east - 1e-9)')} x1, {gy.format('north', 'north')} y0, {gy.format('(south + 1e-9)', '(south + 1e-9)')} y1 from {src})), t as (select box, z::integer z, unnest(range(x0, x1 + 1)) x, y0, y1 from x), u as (select box, z, x, unnest(range(y0, y1 + 1)) y from t)"


_BOXQ = "with b as (select n_nationkey::bigint box, n_nationkey * 0.11::double + 9.5 west, n_nationkey * 0.07::double + 46.5 south, n_nationkey * 0.11::double + 9.8 east, n_nationkey * 0.07::double + 46.7 north, unnest(range({}, {})) z from nation), "


@query("gen01_bbox_tile_range", _BOXQ.format(12, 13) + _range_sql("z::int", "b") + " select box, z, x, y from u")
def _(spark, sf):
    return tiles.range_tiles(_boxes(spark, sf).withColumn("z", F.lit(12))).select("box", "z", "x", "y")


@query("gen02_pyramid", (_BOXQ.format(5, 12) + _range_sql("z::int", "b") + ", tt as (select distinct z, x, y from u)" + HILBERT.replace("from t\n", "from tt\n", 1) + " select z, x, y, tile_id from ids").replace("with ", "with recursive ", 1))
def _(spark, sf):
    return tiles.pyramid(_boxes(spark, sf), 5, 11)


@query("agg21_pyramid_count", _BOXQ.format(5, 12) + _range_sql("z::int", "b") + " select z, count(distinct (x, y)) tiles from u group by 1")
def _(spark, sf):
    return tiles.pyramid(_boxes(spark, sf), 5, 11).groupBy("z").agg(F.count(F.lit(1)).alias("tiles"))


_TEN = f", t as (select distinct {_tx('10')} x, {_ty('10')} y from coordinates)"


@query("gen03_pixel_grid", f"{_TEN} select x, y, count(*) n, count(distinct cell) cells, round(sum(lon), 3) lon, round(sum(lat), 3) lat from (select x, y, i cell, (x + (i % 256 + 0.5::double) / 256) / 1024 * 360 - 180 lon, degrees(atan(sinh(pi() * (1 - 2 * (y + (i // 256 + 0.5::double) / 256) / 1024)))) lat from t, range(65536) u(i)) group by 1, 2", "coordinates")
def _(spark, sf):
    """Pixel centres of the tiles of zoom 10 that have nodes."""
    t = d.coordinates(spark, sf).select(F.lit(10).alias("z"), geo.tile_x("mx", 10).alias("x"), geo.tile_y("my", 10).alias("y")).distinct()
    return terrain.tile_pixels(t).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("px", "py").alias("cells"), r3(F.sum("lon"), "lon"), r3(F.sum("lat"), "lat"))


_NT = f", t as (select distinct {_tx('14')} x, {_ty('14')} y from coordinates)"


@query("set03_ring_dilation", f"{_NT} select distinct least(greatest(x + i, 0), 16383) x, least(greatest(y + j, 0), 16383) y from t, range(-1, 2) a(i), range(-1, 2) b(j)", "coordinates")
def _(spark, sf):
    t = d.coordinates(spark, sf).select(geo.tile_x("mx", 14).alias("x"), geo.tile_y("my", 14).alias("y"))
    return tiles.ring(t, 14)


@query("set02_distinct_tiles", f"{_NT} select x, y from t", "coordinates")
def _(spark, sf):
    return d.coordinates(spark, sf).select(geo.tile_x("mx", 14).alias("x"), geo.tile_y("my", 14).alias("y")).distinct()


@query("set01_features_union", f"select false is_poi, way_id osm_id, layer, class, name as name from kept union all select true, node_id, 2, 'peak', nullif(name, '') from pois", "kept", "pois")
def _(spark, sf):
    w = _classified(spark, sf).select(F.lit(False).alias("is_poi"), F.col("way_id").alias("osm_id"), "layer", "class", "name")
    return w.unionByName(tiles.poi_features(d.pois(spark, sf)).select("is_poi", "osm_id", "layer", "class", "name"))


@query("set04_files_to_verify", "select distinct l_partkey::bigint id from lineitem except select node_id from nodes", "nodes")
def _(spark, sf):
    return d.read(spark, sf, "lineitem").select(F.col("l_partkey").cast("long").alias("id")).distinct().exceptAll(d.nodes(spark, sf).select(F.col("node_id").alias("id")))


@query("set05_declared_vs_live", "select o_orderkey::bigint id from orders except select way_id from refs", "refs")
def _(spark, sf):
    live = d.read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"))
    return d.read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id")).join(live, "id", "left_anti").distinct()


@query("srt01_hilbert_sort", (f"with recursive {', '.join(f'{n} as ({d.CTE[n]})' for n in ('nodes', 'coordinates'))}, t as (select distinct 14 z, {_tx('14')} x, {_ty('14')} y from coordinates){HILBERT} select tile_id, row_number() over (order by tile_id) place from ids"))
def _(spark, sf):
    t = d.coordinates(spark, sf).select(geo.tile_x("mx", 14).alias("x"), geo.tile_y("my", 14).alias("y")).distinct()
    ids = t.select(geo.hilbert_id(F.lit(14), "x", "y").alias("tile_id"))
    return placed(ids, "tile_id", F.floor(F.col("tile_id") / (1 << 16)))


def placed(rows: DataFrame, key: str, part: Column) -> DataFrame:
    """key and place: the row's number in the order of the key.

    Rows are counted within parts, which must follow each other as their keys do; only one row a part goes through a
    single task.
    """
    parts = rows.withColumn("part", part)
    totals = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = parts.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    return inner.join(totals, "part").select(key, (F.col("before") + F.col("rank")).alias("place"))


@query("srt03_top_candidates", "select o_custkey::bigint customer, o_orderkey::bigint id from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def _(spark, sf):
    o = d.read(spark, sf, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("r", rank).where("r <= 3").select(F.col("o_custkey").cast("long").alias("customer"), F.col("o_orderkey").cast("long").alias("id"))


@query("srt06_resume_scan", "select way_id, n from sizes where way_id > 5000", "sizes")
def _(spark, sf):
    return d.refs(spark, sf).where("way_id > 5000").select("way_id", F.size("refs").cast("long").alias("n"))


@query("src09_point_scan", f"select node_id, round(mx, 3) mx, {_tx('14')} tx from coordinates where node_id in (1, 5, 17, 18, 100)", "coordinates")
def _(spark, sf):
    return d.coordinates(spark, sf).where(F.col("node_id").isin(1, 5, 17, 18, 100)).select("node_id", r3("mx", "mx"), geo.tile_x("mx", 14).alias("tx"))


@query("snk04_tile_store", f", a as (select {_tx('14')} x, {_ty('14')} y, node_id from coordinates) select x, y, count(*) filter (node_id % 3 <> 0) as old, count(*) filter (node_id % 3 = 0) as changed, count(*) filter (node_id % 3 = 0) as new from a group by 1, 2", "coordinates")
def _(spark, sf):
    """Nodes as features of their tiles; every third comes again under another name, and as many are new: by tile."""
    at = d.coordinates(spark, sf).select(F.lit(14).alias("z"), geo.tile_x("mx", 14).cast("long").alias("x"), geo.tile_y("my", 14).cast("long").alias("y"), F.lit(False).alias("is_poi"), F.col("node_id").cast("long").alias("osm_id"), F.lit("old").alias("name"))
    store = TileStore(spark, f"{checkpoint_folder(spark)}/tile-store-{uuid.uuid4().hex}")
    store.upsert(at)
    third = at.where(F.col("osm_id") % 3 == 0)
    store.upsert(third.withColumn("name", F.lit("changed")).unionByName(third.withColumns({"name": F.lit("new"), "osm_id": -F.col("osm_id") - 1})))
    kinds = {k: F.count_if(F.col("name") == k).alias(k) for k in ("old", "changed", "new")}
    return store.read().groupBy("x", "y").agg(*kinds.values())


@query("src10_cardinality", "select (select count(*) from coordinates) nodes, (select count(*) from sizes) ways, (select count(*) from pois) pois", "coordinates", "sizes", "pois")
def _(spark, sf):
    counts = [("nodes", d.coordinates(spark, sf)), ("ways", d.refs(spark, sf)), ("pois", d.pois(spark, sf))]
    rows = None
    for name, df in counts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("k"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k, _ in counts))


@query("snk01_node_upsert", "select node_id, max(seq) seq, arg_max(lon_u, seq) lon_u from (select l_partkey::bigint node_id, l_orderkey::bigint * 100 + l_linenumber seq, (l_orderkey * 31 + l_linenumber)::bigint lon_u from lineitem) group by 1")
def _(spark, sf):
    rows = d.read(spark, sf, "lineitem").select(F.col("l_partkey").cast("long").alias("node_id"), (F.col("l_orderkey").cast("long") * 100 + F.col("l_linenumber")).alias("seq"), (F.col("l_orderkey") * 31 + F.col("l_linenumber")).cast("long").alias("lon_u"))
    return ways.latest(rows.distinct(), "node_id", "seq").select("node_id", "seq", "lon_u")


# Kernels that SQL has no words for; tests hold them against independent decoders and exact arithmetic.


@query("geo01_rdp_simplify")
def _(spark, sf):
    lines = ways.lines(d.refs(spark, sf), d.coordinates(spark, sf))
    return tiles.simplified(lines).select("way_id", F.size("line").cast("long").alias("n"))


@query("geo03_tile_binning")
def _(spark, sf):
    lines = ways.lines(d.refs(spark, sf), d.coordinates(spark, sf))
    return tiles.binned(lines).select("z", "x", "y", "way_id", F.size("segments").cast("long").alias("runs"))


def compiled_features(spark, sf, zoom: int = geo.DETAIL_ZOOM) -> DataFrame:
    """Tile features of all ways and peaks."""
    kept = _classified(spark, sf)
    lines = ways.lines(d.refs(spark, sf), d.coordinates(spark, sf)).join(kept.select("way_id"), "way_id", "left_semi")
    return tiles.way_features(kept, lines, zooms=(zoom,)).unionByName(tiles.poi_features(d.pois(spark, sf), zoom))


@query("geo05_mvt_encode")
def _(spark, sf):
    t = tiles.encoded(compiled_features(spark, sf))
    return t.select("tile_id", "z", "x", "y", F.length("payload").cast("long").alias("n_bytes"))


def compiled_archive(spark, sf, path: str, zoom: int = geo.DETAIL_ZOOM) -> DataFrame:
    """The whole compile: features, tiles, an archive at ``path``, and the archive read back."""
    from tarn.sources import pmtiles, tile_archive

    archive.write_archive(tiles.encoded(compiled_features(spark, sf, zoom)), path, (9.0, 46.0, 18.0, 49.0), pmtiles.vector_metadata("map"))
    tile_archive.register(spark)
    return spark.read.format("pmtiles").load(path)


def decoded(tiles_: DataFrame) -> DataFrame:
    """x, y and what a decoder finds in each tile (tile_id, payload): features, segments, vertices, sums of grid coordinates."""
    import gzip

    import pyarrow as pa

    from tarn.operators import mvt

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                found = mvt.decode_tile(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                points = [p for f in found for s in f["segments"] for p in s]
                out.append((len(found), sum(len(f["segments"]) for f in found), len(points), sum(x for x, _ in points), sum(y for _, y in points)))
            names = ["features", "segments", "vertices", "sum_x", "sum_y"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], pa.int64()) for i in range(5))], names=["tile_id", *names])

    found = tiles_.select("tile_id", "payload").mapInArrow(run, "tile_id long, features long, segments long, vertices long, sum_x long, sum_y long")
    return found.withColumn("t", geo.hilbert_tile("tile_id")).select("t.x", "t.y", "features", "segments", "vertices", "sum_x", "sum_y")


@query("geo04_mvt_geometry")
def _(spark, sf):
    return decoded(tiles.encoded(compiled_features(spark, sf), compress=False))


@query("snk06_pmtiles_roundtrip")
def _(spark, sf):
    from tarn.sources.files import shared_folder

    return decoded(compiled_archive(spark, sf, f"{shared_folder(spark, 'archive')}/map.pmtiles")).select("x", "y", "features")


@query("geo08_terrain_tiles")
def _(spark, sf):
    affine = terrain.Affine(d.DEM_WEST, d.DEM_NORTH, d.DEM_STEP, d.DEM_STEP)
    box = spark.createDataFrame([(0, 11.0, 47.1, 11.6, 47.5)], "box long, west double, south double, east double, north double")
    made = terrain.rendered(tiles.pyramid(box, 5, 12), d.dem(spark, sf), affine)
    return made.select("tile_id", "z", "x", "y", F.length("payload").cast("long").alias("n_bytes"))


@query("geo10_contours")
def _(spark, sf):
    c = terrain.contours(d.dem(spark, sf))
    return c.groupBy("ele", "level").agg(F.count(F.lit(1)).alias("segments"), r3(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), "pixels"))


@query("geo11_hillshade")
def _(spark, sf):
    return terrain.hillshade(d.dem(spark, sf), 1000.0)


@query("gen04_grid_traversal")
def _(spark, sf):
    import numpy as np
    import pyarrow as pa

    from tarn.operators import kernels

    s = _segments(spark, sf).select("way_id", F.col("pos").cast("int").alias("pos"), "mx", "my", "bx", "by_")

    def run(batches):
        for b in batches:
            xy = np.stack([b.column(i).to_numpy() for i in range(2, 6)], 1)
            seg, cell = kernels.crossed_all(xy[:, :2], xy[:, 2:], geo.DETAIL_ZOOM)
            tiles = np.unique(seg << 28 | cell[:, 0] << 14 | cell[:, 1])
            n = np.bincount(tiles >> 28, minlength=len(xy))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["way_id", "pos", "n_tiles"])

    return s.mapInArrow(run, "way_id long, pos int, n_tiles long")


@query("jon14_registry_match", "with k as (select 'r' || (o_orderkey % 40)::varchar || case o_orderkey % 3 when 0 then '' when 1 then '/z/' || o_orderkey::varchar else 'x' end key from orders group by 1), r as (select 'r' || i::varchar as name, 'u' || i::varchar url from range(30) t(i)) select k.key, r.url from k left join r on k.key = r.name or starts_with(k.key, r.name || '/')")
def _(spark, sf):
    k = F.col("o_orderkey").cast("long")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("/z/"), k.cast("string"))).otherwise("x")
    keys = d.read(spark, sf, "orders").select(F.concat(F.lit("r"), (k % 40).cast("string"), tail).alias("key")).distinct()
    registry = spark.range(30).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    return export.match_registry(keys, registry)


@query("jon15_boot_actions", "with r as (select n_nationkey::bigint region, case when n_nationkey % 4 <> 0 then 'f' || (n_nationkey % 6)::varchar end file, n_nationkey % 3 = 0 bound from nation), f as (select distinct 'f' || r_regionkey::varchar have from region) select region, case when file is null then 'noop' when have is null then 'clear' when bound then 'noop' else 'bind' end as action from r left join f on file = have")
def _(spark, sf):
    k = F.col("n_nationkey")
    regions = d.read(spark, sf, "nation").select(k.cast("long").alias("region"), F.when(k % 4 != 0, F.concat(F.lit("f"), (k % 6).cast("string"))).alias("file"), (k % 3 == 0).alias("bound"))
    files = d.read(spark, sf, "region").select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("file"))
    return export.boot_actions(regions, files)


@query("agg22_breaker_runs", "with a as (select user_id::bigint job_id, event_id::bigint seq, event_type = 'purchase' clean from events), i as (select *, sum(clean::int) over (partition by job_id order by seq) g from a), n as (select job_id, g, count(*) filter (not clean) n from i group by 1, 2) select job_id, max(n) max_dirty from n group by 1")
def _(spark, sf):
    e = d.read(spark, sf, "events").select(F.col("user_id").cast("long").alias("job_id"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") == "purchase").alias("clean"))
    return export.max_dirty_runs(e)


@query("agg23_peak_memory", "select user_id::bigint process, max(value) peak from events group by 1")
def _(spark, sf):
    return d.read(spark, sf, "events").groupBy(F.col("user_id").cast("long").alias("process")).agg(F.max("value").alias("peak"))


@query("agg24_chunk_concat", "select conv_id, sum(strlen(text))::bigint total, sha256(string_agg(text, '' order by turn)) digest from conversations group by 1")
def _(spark, sf):
    c = d.read(spark, sf, "conversations")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return c.groupBy("conv_id").agg(F.sum(F.octet_length("text")).cast("long").alias("total"), F.sha2(F.encode(parts, "UTF-8"), 256).alias("digest"))


#: Nodes by tile of this zoom, as an archive whose payloads say how many.
NODE_ZOOM = 16
_BOX = (34_790, 34_815, 22_960, 23_000)
_NODE_TILES = ", t as (select floor((lon + 180) / 360 * 65536)::bigint x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536)::bigint y from coordinates), c as (select x, y, 'nodes: ' || count(*)::varchar payload from t group by 1, 2)"


def _node_archive(spark, sf) -> str:
    """The archive's path, written by the sink."""
    import os

    from tarn.sources import tile_archive
    from tarn.sources.files import shared_folder

    at = d.coordinates(spark, sf).select(geo.lonlat_tile_x("lon", NODE_ZOOM).alias("x"), geo.lonlat_tile_y("lat", NODE_ZOOM).alias("y"))
    made = at.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).select(geo.hilbert_id(F.lit(NODE_ZOOM), "x", "y").alias("tile_id"), F.encode(F.concat(F.lit("nodes: "), F.col("n").cast("string")), "UTF-8").alias("payload"))
    path = os.path.join(shared_folder(spark, "nodes"), "nodes.pmtiles")
    tile_archive.write_tiles(made, path, (11.0, 47.0, 11.5, 47.4), {"name": "nodes"}, tile_compression=1)
    return path


@query("snk05_archive_sink", f"{_NODE_TILES} select {NODE_ZOOM} z, x, y, payload, length(payload)::bigint length from c", "coordinates")
def _(spark, sf):
    """All tiles of an archive that tasks and a commit have written."""
    t = spark.read.format("pmtiles").load(_node_archive(spark, sf))
    return t.select("z", "x", "y", F.decode("payload", "UTF-8").alias("payload"), "length")


@query("src18_archive_box", f"{_NODE_TILES} select x, y, payload from c where x between {_BOX[0]} and {_BOX[1]} and y between {_BOX[2]} and {_BOX[3]}", "coordinates")
def _(spark, sf):
    """The tiles of a box; the filter tells the source which leaves and payloads to read."""
    t = spark.read.format("pmtiles").load(_node_archive(spark, sf))
    inside = t.where((F.col("z") == NODE_ZOOM) & F.col("x").between(*_BOX[:2]) & F.col("y").between(*_BOX[2:]))
    return inside.select("x", "y", F.decode("payload", "UTF-8").alias("payload"))


@query("jon13_archive_directory", f"{_NODE_TILES} select count(*) tiles, sum(length(payload))::bigint bytes, count(distinct payload) contents from c", "coordinates")
def _(spark, sf):
    """What an archive's directories say; no payload is read."""
    t = spark.read.format("pmtiles").schema("tile_id long, offset long, length long").load(_node_archive(spark, sf))
    return t.agg(F.count(F.lit(1)).alias("tiles"), F.sum("length").alias("bytes"), F.countDistinct("offset").alias("contents"))


def image_heights(made: DataFrame) -> DataFrame:
    """z, x, y, codes (the sum of all pixels' codes) and drawn (how many are not 0 m) of PNG terrain tiles (z, x, y, payload)."""
    import zlib

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            sums, drawn = [], []
            for raw in b.column(3).to_pylist():
                size = int.from_bytes(raw[33:37], "big")  # after the signature and the image's head: the pixels
                rows = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(256, 1 + 3 * 256)[:, 1:].reshape(-1, 3).astype(np.int64)
                code = rows[:, 0] << 16 | rows[:, 1] << 8 | rows[:, 2]
                sums.append(int(code.sum()))
                drawn.append(int((code != 100_000).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64()), pa.array(drawn, pa.int64())], names=["z", "x", "y", "codes", "drawn"])

    return made.select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "payload").mapInArrow(run, "z int, x long, y long, codes long, drawn long")


_TERRAIN_BOX = (11.0, 47.1, 11.6, 47.5)
_HEIGHTS = f""", zs as (select unnest([8, 9, 10]) z),
xs as (select z, unnest(range(floor(({_TERRAIN_BOX[0]}::double + 180) / 360 * pow(2, z))::bigint, floor(({_TERRAIN_BOX[2]}::double + 180) / 360 * pow(2, z))::bigint + 1)) x from zs),
ts as (select z, x, unnest(range(floor((1 - ln(tan(radians({_TERRAIN_BOX[3]}::double)) + 1 / cos(radians({_TERRAIN_BOX[3]}::double))) / pi()) / 2 * pow(2, z))::bigint, floor((1 - ln(tan(radians({_TERRAIN_BOX[1]}::double)) + 1 / cos(radians({_TERRAIN_BOX[1]}::double))) / pi()) / 2 * pow(2, z))::bigint + 1)) y from xs),
pp as (select z, x, y, i, ((x + (i % 256 + 0.5::double) / 256) / pow(2, z) * 360 - 180 - {d.DEM_WEST}::double) / {d.DEM_STEP}::double - 0.5 u, ({d.DEM_NORTH}::double - degrees(atan(sinh(pi() * (1 - 2 * (y + (i // 256 + 0.5::double) / 256) / pow(2, z)))))) / {d.DEM_STEP}::double - 0.5 v from ts, range(65536) t(i)),
qq as (select z, x, y, i, floor(u)::integer + a px, floor(v)::integer + b py, (case when a = 1 then u - floor(u) else 1 - (u - floor(u)) end) * (case when b = 1 then v - floor(v) else 1 - (v - floor(v)) end) w from pp, range(2) r(a), range(2) s(b)),
mm as (select z, x, y, i, sum(w * elev) / sum(w) e from qq join dem using (px, py) where w > 0 and elev is not null group by all),
cc as (select z, x, y, floor((coalesce(e, 0) + 10000) * 10 + 0.5)::bigint code from pp left join mm using (z, x, y, i))
select z::integer z, x, y, sum(code)::bigint codes, count(*) filter (code <> 100000) drawn from cc group by 1, 2, 3"""


@query("geo08_terrain_heights", _HEIGHTS, "dem")
def _(spark, sf):
    """Terrain tiles as images, and what a decoder reads from them."""
    affine = terrain.Affine(d.DEM_WEST, d.DEM_NORTH, d.DEM_STEP, d.DEM_STEP)
    box = spark.createDataFrame([(0, *_TERRAIN_BOX)], "box long, west double, south double, east double, north double")
    return image_heights(terrain.rendered(tiles.pyramid(box, 8, 10), d.dem(spark, sf), affine, codec="png"))
