"""Queries for the scalar expressions and filters (inventory groups PRJ, FIL), with their oracles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.functions import text as tx
from tarn.operators import export, online, ways
from tarn.plans import derived as d

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = 20037508.342789244


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a query, and its oracle over the derived tables it names."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = d.with_tables(sql, *tables)
        return f

    return add


def r3(c, name: str):
    return F.round(c, 3).alias(name)


@query("prj01_web_mercator", "select node_id, round(mx, 3) mx, round(my, 3) my from coordinates", "coordinates")
def _(spark, sf):
    return d.coordinates(spark, sf).select("node_id", r3("mx", "mx"), r3("my", "my"))


_PAIRS = "select l.way_id, l.layer, l.class, l.sac_scale, l.name as name from kept l"


@query("prj02_way_classify", _PAIRS, "kept")
def _(spark, sf):
    return ways.keep(d.ways(spark, sf)).select("way_id", "layer", "class", "sac_scale", "name")


@query("prj03_tag_slots", "select way_id, sac_scale, name as name from kinds", "kinds")
def _(spark, sf):
    return ways.classify(d.tags(spark, sf)).select("way_id", "sac_scale", "name")


@query("prj04_layer_name", "select way_id, ['highway','waterway','natural','landuse'][layer + 1] layer_name from kinds", "kinds")
def _(spark, sf):
    return ways.classify(d.tags(spark, sf)).select("way_id", tx.layer_name("layer").alias("layer_name"))


@query("prj05_zoom_resolution", f"select id, z::integer z, round({2 * W} / pow(2, z), 6) extent, round({2 * W} / pow(2, z) / 256, 6) mpp, round({2 * W} / pow(2, z) / 512, 6) eps from (select c_custkey::bigint id, c_custkey % 23 z from customer)")
def _(spark, sf):
    z = (F.col("c_custkey") % 23).cast("int")
    return d.read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), z.alias("z"), F.round(geo.tile_extent(z), 6).alias("extent"), F.round(geo.meters_per_pixel(z), 6).alias("mpp"), F.round(geo.simplify_epsilon(z), 6).alias("eps"))


def _tx(z: str) -> str:
    return f"least(greatest(floor((mx + {W}) / ({2 * W} / pow(2, {z})))::bigint, 0), (1::bigint << {z}) - 1)"


def _ty(z: str) -> str:
    return f"least(greatest(floor(({W} - my) / ({2 * W} / pow(2, {z})))::bigint, 0), (1::bigint << {z}) - 1)"


@query("prj06_node_tile", f"select node_id, z::integer z, {_tx('z::int')} tx, {_ty('z::int')} ty from coordinates, range(5, 15) t(z)", "coordinates")
def _(spark, sf):
    zoomed = d.coordinates(spark, sf).withColumn("z", F.explode(F.sequence(F.lit(5), F.lit(14))))
    return zoomed.select("node_id", "z", geo.tile_x("mx", "z").alias("tx"), geo.tile_y("my", "z").alias("ty"))


_TILES = f", t as (select distinct 14 z, {_tx('14')} x, {_ty('14')} y from coordinates)"


def node_tiles(spark, sf) -> DataFrame:
    return d.coordinates(spark, sf).select(F.lit(14).alias("z"), geo.tile_x("mx", 14).alias("x"), geo.tile_y("my", 14).alias("y")).distinct()


def _bounds_sql(pad: float) -> str:
    e = f"({2 * W} / 16384)"
    return f"{_TILES} select z, x, y, round(x * {e} - {W} - {pad} * {e}, 3) min_x, round({W} - (y + 1) * {e} - {pad} * {e}, 3) min_y, round((x + 1) * {e} - {W} + {pad} * {e}, 3) max_x, round({W} - y * {e} + {pad} * {e}, 3) max_y from t"


@query("prj07_tile_bounds", _bounds_sql(0.0), "coordinates")
def _(spark, sf):
    return node_tiles(spark, sf).withColumn("b", geo.tile_bounds("z", "x", "y")).select("z", "x", "y", *(r3(f"b.{k}", k) for k in ("min_x", "min_y", "max_x", "max_y")))


@query("prj08_clip_bounds", _bounds_sql(64 / 4096), "coordinates")
def _(spark, sf):
    return node_tiles(spark, sf).withColumn("b", geo.clip_bounds("z", "x", "y")).select("z", "x", "y", *(r3(f"b.{k}", k) for k in ("min_x", "min_y", "max_x", "max_y")))


@query("prj09_lonlat_tile", "select node_id, least(greatest(floor((lon + 180) / 360 * 4096)::bigint, 0), 4095) tx, least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::bigint, 0), 4095) ty from coordinates", "coordinates")
def _(spark, sf):
    return d.coordinates(spark, sf).select("node_id", geo.lonlat_tile_x("lon", 12).alias("tx"), geo.lonlat_tile_y("lat", 12).alias("ty"))


@query("prj10_tile_degrees", f"{_TILES} select x, y, round(x / 16384 * 360 - 180, 6) west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 16384)))), 6) north from t", "coordinates")
def _(spark, sf):
    return node_tiles(spark, sf).select("x", "y", F.round(geo.tile_west("x", "z"), 6).alias("west"), F.round(geo.tile_north("y", "z"), 6).alias("north"))


@query("prj11_pixel_centres", "select id, p::integer px, round((2177 + (p + 0.5::double) / 256) / 4096 * 360 - 180, 6) lon, round(degrees(atan(sinh(pi() * (1 - 2 * (1436 + (p + 0.5::double) / 256) / 4096)))), 6) lat from (select p_partkey::bigint id, p_partkey * 37 % 256 p from part)")
def _(spark, sf):
    p = (F.col("p_partkey") * 37 % 256).cast("int")
    x, y, z = F.lit(2177), F.lit(1436), F.lit(12)
    return d.read(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"), p.alias("px"), F.round(geo.pixel_lon(x, z, p), 6).alias("lon"), F.round(geo.pixel_lat(y, z, p), 6).alias("lat"))


_U, _V = "((lon + 180) / 360 * 16384)", "((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384)"


@query("prj12_tile_pixel", f"select node_id, floor({_U})::bigint x, floor({_V})::bigint y, least(greatest(floor(({_U} - floor({_U})) * 256)::integer, 0), 255) px, least(greatest(floor(({_V} - floor({_V})) * 256)::integer, 0), 255) py from coordinates", "coordinates")
def _(spark, sf):
    return d.coordinates(spark, sf).select("node_id", geo.tile_pixel("lon", "lat", 14).alias("p")).select("node_id", "p.*")


@query("prj13_affine", "select node_id, round((lon - 11.0::double) / 0.01::double - 0.5, 3) u, round((47.5::double - lat) / 0.01::double - 0.5, 3) v from coordinates", "coordinates")
def _(spark, sf):
    u, v = geo.model_to_pixel(F.col("lon"), F.col("lat"), d.DEM_WEST, d.DEM_NORTH, d.DEM_STEP, d.DEM_STEP)
    return d.coordinates(spark, sf).select("node_id", r3(u, "u"), r3(v, "v"))


_CODE = "greatest(least(round((coalesce(elev, 0) + 10000) * 10), 16777215), 0)::integer"


@query("prj14_terrain_rgb", f", c as (select px, py, {_CODE} c from dem) select px, py, (c >> 16) & 255 r, (c >> 8) & 255 g, c & 255 b, round(c * 0.1::double - 10000, 3) back from c", "dem")
def _(spark, sf):
    rgb = d.dem(spark, sf).select("px", "py", geo.terrain_rgb("elev").alias("c")).select("px", "py", "c.r", "c.g", "c.b")
    return rgb.select("*", F.round(geo.terrain_elevation("r", "g", "b"), 3).alias("back"))


@query("prj15_terrarium", "select (i * 7 % 256)::integer r, (i * 13 % 256)::integer g, (i * 29 % 256)::integer b, round((i * 7 % 256) * 256 + (i * 13 % 256) + (i * 29 % 256) / 256 - 32768, 3) elev from (select c_custkey::bigint i from customer)")
def _(spark, sf):
    i = F.col("c_custkey").cast("long")
    rgb = d.read(spark, sf, "customer").select((i * 7 % 256).cast("int").alias("r"), (i * 13 % 256).cast("int").alias("g"), (i * 29 % 256).cast("int").alias("b"))
    return rgb.select("*", r3(geo.terrarium_elevation("r", "g", "b"), "elev"))


_HAV = "pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2)"


@query("prj16_haversine", f", s as (select route_id, seq, lng, lat, lag(lng) over w plng, lag(lat) over w plat from route_points window w as (partition by route_id order by seq)) select route_id, seq, round(2 * 6371000 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))), 3) m, round(2 * 6371000 * asin(sqrt({_HAV})), 3) m2 from s where plng is not null", "route_points")
def _(spark, sf):
    p = ways.with_previous(d.route_points(spark, sf), "route_id", "seq", "lng", "lat").where("prev_lng is not null")
    return p.select("route_id", "seq", r3(geo.haversine("prev_lng", "prev_lat", "lng", "lat"), "m"), r3(geo.haversine_asin("prev_lng", "prev_lat", "lng", "lat"), "m2"))


_T = "least(greatest(coalesce(((11.25::double - plng) * (lng - plng) + (47.2::double - plat) * (lat - plat)) / nullif((lng - plng) * (lng - plng) + (lat - plat) * (lat - plat), 0), 0), 0), 1)"


@query("prj17_closest_point", f", s as (select route_id, seq, lng, lat, lag(lng) over w plng, lag(lat) over w plat from route_points window w as (partition by route_id order by seq)) select route_id, seq, round(plng + {_T} * (lng - plng), 6) x, round(plat + {_T} * (lat - plat), 6) y from s where plng is not null", "route_points")
def _(spark, sf):
    p = ways.with_previous(d.route_points(spark, sf), "route_id", "seq", "lng", "lat").where("prev_lng is not null")
    at = geo.closest_on_segment(F.lit(11.25), F.lit(47.2), "prev_lng", "prev_lat", "lng", "lat")
    return p.withColumn("at", at).select("route_id", "seq", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"))


#: Hilbert numbers by recursion over the bits of a tile, in DuckDB.
HILBERT = """, h(z, x, y, k, d, cx, cy) as (
 select z, x, y, z - 1, 0::bigint, x, y from t
 union all
 select z, x, y, k - 1, d + (1::bigint << k) * (1::bigint << k) * xor(3 * ((cx >> k) & 1), (cy >> k) & 1),
  case when (cy >> k) & 1 = 0 then case when (cx >> k) & 1 = 1 then (1::bigint << z) - 1 - cy else cy end else cx end,
  case when (cy >> k) & 1 = 0 then case when (cx >> k) & 1 = 1 then (1::bigint << z) - 1 - cx else cx end else cy end
 from h where k >= 0),
ids as (select z, x, y, ((1::bigint << (2 * z)) - 1) // 3 + d tile_id from h where k = -1)"""


@query("prj18_hilbert_id", f", t as (select distinct z::integer z, {_tx('z::int')} x, {_ty('z::int')} y from coordinates, range(5, 15) r(z)){HILBERT} select z, x, y, tile_id from ids", "coordinates")
def _(spark, sf):
    zoomed = d.coordinates(spark, sf).withColumn("z", F.explode(F.sequence(F.lit(5), F.lit(14))))
    tiles = zoomed.select("z", geo.tile_x("mx", "z").alias("x"), geo.tile_y("my", "z").alias("y")).distinct()
    return tiles.select("z", "x", "y", geo.hilbert_id("z", "x", "y").alias("tile_id"))


ORACLE_SQL["prj18_hilbert_id"] = ORACLE_SQL["prj18_hilbert_id"].replace("with ", "with recursive ", 1)


@query("prj18_hilbert_inverse", "select o_orderkey::bigint tile_id, o_orderkey::bigint back from orders")
def _(spark, sf):
    tiles = d.read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("tile_id")).withColumn("t", geo.hilbert_tile("tile_id"))
    return tiles.select("tile_id", geo.hilbert_id("t.z", "t.x", "t.y").alias("back"))


@query("prj19_zoom_base", "select id, z::integer z, ((1::bigint << (2 * z::int)) - 1) // 3 base from (select c_custkey::bigint id, c_custkey % 26 z from customer)")
def _(spark, sf):
    z = (F.col("c_custkey") % 26).cast("int")
    return d.read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), z.alias("z"), geo.zoom_base(z).alias("base"))


_E = 2 * W / 16384
_PX, _PY = f"round((mx - ({_tx('14')} * {_E} - {W})) * {4096 / _E!r})::bigint", f"round((({W} - {_ty('14')} * {_E}) - my) * {4096 / _E!r})::bigint"


@query("prj20_quantise", f"select node_id, {_PX} px, {_PY} py from coordinates", "coordinates")
def _(spark, sf):
    c = d.coordinates(spark, sf).withColumn("b", geo.tile_bounds(F.lit(14), geo.tile_x("mx", 14), geo.tile_y("my", 14)))
    scale = F.lit(4096 / _E)
    return c.select("node_id", geo.quantise("mx", "b.min_x", scale).alias("px"), geo.quantise("my", "b.max_y", scale, down=True).alias("py"))


@query("prj21_zigzag", "select v, case when v >= 0 then 2 * v else -2 * v - 1 end zz, v back from (select (o_orderkey * 7919 - 500000)::bigint v from orders)")
def _(spark, sf):
    v = d.read(spark, sf, "orders").select((F.col("o_orderkey").cast("long") * 7919 - 500000).alias("v"))
    return v.select("v", geo.zigzag("v").alias("zz")).select("v", "zz", geo.unzigzag("zz").alias("back"))


@query("prj22_ref_deltas", "select way_id, pos, node_id - coalesce(lag(node_id) over (partition by way_id order by pos), 0) delta, node_id back from refs", "refs")
def _(spark, sf):
    r = d.refs(spark, sf).select("way_id", "refs", geo.deltas("refs").alias("ds"))
    return r.select("way_id", F.posexplode(F.arrays_zip(F.col("ds").alias("delta"), geo.undeltas("ds").alias("back"))).alias("pos", "p")).select("way_id", "pos", "p.delta", "p.back")


def segment_codec(spark, sf) -> DataFrame:
    """Ids of ways through the byte codec and back."""
    import pyarrow as pa

    from tarn.operators.mvt import delta_bytes, undelta_bytes

    def run(batches):
        for b in batches:
            ids, refs = b.column(0), b.column(1).to_pylist()
            raw = [delta_bytes(r) for r in refs]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in raw], pa.int64()), pa.array([undelta_bytes(x) == r for x, r in zip(raw, refs, strict=True)])], names=["way_id", "n_bytes", "same"])

    return d.refs(spark, sf).mapInArrow(run, "way_id long, n_bytes long, same boolean")


@query("prj23_segment_codec", ", x as (select way_id, node_id - coalesce(lag(node_id) over (partition by way_id order by pos), 0) v from refs), z as (select way_id, case when v >= 0 then 2 * v else -2 * v - 1 end u from x) select way_id, sum(case when u < 128 then 1 when u < 16384 then 2 when u < 2097152 then 3 else 4 end)::bigint n_bytes, true same from z group by 1", "refs")
def _(spark, sf):
    return segment_codec(spark, sf)


@query("prj24_fnv1a", """with recursive w as (select o_orderkey::bigint id, 'order ' || o_orderkey::varchar s from orders),
f(id, s, i, h) as (select id, s, 0, 14695981039346656037::hugeint from w
 union all select id, s, i + 1, (xor(h, ascii(s[i + 1])::hugeint) * 1099511628211::hugeint) % 18446744073709551616::hugeint from f where i < length(s))
select id, lpad(lower(to_hex(h::ubigint)), 16, '0') hash from f where i = length(s)""")
def _(spark, sf):
    o = d.read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    return o.select("id", tx.fnv1a(F.encode(F.concat(F.lit("order "), F.col("id").cast("string")), "UTF-8")).alias("hash"))


@query("prj25_e7", "select node_id, round(lon * 1e7::double)::integer lon_e7, round(lat * 1e7::double)::integer lat_e7 from coordinates", "coordinates")
def _(spark, sf):
    return d.coordinates(spark, sf).select("node_id", geo.e7("lon").alias("lon_e7"), geo.e7("lat").alias("lat_e7"))


#: Boxes as people write them, right and wrong; numbers take the places of the letters.
_BOXES = ("{w},{s},{e},{n}", " {w} , {s},{e},{n} ", "{w},{s},{e}", "{w},{s},{e},{n},5", "a,{s},{e},{n}", "NaN,{s},{e},{n}", "-181,{s},{e},{n}", "{w},-91,{e},{n}", "{e},{s},{w},{n}", "{w},{n},{e},{s}", "{w},{s},181,{n}", "")


@query("prj26_bbox_validate")
def _(spark, sf):
    k = F.col("c_custkey").cast("long")
    text = F.element_at(F.array(*map(F.lit, _BOXES)), (k % len(_BOXES) + 1).cast("int"))
    for mark, v in (("{w}", k % 300 - 150), ("{s}", k % 150 - 75), ("{e}", k % 300 - 149), ("{n}", k % 150 - 73)):
        text = F.replace(text, F.lit(mark), v.cast("string"))
    return d.read(spark, sf, "customer").select(k.alias("id"), text.alias("input")).select("id", "input", tx.bbox_error("input").alias("error"), tx.bbox_of("input").alias("box"))


ORACLE_SQL["prj26_bbox_validate"] = f"with b as (select c_custkey::bigint id, replace(replace(replace(replace({list(_BOXES)!r}[(c_custkey % {len(_BOXES)} + 1)::int], '{{w}}', (c_custkey % 300 - 150)::varchar), '{{s}}', (c_custkey % 150 - 75)::varchar), '{{e}}', (c_custkey % 300 - 149)::varchar), '{{n}}', (c_custkey % 150 - 73)::varchar) as input from customer)" + """, p as (select id, input, list_transform(string_split(input, ','), lambda x: try_cast(trim(x) as double)) v from b),
e as (select id, input, v, case when len(v) <> 4 then 'arity' when list_contains(list_transform(v, lambda x: x is null or isnan(x) or isinf(x)), true) then 'number'
 when v[1] < -180 or v[1] > 180 or v[3] < -180 or v[3] > 180 or v[2] < -90 or v[2] > 90 or v[4] < -90 or v[4] > 90 then 'range' when v[1] >= v[3] or v[2] >= v[4] then 'inverted' end error from p)
select id, input, error, v[1] west, v[4] north from e where error is null union all select id, input, error, null, null from e where error is not null"""
_box = QUERIES["prj26_bbox_validate"]
QUERIES["prj26_bbox_validate"] = lambda spark, sf: _box(spark, sf).select("id", "input", "error", F.col("box.west").alias("west"), F.col("box.north").alias("north"))


@query("prj27_reticle_bounds", "select k, round(least(greatest(least(a, b), -180), 180), 4) west, round(least(greatest(greatest(a, b), -180), 180), 4) east, round(least(greatest(s, -85), 85), 4) south, round(least(greatest(n, -85), 85), 4) north, round((least(greatest(greatest(a, b), -180), 180) - least(greatest(least(a, b), -180), 180)) * 111.32::double * cos(radians((least(greatest(s, -85), 85) + least(greatest(n, -85), 85)) / 2)), 3) width_km from (select c_custkey::bigint k, -190 + i * 3.7::double a, -170 + i * 2.9::double b, -89 + i::double s, -80 + i * 1.5::double n from (select c_custkey, c_custkey % 100 i from customer))")
def _(spark, sf):
    i = F.col("c_custkey") % 100
    corners = d.read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), (i * 3.7 - 190).alias("a"), (i * 2.9 - 170).alias("b"), (i - 89.0).alias("s"), (i * 1.5 - 80).alias("n"))

    def held(c, most):
        return F.least(F.greatest(c, F.lit(-most)), F.lit(most))

    w, e = held(F.least("a", "b"), 180.0), held(F.greatest("a", "b"), 180.0)
    s, n = held(F.col("s"), 85.0), held(F.col("n"), 85.0)
    km = (e - w) * 111.32 * F.cos(F.radians((s + n) / 2))
    return corners.select("k", F.round(w, 4).alias("west"), F.round(e, 4).alias("east"), F.round(s, 4).alias("south"), F.round(n, 4).alias("north"), r3(km, "width_km"))


@query("prj28_slug_job", "select c_custkey::bigint id, coalesce(nullif(regexp_replace(regexp_replace(lower(c_name || ' Ö ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'region') slug from customer")
def _(spark, sf):
    return d.read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), tx.slug(F.concat("c_name", F.lit(" Ö "), "c_mktsegment")).alias("slug"))


@query("prj29_xml_escape", """select part_id, replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') xml from (select p_partkey::bigint part_id, p_name || ' <&> "''" ' || p_brand s from part)""")
def _(spark, sf):
    return d.read(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("part_id"), tx.xml_escape(F.concat("p_name", F.lit(" <&> \"'\" "), "p_brand")).alias("xml"))


@query("prj30_elapsed", "select s, case when s // 3600 < 10 then '0' || (s // 3600)::varchar else (s // 3600)::varchar end || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') label from (select (o_orderkey * 977)::bigint s from orders)")
def _(spark, sf):
    return d.read(spark, sf, "orders").select((F.col("o_orderkey").cast("long") * 977).alias("s")).select("s", tx.elapsed("s").alias("label"))


@query("prj31_formatters", "select n, case when n < 1024 then n::varchar || ' B' when n < 1048576 then round(n / 1024)::bigint::varchar || ' KB' else printf('%.1f', n / 1048576) || ' MB' end label, round(n / 1000)::bigint::varchar || ' m' metres, case when round(n / 7 - 200)::bigint > 0 then '+' else '' end || round(n / 7 - 200)::bigint::varchar || ' m' delta from (select (c_custkey::bigint * c_custkey * 43 + c_custkey)::bigint n from customer)")
def _(spark, sf):
    n = F.col("n")
    k = F.col("c_custkey").cast("long")
    return d.read(spark, sf, "customer").select((k * k * 43 + k).alias("n")).select("n", tx.bytes_label("n").alias("label"), tx.metres_label(n / 1000).alias("metres"), tx.delta_label(n / 7 - 200).alias("delta"))


@query("prj32_halo_radius", "select seq, round(abs(accuracy) * cos(radians(lat)) / 0.075::double * pow(2, 16 - 20), 3) radius from fixes", "fixes")
def _(spark, sf):
    return d.fixes(spark, sf).select("seq", r3(tx.halo_radius(F.abs("accuracy"), "lat", F.lit(16.0)), "radius"))


def svg_points(profile: DataFrame, width: float = 300.0, height: float = 80.0) -> DataFrame:
    """route_id, seq, x, y of a profile drawn in a box; the range of heights is five metres at least."""
    from pyspark.sql import Window

    w = Window.partitionBy("route_id")
    low, high, n = F.min("elev").over(w), F.max("elev").over(w), F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy("seq")) - 1
    x = F.when(n > 1, i / (n - 1)).otherwise(F.lit(0.0)) * width
    return profile.select("route_id", "seq", x.alias("x"), (F.lit(height) - (F.col("elev") - low) / F.greatest(high - low, F.lit(5.0)) * height).alias("y"))


@query("prj33_svg_profile", ", e as (select route_id, seq, 500 + seq * 7 % 40 + route_id % 11 elev from route_points), m as (select route_id, seq, elev, min(elev) over (partition by route_id) lo, max(elev) over (partition by route_id) hi, count(*) over (partition by route_id) n, row_number() over (partition by route_id order by seq) - 1 i from e) select route_id, seq, round(case when n > 1 then i / (n - 1) else 0 end * 300, 3) x, round(80 - (elev - lo) / greatest(hi - lo, 5) * 80, 3) y from m", "route_points")
def _(spark, sf):
    elev = (F.lit(500) + F.col("seq") * 7 % 40 + F.col("route_id") % 11).cast("double")
    return svg_points(d.route_points(spark, sf).select("route_id", "seq", elev.alias("elev"))).select("route_id", "seq", r3("x", "x"), r3("y", "y"))


def svg_paths(profile: DataFrame) -> DataFrame:
    """route_id, line and area path strings."""
    p = svg_points(profile).withColumn("s", F.format_string("%.1f,%.1f", "x", "y"))
    line = F.concat(F.lit("M"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "s"))), lambda q: q["s"]), " L"))
    return p.groupBy("route_id").agg(line.alias("line")).withColumn("area", F.concat("line", F.lit(" L300.0,80.0 L0.0,80.0 Z")))


@query("prj34_chart_index", "select x, round(least(greatest(x / 300.0::double, 0), 1) * 49)::bigint chart_at from (select (c_custkey % 150 * 3 - 50)::bigint x from customer)")
def _(spark, sf):
    return d.read(spark, sf, "customer").select((F.col("c_custkey").cast("long") % 150 * 3 - 50).alias("x")).select("x", tx.chart_index("x", F.lit(300.0), F.lit(50)).alias("chart_at"))


@query("prj35_style_rules")
def _(spark, sf):
    f = ways.classify(d.tags(spark, sf)).withColumnRenamed("way_id", "osm_id")
    return export.styled(f, 14).select("osm_id", "style_id", "colour", F.round("width", 3).alias("width"))


def _style_sql(zoom: int) -> str:
    parts = []
    for name, layer, classes, negated, minzoom, needs_name, stops in export.STYLE:
        if zoom < minzoom:
            continue
        test = f"layer = {layer}"
        if classes:
            test += f" and class {'not ' if negated else ''}in ({', '.join(repr(c) for c in classes)})"
        if needs_name:
            test += " and name is not null"
        graded = name.startswith("trail-") and name not in ("trail-steps", "trail-cycleway")
        colour = "case sac_scale when 'mountain_hiking' then '#F1C40F' when 'demanding_mountain_hiking' then '#E74C3C' when 'alpine_hiking' then '#000000' when 'demanding_alpine_hiking' then '#000000' when 'difficult_alpine_hiking' then '#000000' else '#2ECC71' end" if graded else "null::varchar"
        width = "null::double"
        if stops:
            value = stops[-1][1] if zoom > stops[-1][0] else next((u + (zoom - a) / (b - a) * (v - u) for (a, u), (b, v) in zip(stops, stops[1:], strict=False) if a <= zoom <= b), stops[0][1])
            width = f"round({value!r}::double, 3)"
        parts.append(f"select way_id osm_id, '{name}' style_id, {colour} colour, {width} width from kinds where {test}")
    return " union all ".join(parts)


ORACLE_SQL["prj35_style_rules"] = d.with_tables(_style_sql(14), "kinds")


@query("prj36_phase_thermal", "select id, i::bigint status, case when i <= 1 then 'nominal' when i = 2 then 'fair' when i = 3 then 'serious' else 'critical' end state, case when i <= 2 then 1.0 when i = 3 then 0.5 else 0.0 end::double scale, case when i <= 2 then 0 when i = 3 then 25 else 100 end pause_ms from (select event_id::bigint id, event_id % 7 i from events)")
def _(spark, sf):
    k = F.col("event_id").cast("long")
    s = d.read(spark, sf, "events").select(k.alias("id"), (k % 7).alias("status")).withColumn("state", tx.android_thermal("status"))
    return s.select("id", "status", "state", tx.thermal("state", 1).alias("scale"), tx.thermal("state", 2).alias("pause_ms"))


@query("prj37_progress", "select i::bigint i, round(least((i % 4 + least(greatest(i / 50.0::double, 0), 1)) / 4 * 100, 100), 3) percent from (select event_id::bigint i from events)")
def _(spark, sf):
    i = F.col("event_id").cast("long")
    return d.read(spark, sf, "events").select(i.alias("i"), r3(tx.phase_percent(i % 4, i / 50.0), "percent"))


@query("prj38_flat_coords", "select id, min_x lo, max_x hi, n from (select way_id id, min(lon) min_x, max(lon) max_x, count(*) n from line group by 1) where n >= 2", "line")
def _(spark, sf):
    flat = d.route_points(spark, sf).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", "lng", "lat"))).alias("p")).where(F.size("p") >= 2)
    flat = flat.select(F.col("route_id").alias("id"), F.flatten(F.transform("p", lambda x: F.array(x["lng"], x["lat"]))).alias("coords"))
    pairs = flat.select("id", export.pairs("coords").alias("p"))
    return pairs.select("id", F.array_min(F.transform("p", lambda x: x["lng"])).alias("lo"), F.array_max(F.transform("p", lambda x: x["lng"])).alias("hi"), F.size("p").cast("long").alias("n"))


def polyline6(points: list[tuple[float, float]]) -> str:
    """(lon, lat) as a polyline of six decimals."""
    out, last = [], (0, 0)
    for lon, lat in points:
        now = (round(lat * 1e6), round(lon * 1e6))
        for a, b in zip(now, last, strict=True):
            v = (a - b) << 1 if a >= b else ~((a - b) << 1)
            while v >= 0x20:
                out.append(chr((v & 0x1F | 0x20) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def decode_polyline6(shape: str) -> list[tuple[float, float]]:
    out, values, value, bits, at = [], [], 0, 0, [0, 0]
    for c in shape:
        b = ord(c) - 63
        value |= (b & 0x1F) << bits
        bits += 5
        if b < 0x20:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = bits = 0
            if len(values) % 2 == 0:
                at = [at[0] + values[-2], at[1] + values[-1]]
                out.append((at[1] / 1e6, at[0] / 1e6))
    return out


@query("prj39_polyline6", "select route_id, seq, round(lng, 5) lng, round(lat, 5) lat from route_points", "route_points")
def _(spark, sf):
    import pyarrow as pa

    lines = d.route_points(spark, sf).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", "lng", "lat"))).alias("p"))

    def run(batches):
        for b in batches:
            rows = [(i, q["seq"], *xy) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for q, xy in zip(p, decode_polyline6(polyline6([(q["lng"], q["lat"]) for q in p])), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.float64()))], names=["route_id", "seq", "lng", "lat"])

    return lines.mapInArrow(run, "route_id long, seq int, lng double, lat double").select("route_id", "seq", F.round("lng", 5).alias("lng"), F.round("lat", 5).alias("lat"))


@query("prj40_pkce", "select c_custkey::bigint id, replace(replace(replace(to_base64(unhex(sha256(c_name))), '+', '-'), '/', '_'), '=', '') challenge from customer")
def _(spark, sf):
    return d.read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), tx.pkce_challenge("c_name").alias("challenge"))


@query("prj41_quota", "select n, round(n / 1073741824, 3) used_gb, round(case when n % 5 = 0 then 1 else n * 3 end / 1073741824, 3) quota_gb from (select ((c_custkey + 1) * 123456789)::bigint n from customer)")
def _(spark, sf):
    n = d.read(spark, sf, "customer").select(((F.col("c_custkey").cast("long") + 1) * 123456789).alias("n"))
    q = F.when(F.col("n") % 5 == 0, F.lit(None)).otherwise(F.col("n") * 3)
    return n.withColumn("q", tx.quota_summary("n", q)).select("n", "q.used_gb", "q.quota_gb")


@query("prj42_resume_plan", "select id, have, total, case when have = 0 then 'fresh' when total is not null and have = total then 'complete' when total is not null and have > total then 'fresh' else 'resume bytes=' || have::varchar || '-' end plan from (select i id, (i % 7)::bigint have, case when i % 3 = 0 then null else (i % 5)::bigint end total from (select o_orderkey::bigint i from orders))")
def _(spark, sf):
    i = F.col("o_orderkey").cast("long")
    n = d.read(spark, sf, "orders").select(i.alias("id"), (i % 7).alias("have"), F.when(i % 3 != 0, i % 5).alias("total"))
    return n.select("id", "have", "total", tx.resume_plan("have", "total").alias("plan"))


@query("prj43_progress_fraction", "select i::bigint i, round(least(i * 3.0::double / greatest(i * i % 50, 1), 1), 3) share from (select o_orderkey::bigint i from orders)")
def _(spark, sf):
    i = F.col("o_orderkey").cast("long")
    return d.read(spark, sf, "orders").select(i.alias("i"), r3(tx.progress_fraction(i * 3, i * i % 50), "share"))


@query("prj44_default_names", "select way_id id, coalesce(name, ref, route, 'Unnamed Trail') as name, coalesce(highway, route, 'path') highway from (select way_id, max(v) filter (k = 'name' and v <> '') as name, null as ref, max(v) filter (k = 'waterway') route, max(v) filter (k = 'highway') highway from tags group by 1)", "tags")
def _(spark, sf):
    pairs = F.filter("tags", lambda t: (t["k"] != "sac_scale") & (t["v"] != ""))
    first = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, t: F.when(F.map_contains_key(m, t["k"]), m).otherwise(F.map_concat(m, F.create_map(F.when(t["k"] == "waterway", F.lit("route")).otherwise(t["k"]), t["v"]))))
    point = F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    elements = d.tags(spark, sf).select(F.lit("way").alias("type"), F.col("way_id").alias("id"), first.alias("tags"), F.array(point, point).alias("geometry"))
    return online.parse_elements(elements).select("id", "name", "highway")


@query("prj45_licence_header", "select doc_id, case when contains(array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), 1, 3), chr(10)), 'Licensed under') then coalesce(text, '') else 'Licensed under' || chr(10) || coalesce(text, '') end = coalesce(text, '') already from documents")
def _(spark, sf):
    body = F.coalesce("text", F.lit(""))
    return d.read(spark, sf, "documents").select("doc_id", (tx.with_licence(body, "Licensed under") == body).alias("already"))


_BLOCK = ", b as (select way_id // 8 block_id, k, v from tags)"


@query("fil01_block_prefilter", f"{_BLOCK} select block_id, bool_or(k in ('highway','waterway','natural','landuse','sac_scale','ele')) relevant, bool_or(k = 'natural' or v = 'natural') and bool_or(k = 'peak' or v = 'peak') has_peak from b group by 1", "tags")
def _(spark, sf):
    strings = F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform("tags", lambda t: F.array(t["k"], t["v"]))))))
    blocks = d.tags(spark, sf).groupBy(F.floor(F.col("way_id") / 8).alias("block_id")).agg(strings.alias("strings"))
    keys = F.array(*map(F.lit, ("highway", "waterway", "natural", "landuse", "sac_scale", "ele")))
    return blocks.select("block_id", F.arrays_overlap("strings", keys).alias("relevant"), (F.array_contains("strings", "natural") & F.array_contains("strings", "peak")).alias("has_peak"))


@query("fil02_way_keep", "select way_id, n from kept join sizes using (way_id)", "kept")
def _(spark, sf):
    return ways.keep(d.ways(spark, sf)).select("way_id", F.size("refs").cast("long").alias("n"))


@query("fil04_peaks", "select node_id, nullif(name, '') as name from pois", "pois")
def _(spark, sf):
    tags = d.peaks(spark, sf).withColumn("kind", F.lit("peak"))
    return tags.where(F.col("kind") == "peak").select("node_id", F.nullif("name", F.lit("")).alias("name"))


@query("fil05_hiking_filter", "select i from (select o_orderkey::bigint i from orders) where ['path','footway','track','residential',null][(i % 5 + 1)::int] in ('path','footway') or (['path','footway','track','residential',null][(i % 5 + 1)::int] = 'track' and regexp_matches('grade' || (i % 6)::varchar, '^grade[2-5]$')) or coalesce(case when i % 4 = 0 then 'hiking' end = 'hiking', false)")
def _(spark, sf):
    i = F.col("o_orderkey").cast("long")
    kinds = F.array(*map(F.lit, ("path", "footway", "track", "residential")), F.lit(None))
    e = d.read(spark, sf, "orders").select(i.alias("i"), F.element_at(kinds, (i % 5 + 1).cast("int")).alias("highway"), F.concat(F.lit("grade"), (i % 6).cast("string")).alias("tracktype"), F.when(i % 4 == 0, "hiking").alias("route"))
    return e.where(online.hiking_filter()).select("i")


@query("fil06_two_vertices", "select way_id id, count(*) n from line group by 1 having count(*) >= 2", "line")
def _(spark, sf):
    lines = ways.lines(d.refs(spark, sf), d.coordinates(spark, sf))
    return lines.select(F.col("way_id").alias("id"), F.size("line").cast("long").alias("n"))


@query("fil07_style_filter", "select layer, class, count(*) n from kinds where layer = 0 and class in ('path','footway','high','urgent') or layer = 1 and class <> 'river' or layer = 2 and class = 'wood' group by 1, 2", "kinds")
def _(spark, sf):
    k = ways.classify(d.tags(spark, sf))
    test = ((F.col("layer") == 0) & F.col("class").isin("path", "footway", "high", "urgent")) | ((F.col("layer") == 1) & ~(F.col("class") == "river")) | ((F.col("layer") == 2) & (F.col("class") == "wood"))
    return k.where(test).groupBy("layer", "class").agg(F.count(F.lit(1)).alias("n"))


@query("fil08_degenerate", f", q as (select way_id, pos, {_PX} px, {_PY} py, {_tx('14')} tx, {_ty('14')} ty from line), s as (select way_id, tx, ty, pos, px is distinct from lag(px) over w or py is distinct from lag(py) over w fresh from q window w as (partition by way_id, tx, ty order by pos)) select way_id, tx, ty, count(*) filter (fresh) n from s group by all having count(*) filter (fresh) >= 2", "line")
def _(spark, sf):
    from pyspark.sql import Window

    v = ways.vertices(d.refs(spark, sf), d.coordinates(spark, sf).select("node_id", "mx", "my"))
    v = v.select("way_id", "pos", geo.tile_x("mx", 14).alias("tx"), geo.tile_y("my", 14).alias("ty"), "mx", "my").withColumn("b", geo.tile_bounds(F.lit(14), "tx", "ty"))
    q = v.select("way_id", "pos", "tx", "ty", geo.quantise("mx", "b.min_x", F.lit(4096 / _E)).alias("px"), geo.quantise("my", "b.max_y", F.lit(4096 / _E), down=True).alias("py"))
    w = Window.partitionBy("way_id", "tx", "ty").orderBy("pos")
    fresh = ~(F.col("px").eqNullSafe(F.lag("px").over(w)) & F.col("py").eqNullSafe(F.lag("py").over(w)))
    return q.withColumn("fresh", fresh).where("fresh").groupBy("way_id", "tx", "ty").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("fil10_jitter", f", s as (select trip_id, seq, lng, lat, lag(lng) over w plng, lag(lat) over w plat from fixes window w as (partition by trip_id order by ts, seq)) select trip_id, seq from s where 2 * 6371000 * asin(sqrt({_HAV})) > 1", "fixes")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("trip_id").orderBy("ts", "seq")
    f = d.fixes(spark, sf).withColumns({"plng": F.lag("lng").over(w), "plat": F.lag("lat").over(w)})
    return f.where(geo.haversine_asin("plng", "plat", "lng", "lat") > 1.0).select("trip_id", "seq")


@query("fil11_contour_major", "select px, py, elev from dem where elev % 100 = 0", "dem")
def _(spark, sf):
    level = (F.col("elev") % 100 == 0).cast("int")
    return d.dem(spark, sf).withColumn("level", level).where("level >= 1").select("px", "py", "elev")




@query("fil12_job_validate", "with j as (select c_custkey::bigint id, ['ok_job-' || c_custkey::varchar, 'bad job', '', repeat('x', (c_custkey % 150)::int), 'zoom', 'ä'][(c_custkey % 6 + 1)::int] job, c_custkey * 7 % 20 a, c_custkey % 20 b from customer) select id, job, case when not regexp_full_match(job, '[A-Za-z0-9_-]{1,128}') then 'job id' when a > b then 'zoom order' end error from j")
def _(spark, sf):
    k = F.col("c_custkey").cast("long")
    names = F.array(F.concat(F.lit("ok_job-"), k.cast("string")), F.lit("bad job"), F.lit(""), F.repeat(F.lit("x"), (k % 150).cast("int")), F.lit("zoom"), F.lit("ä"))
    jobs = d.read(spark, sf, "customer").select(k.alias("id"), F.element_at(names, (k % 6 + 1).cast("int")).alias("job"), (k * 7 % 20).alias("a"), (k % 20).alias("b"))
    return jobs.select("id", "job", tx.job_error("job", "a", "b").alias("error"))


@query("fil13_chunk_guard", "select i from (select o_orderkey::bigint i from orders) where i * 997 * (i * 1009 % 100000) > 0 and i * 997 * (i * 1009 % 100000) <= 67108864")
def _(spark, sf):
    i = F.col("o_orderkey").cast("long")
    area = i * 997 * (i * 1009 % 100000)
    return d.read(spark, sf, "orders").where((area > 0) & (area <= 64 << 20)).select(i.alias("i"))


@query("fil16_glyph_ranges", "select distinct unicode(c)::bigint // 256 * 256 first from (select unnest(string_split(coalesce(text, ''), '')) c from documents) where c <> '' and unicode(c) // 256 * 256 in (0, 256, 512, 768, 7680, 8192)")
def _(spark, sf):
    codes = d.read(spark, sf, "documents").select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("c")).where("c <> ''").select((F.floor(F.ascii("c") / 256) * 256).cast("long").alias("first")).distinct()
    return codes.where(F.col("first").isin(0, 256, 512, 768, 7680, 8192))


@query("fil17_transient_errors", "select id, errno, errno in (28, 5) retry from (select event_id::bigint id, (event_id % 40)::bigint errno from events)")
def _(spark, sf):
    k = F.col("event_id").cast("long")
    return d.read(spark, sf, "events").select(k.alias("id"), (k % 40).alias("errno")).withColumn("retry", F.col("errno").isin(*tx.TRANSIENT_ERRNOS))


assert math.isclose(W, geo.HALF_WORLD_M)
