"""Queries for online questions, exports, saved rows and source-text analytics (JON, AGG, SNK, SRC, STR), with their oracles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.functions import text as tx
from tarn.operators import archive, export, online, ranking, rules, tracker, ways
from tarn.plans import derived as d
from tarn.plans.scalar_queries import _HAV, r3
from tarn.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = d.with_tables(sql, *tables)
        return f

    return add


VIEW = (47.1, 11.1, 47.25, 11.3)


@query("jon17_viewport", f"select id from trails where max_x >= {VIEW[1]} and min_x <= {VIEW[3]} and max_y >= {VIEW[0]} and min_y <= {VIEW[2]}", "trails")
def _(spark, sf):
    return online.viewport(d.trails(spark, sf), *VIEW).select("id")


def _points(spark, sf) -> DataFrame:
    return d.pois(spark, sf).select(F.col("node_id").alias("point_id")).join(d.peaks(spark, sf).select(F.col("node_id").alias("point_id"), geo.degrees_of("lon_u").alias("lng"), geo.degrees_of("lat_u").alias("lat")), "point_id")


_NEAR = f"""", pt as (select node_id point_id, cast(100 * lon_u as double) * cast(1e-9 as double) qx, cast(100 * lat_u as double) * cast(1e-9 as double) qy from peaks),
c as (select point_id, qx, qy, id, row_number() over (partition by point_id order by sqrt(pow(greatest(min_x - qx, qx - max_x, 0), 2) + pow(greatest(min_y - qy, qy - max_y, 0), 2)), id) r from pt, trails),
g as (select route_id, seq, lng ax, lat ay, lead(lng) over w bx, lead(lat) over w by_ from route_points window w as (partition by route_id order by seq)),
s as (select point_id, qx, qy, id, seq, ax, ay, bx, by_, least(greatest(coalesce(((qx - ax) * (bx - ax) + (qy - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0), 0), 1) t from c join g on route_id = id where r <= 3 and bx is not null),
h as (select point_id, id, qx plng, qy plat, ax + t * (bx - ax) lng, ay + t * (by_ - ay) lat from s),
m as (select point_id, id, min(2 * 6371000 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV})))) metres from h group by 1, 2)
select point_id, arg_min(id, (metres, id)) trail_id, round(min(metres))::bigint metres from m group by 1""".lstrip('"')


@query("jon11_nearest_trail", _NEAR, "peaks", "trails")
def _(spark, sf):
    return online.nearest(_points(spark, sf), d.trails(spark, sf)).select("point_id", "trail_id", "metres")


_CELLS = "(floor({u})::bigint)"
_DEM_TILES = "(x * 31 + y * 17 + px * 3 + py) % 5 <> 0"


def _elevation_tiles(spark, sf) -> DataFrame:
    """Pixels of elevation tiles that routes touch, some missing, with heights made from their numbers."""
    p = d.coordinates(spark, sf).select(geo.tile_pixel("lon", "lat", 14).alias("p")).select("p.*").distinct()
    kept = p.where((F.col("x") * 31 + F.col("y") * 17 + F.col("px") * 3 + F.col("py")) % 5 != 0)
    return kept.withColumn("elev", ((F.col("x") * 7 + F.col("y") * 3 + F.col("px") * 5 + F.col("py") * 11) % 900 + 400).cast("double"))


_U, _V = "((lng + 180) / 360 * 16384)", "((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384)"
_PROFILE = f", p as (select route_id, seq, lng, lat, floor({_U})::bigint x, floor({_V})::bigint y, least(greatest(floor(({_U} - floor({_U})) * 256)::bigint, 0), 255) px, least(greatest(floor(({_V} - floor({_V})) * 256)::bigint, 0), 255) py from route_points), e as (select route_id, seq, lng, lat, case when (x * 31 + y * 17 + px * 3 + py) % 5 <> 0 then ((x * 7 + y * 3 + px * 5 + py * 11) % 900 + 400)::double else 0 end elev from p)"


@query("jon07_profile_sample", f"{_PROFILE} select route_id, seq, elev from e", "route_points")
def _(spark, sf):
    return online.profile(d.route_points(spark, sf), _elevation_tiles(spark, sf))


@query("agg13_ascent", f"{_PROFILE}, s as (select route_id, elev - lag(elev) over (partition by route_id order by seq) x from e) select route_id, coalesce(sum(greatest(x, 0)), 0) ascent, coalesce(sum(greatest(-x, 0)), 0) descent from s group by 1", "route_points")
def _(spark, sf):
    return online.ascent(online.profile(d.route_points(spark, sf), _elevation_tiles(spark, sf)))


_LEN = f", s as (select *, lag(lng) over w plng, lag(lat) over w plat from route_points window w as (partition by route_id order by seq)), q as (select route_id, seq, coalesce(2 * 6371000 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))), 0) m from s)"


@query("agg12_cumulative_distance", f"{_LEN} select route_id, seq, round(sum(m) over (partition by route_id order by seq), 3) distance from q", "route_points")
def _(spark, sf):
    return ways.lengths(d.route_points(spark, sf)).select("route_id", "seq", r3("distance", "distance"))


@query("agg12_way_length", f"{_LEN} select route_id, round(sum(m), 3) metres from q group by 1", "route_points")
def _(spark, sf):
    return ways.lengths(d.route_points(spark, sf)).groupBy("route_id").agg(r3(F.max("distance"), "metres"))


@query("agg14_interpolate", f"{_LEN}, k as (select route_id, seq, sum(m) over (partition by route_id order by seq) dist, (seq * 37 % 200)::double elev, row_number() over (partition by route_id order by seq) i, count(*) over (partition by route_id) n from q), f as (select *, (i = 1 or i = n or i % 3 = 0) keep from k), w as (select *, last_value(case when keep then dist end ignore nulls) over l d0, last_value(case when keep then elev end ignore nulls) over l e0, first_value(case when keep then dist end ignore nulls) over r d1, first_value(case when keep then elev end ignore nulls) over r e1 from f window l as (partition by route_id order by seq rows between unbounded preceding and current row), r as (partition by route_id order by seq rows between current row and unbounded following)) select route_id, seq, round(case when keep then elev else e0 + coalesce((dist - d0) / nullif(d1 - d0, 0), 0) * (e1 - e0) end, 3) elev from w", "route_points")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("route_id")
    p = ways.lengths(d.route_points(spark, sf)).withColumns({"i": F.row_number().over(w.orderBy("seq")), "n": F.count(F.lit(1)).over(w)})
    p = p.select("route_id", "seq", "distance", (F.col("seq") * 37 % 200).cast("double").alias("elev"), ((F.col("i") == 1) | (F.col("i") == F.col("n")) | (F.col("i") % 3 == 0)).alias("keep"))
    return online.interpolated(p).select("route_id", "seq", r3("elev", "elev"))


@query("agg14_profile_smooth")
def _(spark, sf):
    return online.smoothed(d.route_points(spark, sf), online.profile(d.route_points(spark, sf), _elevation_tiles(spark, sf))).select("route_id", "seq", r3("elev", "elev"))


@query("agg15_min_distance", f", g as (select route_id, seq, lng ax, lat ay, lead(lng) over w bx, lead(lat) over w by_ from route_points window w as (partition by route_id order by seq)), s as (select route_id, ax, ay, bx, by_, least(greatest(coalesce(((11.25::double - ax) * (bx - ax) + (47.2::double - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0), 0), 1) t from g where bx is not null), h as (select route_id, 11.25::double plng, 47.2::double plat, ax + t * (bx - ax) lng, ay + t * (by_ - ay) lat from s) select route_id trail_id, round(min(2 * 6371000 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV})))), 3) metres from h join trails on id = route_id group by 1", "route_points", "trails")
def _(spark, sf):
    t = d.trails(spark, sf)
    chosen = t.select(F.lit(0).cast("long").alias("point_id"), F.lit(11.25).alias("lng"), F.lit(47.2).alias("lat"), F.col("id").alias("trail_id"))
    return online._on_segments(chosen, t).select("trail_id", r3("metres", "metres"))


_TRIP = f", a as (select *, sum((event in ('start', 'resume'))::int) over w segment, last_value(case when event <> 'fix' then event end ignore nulls) over w state from fixes window w as (partition by trip_id order by ts, seq rows between unbounded preceding and current row)), b as (select * from a where state in ('start', 'resume')), s as (select *, lag(lng) over v plng, lag(lat) over v plat from b where event = 'fix' window v as (partition by trip_id, segment order by ts, seq)), q as (select trip_id, segment, 2 * 6371000 * asin(sqrt({_HAV})) m from s), m as (select trip_id, segment, sum(case when m > 1 then m end) metres from q group by 1, 2), t as (select trip_id, segment, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 as seconds from b group by 1, 2)"


@query("agg16_trip_distance", f"{_TRIP} select trip_id, segment::bigint segment, round(coalesce(metres, 0), 3) metres from t left join m using (trip_id, segment)", "fixes")
def _(spark, sf):
    return online.trip_distance(d.fixes(spark, sf)).select("trip_id", "segment", r3("metres", "metres"))


@query("agg17_trip_elapsed", f"{_TRIP} select trip_id, sum(seconds)::bigint as seconds from t group by 1", "fixes")
def _(spark, sf):
    return online.trip_distance(d.fixes(spark, sf)).groupBy("trip_id").agg(F.sum("seconds").alias("seconds"))


def throttle_input(spark, sf) -> DataFrame:
    e = d.read(spark, sf, "events")
    return e.select(F.col("user_id").cast("long").alias("trip_id"), (F.col("event_id").cast("long") * 7 % 5000).alias("ms"), F.col("event_id").cast("long").alias("seq"))


@query("str05_throttle", """with recursive e as (select user_id::bigint trip_id, event_id::bigint * 7 % 5000 ms, event_id::bigint seq, row_number() over (partition by user_id order by event_id * 7 % 5000, event_id) i from events),
r(trip_id, i, ms, seq, last_ms, pass) as (select trip_id, i, ms, seq, ms, true from e where i = 1 union all
 select e.trip_id, e.i, e.ms, e.seq, case when e.ms - r.last_ms >= 120 then e.ms else r.last_ms end, e.ms - r.last_ms >= 120 from r join e on e.trip_id = r.trip_id and e.i = r.i + 1)
select trip_id, ms, seq from r where pass""")
def _(spark, sf):
    return online.throttled(throttle_input(spark, sf), "trip_id")


@query("snk14_gpx_tracks", ", t as (select trails.*, route_points.seq, route_points.lng, route_points.lat from trails join route_points on route_id = id) select id, strlen('  <trk>\n    <name>' || any_value(name) || '</name>\n    <type>' || any_value(highway) || '</type>\n    <trkseg>\n' || string_agg('      <trkpt lat=\"' || printf('%.7f', lat) || '\" lon=\"' || printf('%.7f', lng) || '\"/>', chr(10) order by seq) || '\n    </trkseg>\n  </trk>')::bigint n_bytes, count(*) points from t group by 1", "trails", "route_points")
def _(spark, sf):
    t = export.gpx_tracks(d.trails(spark, sf))
    points = F.size(F.split("track", "<trkpt")) - 1
    return t.select("id", F.octet_length("track").cast("long").alias("n_bytes"), points.cast("long").alias("points"))


@query("snk15_geojson", ", t as (select trails.id, route_points.seq, lng, lat from trails join route_points on route_id = trails.id) select id, count(*) points, round(sum(lng), 3) sx, round(sum(lat), 3) sy from t group by 1", "trails", "route_points")
def _(spark, sf):
    f = export.geojson_features(d.trails(spark, sf))
    parsed = f.select("id", F.from_json("feature", "type string, id long, geometry struct<type:string,coordinates:array<array<double>>>").alias("f"))
    c = F.col("f.geometry.coordinates")

    def total(i: int):
        return F.aggregate(c, F.lit(0.0), lambda acc, p: acc + p[i])

    return parsed.select("id", F.size(c).cast("long").alias("points"), r3(total(0), "sx"), r3(total(1), "sy"))


def _saved(spark, sf) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    return d.read(spark, sf, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("at"))


@query("srt04_saved_routes", "select o_orderkey::bigint id, row_number() over (order by o_orderdate desc, o_orderkey) place from orders")
def _(spark, sf):
    """All saved routes, newest first."""
    return ranking.numbered(_saved(spark, sf).select("id", "at"), F.desc("at"), "id").select("id", "place")


@query("snk19_route_upsert", "select o_orderkey::bigint id, case when o_orderkey % 10 = 0 then 'new' else o_orderpriority end title from orders where o_orderkey % 10 <> 3")
def _(spark, sf):
    saved = _saved(spark, sf).select("id", "title")
    new = saved.where("id % 10 = 0").select("id", F.lit("new").alias("title"))
    return export.delete(export.upsert(saved, new), saved.where("id % 10 = 3"))


@query("snk20_manifest_upsert", "select job, arg_max(state, seq) state, max(seq) seq from (select user_id::bigint job, event_type state, event_id::bigint seq from events) group by 1")
def _(spark, sf):
    e = d.read(spark, sf, "events").select(F.col("user_id").cast("long").alias("job"), F.col("event_type").alias("state"), F.col("event_id").cast("long").alias("seq"))
    return ways.latest(e, "job", "seq")


@query("src14_magic_sniff", "select page_id, case when starts_with(lower(ltrim(html)), '<!doctype') or starts_with(lower(ltrim(html)), '<html') then 'html' end kind, false valid from pages")
def _(spark, sf):
    kind = tx.payload_kind(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return d.read(spark, sf, "pages").select("page_id", kind.alias("kind"), F.coalesce(kind.isin("pbf", "tiff", "pmtiles"), F.lit(False)).alias("valid"))


#: The bytes that ranges are read of: an archive's first bytes, then digits.
RANGE_FILE = b"PMTiles" + b"0123456789" * 1000
_RANGES = "select o_orderkey::bigint id, o_orderkey * 37 % 10500 o, o_orderkey % 80 n, 'PMTiles' || repeat('0123456789', 1000) t from orders"


def _ranges(spark, sf) -> DataFrame:
    """Ranges of bytes of a file, some over its end and some beyond it."""
    k = F.col("o_orderkey").cast("long")
    asked = d.read(spark, sf, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.lit("alps")).otherwise(F.concat(F.lit("alps/"), k.cast("string"))).alias("key"), (k * 37 % 10500).alias("offset"), (k % 80).alias("length"))
    path = os.path.join(files.shared_folder(spark, "ranges"), "alps.pmtiles")
    with open(path, "wb") as f:
        f.write(RANGE_FILE)
    return files.byte_ranges(asked, {"alps": path})


@query("src18_byte_range", f"select id, length(substring(t, o + 1, n))::bigint size, sha256(substring(t, o + 1, n)) part from ({_RANGES})")
def _(spark, sf):
    return _ranges(spark, sf).select("id", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("part"))


@query("src19_registry_read", f"select case when id % 2 = 0 then 'whole' else 'below' end kind, count(*) reads, sum(length(substring(t, o + 1, n)))::bigint total_bytes from ({_RANGES}) group by 1")
def _(spark, sf):
    kind = F.when(F.col("key") == "alps", "whole").otherwise("below").alias("kind")
    return _ranges(spark, sf).groupBy(kind).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.octet_length("payload")).cast("long").alias("total_bytes"))


@query("src20_tile_or_blank", "with t as (select p_partkey::bigint id from part), e as (select distinct o_orderkey::bigint id, 'tile ' || o_orderkey::varchar payload from orders where o_orderkey % 3 = 0) select t.id, coalesce(payload, 'blank') payload from t left join e using (id)")
def _(spark, sf):
    """Tiles asked for by zoom, column and row, of an archive that has a third of them."""
    k = F.col("o_orderkey").cast("long")
    have = d.read(spark, sf, "orders").where(k % 3 == 0).select(k.alias("tile_id"), F.encode(F.concat(F.lit("tile "), k.cast("string")), "UTF-8").alias("payload"))
    path = os.path.join(files.shared_folder(spark, "tiles"), "map.pmtiles")
    archive.write_archive(have, path, (9.0, 46.0, 18.0, 49.0), {"name": "map"})
    asked = d.read(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id")).withColumn("t", geo.hilbert_tile("id")).select("id", "t.z", "t.x", "t.y")
    return archive.tiles_or_blank(asked, path, b"blank").select("id", F.decode("payload", "UTF-8").alias("payload"))


@query("src17_parse_elements", "select id, name, n from (select route_id id, count(*) n from route_points group by 1 having count(*) >= 2) join (select way_id, coalesce(name, 'Unnamed Trail') as name from kinds) on way_id = id", "route_points", "kinds")
def _(spark, sf):
    kinds = ways.classify(d.tags(spark, sf)).select("way_id", "name")
    lines = d.route_points(spark, sf).groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lon"), p["lat"].alias("lat"))).alias("geometry"))
    e = lines.join(kinds, F.col("route_id") == F.col("way_id")).select(F.lit("way").alias("type"), F.col("route_id").alias("id"), F.map_filter(F.create_map(F.lit("name"), F.col("name")), lambda k, v: v.isNotNull()).alias("tags"), "geometry")
    return online.parse_elements(e).select("id", "name", F.size("coords").cast("long").alias("n"))


@query("src25_presets", """, r as (select * from (values ('innsbruck-area', 11.1::double, 47.1::double, 11.6::double, 47.45::double), ('innsbruck-wide', 10.9::double, 47.0::double, 11.8::double, 47.5::double), ('patscherkofel', 11.35::double, 47.15::double, 11.55::double, 47.25::double)) t(region, west, south, east, north))
select region, west, south, east, north, count(node_id) nodes from r left join coordinates on lon >= west and lon <= east and lat >= south and lat <= north group by all""", "coordinates")
def _(spark, sf):
    """The catalogue, and how many nodes each region has; it is a fixed handful of boxes, so each node is tested against all."""
    c = d.coordinates(spark, sf)
    region = F.array(*(F.when(F.col("lon").between(w, e) & F.col("lat").between(s, n), F.lit(name)) for name, w, s, e, n in files.PRESETS))
    counts = c.select(F.explode(F.filter(region, lambda r: r.isNotNull())).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("nodes"))
    return files.presets(spark).join(counts, "region", "left").select("region", "west", "south", "east", "north", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"))


@query("src25_places", """, p as (select * from (values ('Innsbruck Center', 'Tyrol, Austria', 11.3908::double, 47.2757::double, 12), ('Nordkette Range', 'Alps, Austria', 11.3794::double, 47.3061::double, 13), ('Patscherkofel', 'Alps, Austria', 11.4619::double, 47.2086::double, 13)) t(name, region, lng, lat, zoom)),
t as (select *, floor((lng + 180) / 360 * pow(2, zoom))::bigint x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, zoom))::bigint y from p)
select name, t.region, lng, t.lat, zoom, x, y, count(node_id) nodes from t left join coordinates c on floor((c.lon + 180) / 360 * pow(2, zoom))::bigint = x and floor((1 - ln(tan(radians(c.lat)) + 1 / cos(radians(c.lat))) / pi()) / 2 * pow(2, zoom))::bigint = y group by all""", "coordinates")
def _(spark, sf):
    """The places, their tiles, and how many nodes lie in those."""
    p = files.places(spark).withColumns({"x": geo.lonlat_tile_x(F.col("lng"), F.col("zoom")), "y": geo.lonlat_tile_y(F.col("lat"), F.col("zoom"))})
    zooms = sorted({place[4] for place in files.PLACES})
    c = d.coordinates(spark, sf).select(F.explode(F.array(*(F.struct(F.lit(z).alias("zoom"), geo.lonlat_tile_x(F.col("lon"), z).alias("x"), geo.lonlat_tile_y(F.col("lat"), z).alias("y")) for z in zooms))).alias("t")).groupBy("t.zoom", "t.x", "t.y").agg(F.count(F.lit(1)).alias("nodes"))
    return p.join(c, ["zoom", "x", "y"], "left").select("name", "region", "lng", "lat", "zoom", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"))


_RE = r"(?://|#)"
_TAGS = (
    rf", g as (select path, line, text, case when regexp_matches(text, '{_RE}\s*DEBT\((D\d{{3,}})\):\s*(.+?)\s+(?:—|--)\s+platforms:\s*([a-z, ]+)\s*$') then 'debt' when regexp_matches(text, '{_RE}\s*BUG\((B\d{{3,}})\):\s*(.+?)\s+(?:—|--)\s+severity:\s*(\w+)\s+(?:—|--)\s+repro:\s*(.+)\s*$') then 'bug' when regexp_matches(text, '{_RE}\s*RULE-EXEMPT\(([PR]\d+[a-z]?)\):\s*(\S.*)\s*$') then 'exempt' else 'malformed' end kind from source_lines where regexp_matches(text, '{_RE}.*\b(DEBT|BUG|RULE-EXEMPT)\('))"
    r", tg as (select path, line, kind, regexp_extract(text, '\(([A-Z]\d+[a-z]?)\)', 1) id, trim(regexp_extract(text, '\):\s*(.+?)(?:\s+(?:—|--)\s+|$)', 1)) description, case kind when 'debt' then regexp_extract(text, 'platforms:\s*(.*?)\s*$', 1) when 'bug' then regexp_extract(text, 'severity:\s*(\w+)', 1) end detail from g)"
)


@query("src26_source_lines", "select path, count(*) n, max(line)::bigint last_line from source_lines where path not like 'core/%' group by 1", "source_lines")
def _(spark, sf):
    return d.source_lines(spark, sf).where(~F.col("path").startswith("core/")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("line").cast("long").alias("last_line"))


@query("agg20_tag_inventory", f"{_TAGS}, v as (select *, first_value(description) over w d0, first_value(detail) over w t0 from tg where kind in ('debt', 'bug') window w as (partition by kind, id order by path, line)) select kind, id, any_value(d0) description, any_value(t0) detail, count(*) filter (description = d0 and detail = t0) sites, count(*) filter (not (description = d0 and detail = t0)) conflicts from v group by 1, 2", "source_lines")
def _(spark, sf):
    i = tracker.inventory(tracker.tags(d.source_lines(spark, sf)))
    return i.select("kind", "id", "description", "detail", "sites", "conflicts")


@query("jon10_missing_mirrors", f"{_TAGS}, p as (select distinct id, unnest(string_split(detail, ',')) platform from tg where kind = 'debt'), s as (select distinct id, case when path like 'ios/%' then 'ios' when path like 'android/%' then 'android' when path like 'src/%' then 'web' else 'core' end platform from tg where kind = 'debt') select id, platform from p anti join s using (id, platform)", "source_lines")
def _(spark, sf):
    return tracker.missing_mirrors(tracker.tags(d.source_lines(spark, sf)))


_RULES = [("R1", "DEBT|the .* the", ["ios/**", "src/*.ts"]), ("R2", "idiot|moron", ["**"])]
_VIOL = f"{_TAGS}, r as (select 'R1' rule, path, line from source_lines where regexp_matches(text, 'DEBT|the .* the') and (path like 'ios/%' or regexp_matches(path, '^src/[^/]*\\.ts$')) and not regexp_matches(text, 'RULE-EXEMPT\\(([PR]\\d+[a-z]?)\\):') union all select 'R2', path, line from source_lines where regexp_matches(text, 'idiot|moron') and not regexp_matches(text, 'RULE-EXEMPT\\(([PR]\\d+[a-z]?)\\):')), x as (select id, path, unnest([line, line + 1]) line from tg where kind = 'exempt')"


@query("jon08_rule_violations", f"{_VIOL} select rule, path, line from r where not exists (select 1 from x where x.id = r.rule and x.path = r.path and x.line = r.line)", "source_lines")
def _(spark, sf):
    return tracker.violations(d.source_lines(spark, sf), _RULES)


_ITEM_RULES = rf", iw as (select item_id, regexp_extract_all(text, '[a-z]{{3,}}') w from benchmark), ir as (select 'I' || item_id rule, w[1] || ' ' || w[2] || '|' || w[3] || ' .*' || w[4] pattern, item_id % 2 = 0 everywhere from iw where len(w) >= 4)"


@query("jon08_rule_table", f"{_TAGS}{_ITEM_RULES} select distinct rule, path, line::bigint line from source_lines, ir where regexp_matches(text, pattern) and (everywhere or path like 'ios/%' or regexp_matches(path, '^src/[^/]*\\.ts$')) and not regexp_matches(text, 'RULE-EXEMPT\\(([PR]\\d+[a-z]?)\\):')", "source_lines")
def _(spark, sf):
    """A rule for each benchmark item: two of its words side by side, or two others in one line."""
    w = F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))
    items = d.read(spark, sf, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 4)
    pattern = F.concat(F.col("w")[0], F.lit(" "), F.col("w")[1], F.lit("|"), F.col("w")[2], F.lit(" .*"), F.col("w")[3])
    globs = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("**"))).otherwise(F.array(F.lit("ios/**"), F.lit("src/*.ts")))
    table = items.select(F.concat(F.lit("I"), F.col("item_id").cast("string")).alias("rule"), pattern.alias("pattern"), globs.alias("globs"))
    return rules.violations(d.source_lines(spark, sf), table)


@query("fil15_forbidden_patterns", f"{_VIOL} select rule, count(*) n from r group by 1", "source_lines")
def _(spark, sf):
    lines = d.source_lines(spark, sf)
    none = tracker.tags(lines).where(F.lit(False))
    return tracker.violations(lines, _RULES, none).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("jon09_exemptions", f"{_VIOL} select rule, path, line from r where exists (select 1 from x where x.id = r.rule and x.path = r.path and x.line = r.line)", "source_lines")
def _(spark, sf):
    lines = d.source_lines(spark, sf)
    found = tracker.tags(lines)
    every = tracker.violations(lines, _RULES, found.where(F.lit(False)))
    return every.join(tracker.violations(lines, _RULES, found), ["rule", "path", "line"], "left_anti")


@query("jon16_unburied", "select 'B' || lpad(i::varchar, 3, '0') id from range(60) t(i) where i % 10 <> 2 and i % 7 <> 0 or (i >= 40 and i % 7 <> 0)")
def _(spark, sf):
    number = F.concat(F.lit("B"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("id")
    tracked = spark.range(60).select(number)
    live = tracker.tags(d.source_lines(spark, sf)).where("kind = 'bug'").select("id").distinct()
    return tracker.unburied(tracked, live, spark.range(60).where("id % 7 = 0").select(number))


@query("snk22_report", None)
def _(spark, sf):
    return tracker.report(tracker.tags(d.source_lines(spark, sf)))


@query("geo13_shortest_path")
def _(spark, sf):
    """Costs from one node to all others over the road graph of consecutive way nodes."""
    p = d.route_points(spark, sf).join(d.refs(spark, sf).select(F.col("way_id").alias("route_id"), F.posexplode("refs").alias("seq", "node_id")), ["route_id", "seq"])
    s = ways.with_previous(p, "route_id", "seq", "node_id", "lng", "lat").where("prev_node_id is not null and prev_node_id <> node_id")
    edges = s.select(F.col("prev_node_id").alias("a"), F.col("node_id").alias("b"), geo.haversine("prev_lng", "prev_lat", "lng", "lat").alias("cost"))
    sources = spark.createDataFrame([(0, 1)], "source long, node long")
    return online.shortest_paths(edges, sources).select("source", "node", r3("cost", "cost"))


_CLASSES = ("path", "footway", "track", "steps", "primary", "motorway", "residential", "cycleway")


def _cost_sql() -> str:
    parts = []
    for profile, (usual, own) in online.PROFILES.items():
        cases = " ".join(f"when '{k}' then {'null' if v is None else f'm * {3.6 / v!r}'}" for k, v in own.items())
        parts.append(f"select '{profile}' profile, route_id, case kind {cases} else m * {3.6 / usual!r} end c from st")
    kinds = ", ".join(f"'{c}'" for c in _CLASSES)
    return f"{_LEN}, st as (select route_id, [{kinds}][(route_id % {len(_CLASSES)} + 1)::int] kind, m from q where seq > 0), u as ({' union all '.join(parts)}) select profile, count(c) taken, round(sum(c), 1) as seconds from u group by 1"


@query("geo13_edge_costs", _cost_sql(), "route_points")
def _(spark, sf):
    """Steps of all routes, on ways of one class each: how many every profile takes, and how long they are for it."""
    s = ways.with_previous(ways.lengths(d.route_points(spark, sf)), "route_id", "seq", "distance").where("seq > 0")
    kind = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("route_id") % len(_CLASSES) + 1).cast("int"))
    metres = F.col("distance") - F.coalesce("prev_distance", F.lit(0.0))
    costs = s.select(F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), online.edge_cost(metres, kind, p).alias("c")) for p in online.PROFILES))).alias("x")).select("x.*")
    return costs.groupBy("profile").agg(F.count("c").alias("taken"), F.round(F.sum("c"), 1).alias("seconds"))


@query("geo14_cell_index", "select cx, cy, count(*) n from (select id, cx, unnest(range(floor(min_y / 0.05::double)::bigint, floor(max_y / 0.05::double)::bigint + 1)) cy from (select id, min_y, max_y, unnest(range(floor(min_x / 0.05::double)::bigint, floor(max_x / 0.05::double)::bigint + 1)) cx from trails)) group by 1, 2", "trails")
def _(spark, sf):
    boxes = d.trails(spark, sf).select(F.col("id").alias("trail_id"), "min_x", "min_y", "max_x", "max_y")
    return online.cell_index(boxes, 0.05).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
