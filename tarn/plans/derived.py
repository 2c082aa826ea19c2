"""Map-data tables derived from the star-schema tables by integer arithmetic, so that queries have data at any scale.

Each table is given twice: as a DataFrame, and as a DuckDB common table expression of the same name for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import geo

LON0, LAT0 = 110_000_000, 470_000_000
#: The raster that the elevation queries use: a part is a pixel of 0.01 degrees, 50 in a row; a ramp with some pixels missing.
DEM_COLS, DEM_WEST, DEM_NORTH, DEM_STEP = 50, 11.0, 47.5, 0.01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(key: str, lon_step: int, lat_step: int):
    k = F.col(key).cast("long")
    return (F.lit(LON0).cast("long") + (k * lon_step % 500_000) * 10).alias("lon_u"), (F.lit(LAT0).cast("long") + (k * lat_step % 400_000) * 10).alias("lat_u")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lon_u, lat_u (1e-7 degrees); some ids are missing."""
    k = F.col("p_partkey").cast("long")
    return read(spark, sf_dir, "part").where(k % 17 != 0).select(k.alias("node_id"), *_units("p_partkey", 7919, 104729))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.degrees_of("lon_u"), geo.degrees_of("lat_u")
    return nodes(spark, sf_dir).select("node_id", lon.alias("lon"), lat.alias("lat"), geo.mercator_x(lon).alias("mx"), geo.mercator_y(lat).alias("my"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, refs in order; keys that repeat stay."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("long").alias("k"))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("way_id")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["k"]).alias("refs"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, tags: key and value pairs in order, keys repeating on some ways."""
    k = F.col("o_orderkey").cast("long")
    key = F.element_at(F.array(*map(F.lit, ("highway", "waterway", "natural", "landuse", "building"))), (k % 5 + 1).cast("int"))
    value = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", ""))

    def pair(a, b):
        return F.struct(a.alias("k"), b.alias("v"))

    none = F.array().cast("array<struct<k:string,v:string>>")
    return read(spark, sf_dir, "orders").select(
        k.alias("way_id"),
        F.concat(
            F.array(pair(key, value)),
            F.when(k % 11 == 0, F.array(pair(F.lit("natural"), F.lit("wood")))).otherwise(none),
            F.when(k % 7 == 0, F.array(pair(F.lit("sac_scale"), F.lit("hiking")))).otherwise(none),
            F.when(k % 14 == 0, F.array(pair(F.lit("sac_scale"), F.lit("alpine_hiking")))).otherwise(none),
            F.when(k % 3 == 0, F.array(pair(F.lit("name"), F.concat(F.lit("Way "), k.cast("string"))))).otherwise(none),
            F.when(k % 33 == 0, F.array(pair(F.lit("name"), F.lit("")))).otherwise(none),
        ).alias("tags"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, refs, tags."""
    return refs(spark, sf_dir).join(tags(spark, sf_dir), "way_id")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lon_u, lat_u, name ('' for every fifth)."""
    k = F.col("s_suppkey").cast("long")
    name = F.when(k % 5 == 0, F.lit("")).otherwise(F.col("s_name"))
    return read(spark, sf_dir, "supplier").select((k + 10_000_000).alias("node_id"), *_units("s_suppkey", 15485, 32452), name.alias("name"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.degrees_of("lon_u"), geo.degrees_of("lat_u")
    return peaks(spark, sf_dir).select("node_id", geo.mercator_x(lon).alias("mx"), geo.mercator_y(lat).alias("my"), "name")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, ts, event (start, pause, resume, fix), lng, lat, accuracy."""
    i = F.col("event_id").cast("long")
    event = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "pause").when(F.col("event_type") == "error", "resume").otherwise("fix")
    lng = F.lit(11.3) + (i * 7 % 1000).cast("double") * 0.00001
    lat = F.lit(47.2) + (i * 13 % 1000).cast("double") * 0.00001
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("trip_id"), F.col("ts").cast("timestamp").alias("ts"), i.alias("seq"), event.alias("event"), lng.alias("lng"), lat.alias("lat"), F.col("value").alias("accuracy"))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, py, elev; null where the raster has no data."""
    i = F.col("p_partkey").cast("long")
    px, py = (i % DEM_COLS).cast("int"), F.floor(i / DEM_COLS).cast("int")
    elev = F.when((i % 97) != 0, 500.0 + px * 10.0 + py * 5.0)
    return read(spark, sf_dir, "part").select(px.alias("px"), py.alias("py"), elev.alias("elev"))


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, seq, lng, lat: the nodes of each way in order."""
    at = F.posexplode("refs").alias("seq", "node_id")
    walked = refs(spark, sf_dir).select(F.col("way_id").alias("route_id"), at)
    return walked.join(coordinates(spark, sf_dir).select("node_id", "lon", "lat"), "node_id").select("route_id", "seq", F.col("lon").alias("lng"), "lat")


def trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, highway, coords and bbox of ways of the highway layer with two vertices at least."""
    from tarn.operators.ways import classify

    kinds = classify(tags(spark, sf_dir)).where("layer = 0").select("way_id", "class", "name")
    lines = route_points(spark, sf_dir).groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("coords"))
    joined = lines.where(F.size("coords") >= 2).join(kinds, F.col("route_id") == F.col("way_id"))

    def edge(f, c):
        return f(F.transform("coords", lambda p: p[c]))

    return joined.select(F.col("route_id").alias("id"), F.coalesce("name", F.lit("Unnamed Trail")).alias("name"), F.col("class").alias("highway"), "coords", edge(F.array_min, "lng").alias("min_x"), edge(F.array_min, "lat").alias("min_y"), edge(F.array_max, "lng").alias("max_x"), edge(F.array_max, "lat").alias("max_y"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, text: documents' lines as those of source files, some with the tags that the tracker reads."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    d = F.col("doc_id")
    first = F.col("pos") == 0
    number = F.lpad((d % 40).cast("string"), 3, "0")
    text = (
        F.when(first & (d % 10 == 1), F.concat(F.lit("// DEBT(D"), number, F.lit("): debt "), F.when(d % 160 == 1, F.lit("other")).otherwise(number), F.lit(" -- platforms: ios,web")))
        .when(first & (d % 10 == 2), F.concat(F.lit("# BUG(B"), number, F.lit("): bug "), number, F.lit(" -- severity: major -- repro: open it")))
        .when(first & (d % 10 == 3), F.lit("// RULE-EXEMPT(R1): known"))
        .otherwise(F.col("text"))
    )
    folder = F.element_at(F.array(*map(F.lit, ("ios", "android", "src", "core"))), (d % 4 + 1).cast("int"))
    return docs.select(F.concat(folder, F.lit("/f"), d.cast("string"), F.lit(".ts")).alias("path"), (F.col("pos") + 1).alias("line"), text.alias("text"))


#: The same tables for DuckDB.
_M = "6378137.0 * radians({lon})", "6378137.0 * ln(tan(pi() / 4 + radians(greatest(least({lat}, 85.051128779806592), -85.051128779806592)) / 2))"
_DEG = "cast(100 * {u} as double) * cast(1e-9 as double)"
_HWAY = "lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g'))"

CTE: dict[str, str] = {
    "nodes": f"select p_partkey::bigint node_id, {LON0}::bigint + (p_partkey::bigint * 7919 % 500000) * 10 lon_u, {LAT0}::bigint + (p_partkey::bigint * 104729 % 400000) * 10 lat_u from part where p_partkey % 17 <> 0",
    "coordinates": f"select node_id, lon, lat, {_M[0].format(lon='lon')} mx, {_M[1].format(lat='lat')} my from (select node_id, {_DEG.format(u='lon_u')} lon, {_DEG.format(u='lat_u')} lat from nodes)",
    "refs": "select l_orderkey::bigint way_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1)::integer pos, l_partkey::bigint node_id from lineitem",
    "tags": f"""select o_orderkey::bigint way_id, unnest(ps).i i, unnest(ps).k k, unnest(ps).v v from (select o_orderkey, list_filter([
 {{'i': 1, 'k': ['highway','waterway','natural','landuse','building'][(o_orderkey % 5 + 1)::int], 'v': {_HWAY}, 'ok': true}},
 {{'i': 2, 'k': 'natural', 'v': 'wood', 'ok': o_orderkey % 11 = 0}},
 {{'i': 3, 'k': 'sac_scale', 'v': 'hiking', 'ok': o_orderkey % 7 = 0}},
 {{'i': 4, 'k': 'sac_scale', 'v': 'alpine_hiking', 'ok': o_orderkey % 14 = 0}},
 {{'i': 5, 'k': 'name', 'v': 'Way ' || o_orderkey::varchar, 'ok': o_orderkey % 3 = 0}},
 {{'i': 6, 'k': 'name', 'v': '', 'ok': o_orderkey % 33 = 0}}], lambda x: x.ok) ps from orders)""",
    "kinds": """select way_id, layer, class, case when layer = 0 then sac_scale end sac_scale, nullif(name, '') as name from (
 select way_id, arg_min(case k when 'highway' then 0 when 'waterway' then 1 when 'natural' then 2 else 3 end, (case k when 'highway' then 0 when 'waterway' then 1 when 'natural' then 2 else 3 end) * 100 + i) filter (k in ('highway','waterway','natural','landuse')) layer,
  arg_min(v, (case k when 'highway' then 0 when 'waterway' then 1 when 'natural' then 2 else 3 end) * 100 + i) filter (k in ('highway','waterway','natural','landuse')) class,
  arg_max(v, i) filter (k = 'sac_scale') sac_scale, arg_max(v, i) filter (k = 'name') as name from tags group by 1) where layer is not null""",
    "sizes": "select way_id, count(*) n from refs group by 1",
    "kept": "select kinds.* from kinds join sizes using (way_id) where n >= 2",
    "line": "select way_id, pos, node_id, mx, my, lon, lat, row_number() over (partition by way_id order by pos) k, count(*) over (partition by way_id) n from refs join coordinates using (node_id)",
    "peaks": f"select s_suppkey::bigint + 10000000 node_id, {LON0}::bigint + (s_suppkey::bigint * 15485 % 500000) * 10 lon_u, {LAT0}::bigint + (s_suppkey::bigint * 32452 % 400000) * 10 lat_u, case when s_suppkey % 5 = 0 then '' else s_name end as name from supplier",
    "pois": f"select node_id, {_M[0].format(lon='lon')} mx, {_M[1].format(lat='lat')} my, name from (select node_id, {_DEG.format(u='lon_u')} lon, {_DEG.format(u='lat_u')} lat, name from peaks)",
    "fixes": "select user_id::bigint trip_id, ts, event_id::bigint seq, case event_type when 'signup' then 'start' when 'purchase' then 'pause' when 'error' then 'resume' else 'fix' end event, cast(11.3 as double) + (event_id::bigint * 7 % 1000)::double * cast(0.00001 as double) lng, cast(47.2 as double) + (event_id::bigint * 13 % 1000)::double * cast(0.00001 as double) lat, value accuracy from events",
    "dem": f"select (i % {DEM_COLS})::integer px, (i // {DEM_COLS})::integer py, case when i % 97 <> 0 then 500.0::double + (i % {DEM_COLS}) * 10 + (i // {DEM_COLS}) * 5 end elev from (select p_partkey::bigint i from part)",
    "route_points": "select way_id route_id, pos seq, lon lng, lat from refs join coordinates using (node_id)",
    "trails": "select way_id id, coalesce(name, 'Unnamed Trail') as name, class highway, min_x, min_y, max_x, max_y from kinds join (select route_id, min(lng) min_x, min(lat) min_y, max(lng) max_x, max(lat) max_y from route_points group by 1 having count(*) >= 2) on route_id = way_id where layer = 0",
    "source_lines": r"""select ['ios','android','src','core'][(doc_id % 4 + 1)::int] || '/f' || doc_id::varchar || '.ts' path, (pos + 1)::integer line,
 case when pos = 0 and doc_id % 10 = 1 then '// DEBT(D' || nr || '): debt ' || case when doc_id % 160 = 1 then 'other' else nr end || ' -- platforms: ios,web'
  when pos = 0 and doc_id % 10 = 2 then '# BUG(B' || nr || '): bug ' || nr || ' -- severity: major -- repro: open it'
  when pos = 0 and doc_id % 10 = 3 then '// RULE-EXEMPT(R1): known' else t end as text
 from (select doc_id, lpad((doc_id % 40)::varchar, 3, '0') nr, unnest(string_split(coalesce(text, ''), chr(10))) t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 pos from documents)""",
}
_NEEDS = {"coordinates": ("nodes",), "kinds": ("tags",), "sizes": ("refs",), "kept": ("kinds", "sizes"), "line": ("refs", "coordinates"), "pois": ("peaks",), "route_points": ("refs", "coordinates"), "trails": ("kinds", "route_points")}


def with_tables(body: str, *names: str) -> str:
    """SQL with the named tables, and what they need, put before it; ``body`` may go on with more tables after a comma."""
    order: list[str] = []

    def add(n: str) -> None:
        for need in _NEEDS.get(n, ()):
            add(need)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ", ".join(f"{n} as ({CTE[n]})" for n in order)
    body = body.strip()
    if body.startswith(","):
        return f"with {ctes}{body}"
    return f"with {ctes} {body}" if ctes else body
