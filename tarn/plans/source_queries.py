"""Queries that write the derived tables in the engine's file formats, or stream them, and read them back (SRC, STR)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators import export, features, online, terrain, ways
from tarn.operators.extract import write_extract
from tarn.plans import compile as compiler
from tarn.plans import derived as d
from tarn.plans.online_queries import _TRIP, VIEW
from tarn.plans.scalar_queries import r3, svg_paths
from tarn.sources import geotiff, pbf
from tarn.sources.files import shared_folder
from tarn.streaming import trips

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = d.with_tables(sql, *tables)
        return f

    return add


def extract(spark, sf) -> str:
    """An extract of the derived nodes, peaks and ways, whose blocks tasks have written."""
    path = os.path.join(shared_folder(spark, "extract"), "map.osm.pbf")
    none = F.array().cast("array<struct<k:string,v:string>>")
    peak = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("natural", F.lit("peak")), ("name", F.col("name")))))
    nodes = d.nodes(spark, sf).select("node_id", "lon_u", "lat_u", none.alias("tags"))
    peaks = d.peaks(spark, sf).select("node_id", "lon_u", "lat_u", peak.alias("tags"))
    write_extract(path, nodes, peaks, d.ways(spark, sf).select("way_id", "refs", "tags"))
    return path


def view(spark, sf, name: str) -> DataFrame:
    spark.dataSource.register(pbf.PbfSource)
    return spark.read.format("osmpbf").option("view", name).load(extract(spark, sf))


@query("src02_pbf_blocks", "select 'OSMData' kind, (select ceil(count(*) / 8000.0) from nodes)::bigint + (select ceil(count(*) / 8000.0) from peaks)::bigint + (select ceil(count(*) / 8000.0) from sizes)::bigint n union all select 'OSMHeader', 1", "nodes", "peaks", "sizes")
def _(spark, sf):
    return view(spark, sf, "blocks").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("src04_pbf_relevant", "select (select ceil(count(*) / 8000.0) from peaks)::bigint peaks, (select ceil(count(*) / 8000.0) from sizes)::bigint + (select ceil(count(*) / 8000.0) from peaks)::bigint relevant", "peaks", "sizes")
def _(spark, sf):
    return view(spark, sf, "blocks").agg(F.count(F.when(F.col("has_peaks"), 1)).alias("peaks"), F.count(F.when(F.col("relevant"), 1)).alias("relevant"))


@query("src06_pbf_nodes", "select node_id, lon_u, lat_u from nodes union all select node_id, lon_u, lat_u from peaks", "nodes", "peaks")
def _(spark, sf):
    return view(spark, sf, "nodes").select("node_id", F.round(F.col("lon") * 1e7).cast("long").alias("lon_u"), F.round(F.col("lat") * 1e7).cast("long").alias("lat_u"))


@query("src07_pbf_ways", "select way_id, n, layer, class, sac_scale, name as name from kept join sizes using (way_id)", "kept")
def _(spark, sf):
    kept = ways.keep(view(spark, sf, "ways").select("way_id", "refs", "tags"))
    return kept.select("way_id", F.size("refs").cast("long").alias("n"), "layer", "class", "sac_scale", "name")


@query("src08_pbf_peaks", "select node_id, lon_u, nullif(name, '') as name from peaks", "peaks")
def _(spark, sf):
    return view(spark, sf, "peaks").select("node_id", F.round(F.col("lon") * 1e7).cast("long").alias("lon_u"), F.nullif("name", F.lit("")).alias("name"))


def raster(spark, sf) -> str:
    """The path of the elevation raster as a GeoTIFF that tasks have written."""
    path = os.path.join(shared_folder(spark, "raster"), "dem.tif")
    terrain.write_raster(d.dem(spark, sf), path, terrain.Affine(d.DEM_WEST, d.DEM_NORTH, d.DEM_STEP, d.DEM_STEP), nodata=9999)
    return path


@query("src11_geotiff_scan", "select px, py, elev::float elev from dem", "dem")
def _(spark, sf):
    spark.dataSource.register(geotiff.GeoTiffSource)
    return spark.read.format("geotiff").load(raster(spark, sf))


@query("src12_raster_metadata", f"select max(px) + 1::bigint width, max(py) + 1::bigint height, ((max(px) + 16) // 16 * ((max(py) + 16) // 16))::bigint chunks, {d.DEM_WEST}::double west, {d.DEM_NORTH}::double north from dem", "dem")
def _(spark, sf):
    r = geotiff.describe(geotiff._reader(raster(spark, sf)))
    return spark.createDataFrame([(r.width, r.height, len(r.offsets), float(r.west), float(r.north))], "width long, height long, chunks long, west double, north double")


@query(
    "src24_feature_read",
    "select id, case when id % 5 = 0 then 'Unnamed Trail' else name end name, case when id % 3 = 0 then 'path' else highway end highway, n, min_x, min_y, max_x, max_y from trails join (select way_id, count(*) n from line group by 1) on way_id = id where id % 7 <> 0",
    "trails",
    "line",
)
def _(spark, sf):
    """Features as a file holds them: some without a name or class, some that are no lines."""
    folder, k = f"file://{shared_folder(spark, 'features')}", F.col("id")
    t = d.trails(spark, sf)
    raw = t.select("id", F.when(k % 5 == 0, F.when(k % 2 == 0, "")).otherwise(F.col("name")).alias("name"), F.when(k % 3 != 0, F.col("highway")).alias("highway"), F.when(k % 7 == 0, "Point").otherwise("LineString").alias("type"), "coords")
    raw.write.parquet(f"{folder}/features")
    return export.load_features(spark, folder).select("id", "name", "highway", F.size("coords").cast("long").alias("n"), "min_x", "min_y", "max_x", "max_y")


@query("snk16_feature_index", "select cx, cy, count(*) n, min(id) first_id from (select id, cx, unnest(range(floor(min_y / 0.05::double)::bigint, floor(max_y / 0.05::double)::bigint + 1)) cy from (select id, min_y, max_y, unnest(range(floor(min_x / 0.05::double)::bigint, floor(max_x / 0.05::double)::bigint + 1)) cx from trails)) group by 1, 2", "trails")
def _(spark, sf):
    """The index that is kept beside saved features, joined with them again."""
    folder = f"file://{shared_folder(spark, 'features')}"
    export.save_features(d.trails(spark, sf), folder)
    index = spark.read.parquet(f"{folder}/index").join(export.load_features(spark, folder).select(F.col("id").alias("trail_id")), "trail_id")
    return index.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("trail_id").alias("first_id"))


@query("str01_sliced_pass", "select node_id, round(mx, 3) mx, round(my, 3) my from coordinates union all select node_id, round(mx, 3), round(my, 3) from pois", "coordinates", "pois")
def _(spark, sf):
    """The first pass over an extract, a block a slice, stopped after each and gone on with until it is done."""
    spark.dataSource.register(pbf.PbfSource)
    job = compiler.Job("sliced", extract(spark, sf), shared_folder(spark, "job"), (11.0, 47.0, 11.5, 47.4), slice_blocks=1)
    while not compiler.run_slices(spark, job, "Pass1Nodes", lambda: True):
        pass
    return spark.read.parquet(os.path.join(job.folder(), "Pass1Nodes")).select("node_id", r3("mx", "mx"), r3("my", "my"))


def _feature_file(spark, sf) -> str:
    """The path of all trails as an indexed feature file."""
    path = os.path.join(shared_folder(spark, "features"), "trails.fgb")
    features.write_features(d.trails(spark, sf), path)
    return path


@query("src24_feature_file", "select id, name, highway, n, min_x, min_y, max_x, max_y from trails join (select way_id, count(*) n from line group by 1) on way_id = id", "trails", "line")
def _(spark, sf):
    """Trails through the binary file and back."""
    t = features.read_features(spark, _feature_file(spark, sf))
    return t.select("id", "name", "highway", F.size("coords").cast("long").alias("n"), *("min_x", "min_y", "max_x", "max_y"))


@query("jon17_feature_box", f"select id, name from trails where max_x >= {VIEW[1]} and min_x <= {VIEW[3]} and max_y >= {VIEW[0]} and min_y <= {VIEW[2]}", "trails")
def _(spark, sf):
    """Trails of a view; the filter goes down the file's tree."""
    return online.viewport(features.read_features(spark, _feature_file(spark, sf)), *VIEW).select("id", "name")


@query("str04_gps_stream", f"{_TRIP} select trip_id, segment::bigint segment, round(metres, 3) metres from m join (select trip_id, segment, count(*) k from q group by 1, 2) using (trip_id, segment) where metres is not null", "fixes")
def _(spark, sf):
    folder = shared_folder(spark, "fixes")
    d.fixes(spark, sf).repartition(1).sortWithinPartitions("ts", "seq").write.parquet(f"file://{folder}/in")
    updates = trips.trip_updates(spark.readStream.schema(trips.FIXES).parquet(f"file://{folder}/in"))

    def keep(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"file://{folder}/out/slice={number}")

    updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"file://{folder}/out")
    last = ways.latest(found.select(F.struct("trip_id", "segment").alias("k"), "batch", "fixes", "metres"), "k", "batch", "fixes")
    return last.where("metres > 0").select("k.trip_id", "k.segment", r3("metres", "metres"))


@query("str09_job_states")
def _(spark, sf):
    e = d.read(spark, sf, "events")
    name = F.element_at(F.array(*map(F.lit, ("enqueue", "yield", "finish", "fail", "acknowledge"))), (F.col("event_id") % 5 + 1).cast("int"))
    return trips.job_states(e.select(F.col("user_id").cast("long").alias("job_id"), F.col("event_id").cast("long").alias("seq"), name.alias("event")))


@query("prj33_svg_paths")
def _(spark, sf):
    elev = (F.lit(500) + F.col("seq") * 7 % 40 + F.col("route_id") % 11).cast("double")
    return svg_paths(d.route_points(spark, sf).select("route_id", "seq", elev.alias("elev"))).select("route_id", F.length("line").alias("n_line"), F.length("area").alias("n_area"))


@query("geo09_window_rgb")
def _(spark, sf):
    """The raster's first window as one padded tile of colours: how many pixels have each code."""
    pixels = spark.range(256 * 256).select((F.col("id") % 256).cast("int").alias("px"), F.floor(F.col("id") / 256).cast("int").alias("py"))
    elev = F.coalesce("elev", F.lit(0.0)).alias("elev")
    window = pixels.join(d.dem(spark, sf), ["px", "py"], "left").select(geo.terrain_rgb(elev).alias("c"))
    code = (F.col("c.r") * 65536 + F.col("c.g") * 256 + F.col("c.b")).cast("long").alias("code")
    return window.groupBy(code).agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["geo09_window_rgb"] = d.with_tables(", c as (select round((coalesce(elev, 0) + 10000) * 10)::bigint code from dem where px < 256 and py < 256) select code, sum(n)::bigint n from (select code, count(*) n from c group by 1 union all select 100000, 65536 - count(*) from c) where n > 0 group by 1", "dem")



@query("jon11_nearest_exact")
def _(spark, sf):
    from tarn.plans.online_queries import _points

    return online.nearest(_points(spark, sf), d.trails(spark, sf), exact=True)
