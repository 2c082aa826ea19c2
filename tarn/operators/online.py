"""Questions over finished data: nearest trail, viewport, elevation profiles, trips, routes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators import kernels
from tarn.operators.ways import lengths, with_previous
from tarn.sources.files import checkpoint_folder


def parse_elements(elements: DataFrame) -> DataFrame:
    """Trails of a map-data response: elements (type, id, tags map, geometry array of lon, lat) that are ways of two vertices or more."""
    t = F.col("tags")

    def tag(*keys, default):
        return F.coalesce(*(F.try_element_at(t, F.lit(k)) for k in keys), F.lit(default))

    lng, lat = F.transform("geometry", lambda p: p["lon"]), F.transform("geometry", lambda p: p["lat"])
    return elements.where((F.col("type") == "way") & (F.size("geometry") >= 2)).select(
        "id",
        tag("name", "ref", "route", default="Unnamed Trail").alias("name"),
        tag("highway", "route", default="path").alias("highway"),
        F.transform("geometry", lambda p: F.struct(p["lon"].alias("lng"), p["lat"].alias("lat"))).alias("coords"),
        F.array_min(lng).alias("min_x"),
        F.array_min(lat).alias("min_y"),
        F.array_max(lng).alias("max_x"),
        F.array_max(lat).alias("max_y"),
    )


def hiking_filter():
    """Tags of hiking ways: paths, footways, rougher tracks and hiking routes.  Columns highway, tracktype, route."""
    return F.coalesce(F.col("highway").isin("path", "footway"), F.lit(False)) | F.coalesce((F.col("highway") == "track") & F.col("tracktype").rlike("^grade[2-5]$"), F.lit(False)) | F.coalesce(F.col("route") == "hiking", F.lit(False))


def viewport(trails: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Trails whose box meets the view."""
    return trails.where((F.col("max_x") >= west) & (F.col("min_x") <= east) & (F.col("max_y") >= south) & (F.col("min_y") <= north))


def _box_distance(px, py):
    dx = F.greatest(F.col("min_x") - px, px - F.col("max_x"), F.lit(0.0))
    dy = F.greatest(F.col("min_y") - py, py - F.col("max_y"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


#: A grid's cells are so many times as wide as those of the grid below it.
COARSER = 4


def nearest(points: DataFrame, trails: DataFrame, *, k: int = 3, cell: float = 0.05, exact: bool = False) -> DataFrame:
    """point_id, trail_id, name, highway, metres (rounded) of the trail nearest to each point (point_id, lng, lat).

    Candidates are the ``k`` trails of smallest distance from point to box, of equals the smallest id; among them the
    nearest vertex or edge counts, in plain coordinates, its distance as a great circle.  ``exact`` judges all trails
    whose box is no farther than the best found.

    Trails are indexed by the cells that their boxes touch.  Points look into their own cell, then into the cells
    around it, then into the cells around them on coarser and coarser grids, until enough candidates are closer than
    what they have not seen: each round is an equi-join on at most nine cells for each point that is still open, so a
    point far from everything costs a few rounds more and not a square of cells.
    """
    known = durable(trails.select(F.col("id").alias("trail_id"), "min_x", "min_y", "max_x", "max_y", "name", "highway"))
    boxes = known.drop("name", "highway")
    px, py = F.col("lng"), F.col("lat")
    extent = boxes.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    open_points = points.select("point_id", "lng", "lat")
    if extent[0] is None:
        return open_points.select("point_id", F.lit(None).cast("long").alias("trail_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("highway"), F.lit(None).cast("long").alias("metres")).where(F.lit(False))
    open_points = durable(open_points)
    reach = open_points.agg(F.max(F.greatest(F.abs(px - extent[0]), F.abs(px - extent[2]), F.abs(py - extent[1]), F.abs(py - extent[3])))).first()[0] or 0.0
    own = [(0, 0)]
    around = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    size, places, seen = cell, own, 0.0
    grid = durable(cell_index(boxes, size, k))
    found = held = None
    while True:
        near = F.array(*(F.struct((F.floor(px / size) + x).alias("cx"), (F.floor(py / size) + y).alias("cy")) for x, y in places))
        met = open_points.select("*", F.explode(near).alias("c")).select("point_id", "lng", "lat", "c.cx", "c.cy").join(grid, ["cx", "cy"])
        met = met.select("point_id", "lng", "lat", "trail_id", _box_distance(px, py).alias("d"))
        # In its own cell a point meets each trail once.
        every = met if held is None else met.unionByName(held).dropDuplicates(["point_id", "trail_id"])
        ranked = durable(every.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy("d", "trail_id"))).where(F.col("rank") <= k).drop("rank"))
        if seen >= reach:
            found = ranked if found is None else found.unionByName(ranked)
            break
        # What is not seen yet is farther away than ``seen``, and not at distance 0.
        far = F.max("d")
        done = ranked.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), far.alias("far")).where((F.col("n") == k) & ((F.col("far") < seen) | (F.col("far") == 0))).select("point_id")
        settled = ranked.join(done, "point_id", "left_semi")
        found = settled if found is None else found.unionByName(settled)
        open_points = durable(open_points.join(done, "point_id", "left_anti"))
        if open_points.isEmpty():
            break
        held = ranked.join(done, "point_id", "left_anti")
        if places is own:
            places, seen = [p for p in around if p != (0, 0)], size
        else:
            size *= COARSER
            places, seen = around, size
            grid = durable(cell_index(boxes, size, k))
    chosen = found.select("point_id", "lng", "lat", "trail_id")
    if exact:
        best = _on_segments(chosen, trails).groupBy("point_id").agg(F.min("d").alias("best"))
        # Every trail whose box is within the best distance, on the grid where that is two cells at most.
        level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("best"), F.lit(cell)) / (2 * cell)) / np.log(COARSER))).cast("int")
        wide = durable(points.join(best, "point_id").select("point_id", "lng", "lat", "best", level.alias("level")))
        parts = []
        for (n,) in wide.select("level").distinct().collect():
            size = cell * COARSER**n

            def span(v, size=size):
                return F.sequence(F.floor((v - F.col("best")) / size), F.floor((v + F.col("best")) / size))

            cells = wide.where(F.col("level") == n).withColumn("cx", F.explode(span(px))).withColumn("cy", F.explode(span(py)))
            parts.append(cells.join(cell_index(boxes, size, None), ["cx", "cy"]).where(_box_distance(px, py) <= F.col("best")).select("point_id", "lng", "lat", "trail_id"))
        chosen = reduce(DataFrame.unionByName, parts).dropDuplicates(["point_id", "trail_id"]) if parts else chosen
    hits = _on_segments(chosen, trails)
    first = hits.groupBy("point_id").agg(F.min_by(F.struct("trail_id", "metres"), F.struct("metres", "trail_id") if not exact else F.struct("d", "trail_id")).alias("h"))
    named = known.select("trail_id", "name", "highway")
    return first.select("point_id", "h.trail_id", F.round("h.metres").cast("long").alias("metres")).join(named, "trail_id").select("point_id", "trail_id", "name", "highway", "metres")


def cell_index(boxes: DataFrame, cell: float, k: int | None = None) -> DataFrame:
    """Boxes by each cell that they touch.

    With ``k``, of the boxes that cover a cell whole only the k smallest ids stay, and of the others only those of
    smaller ids than all of these, if there are k: to a point in the cell the k are at distance 0, and to other points
    the cell's edge is as near by each of them as by any box; where one reaches nearer, it touches a nearer cell, too.
    """
    touched = boxes.select("*", F.explode(F.sequence(F.floor(F.col("min_x") / cell), F.floor(F.col("max_x") / cell))).alias("cx")).select("*", F.explode(F.sequence(F.floor(F.col("min_y") / cell), F.floor(F.col("max_y") / cell))).alias("cy"))
    if k is None:
        return touched
    e = cell * 1e-6  # points on a cell's edge are in either cell
    whole = (F.col("min_x") <= F.col("cx") * cell - e) & (F.col("max_x") >= (F.col("cx") + 1) * cell + e) & (F.col("min_y") <= F.col("cy") * cell - e) & (F.col("max_y") >= (F.col("cy") + 1) * cell + e)
    # The k smallest ids of the boxes that cover a cell: the limit on the rank is applied in every task first.
    first = touched.where(whole).select("cx", "cy", "trail_id").withColumn("rank", F.row_number().over(Window.partitionBy("cx", "cy").orderBy("trail_id"))).where(F.col("rank") <= k)
    last = first.where(F.col("rank") == k).select("cx", "cy", F.col("trail_id").alias("last"))
    return touched.join(last, ["cx", "cy"], "left").where(F.col("last").isNull() | (F.col("trail_id") <= F.col("last"))).drop("last")


def _on_segments(chosen: DataFrame, trails: DataFrame) -> DataFrame:
    """point_id, trail_id, d (plain) and metres of the nearest point of each chosen trail; of equals the first along it."""
    parts = chosen.join(trails.select(F.col("id").alias("trail_id"), "coords"), "trail_id")
    segments = parts.select("point_id", "trail_id", "lng", "lat", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("coords") - 2), lambda i: F.struct(F.get("coords", i).alias("a"), F.get("coords", i + 1).alias("b")))).alias("seq", "s"))
    at = geo.closest_on_segment("lng", "lat", F.col("s.a.lng"), F.col("s.a.lat"), F.col("s.b.lng"), F.col("s.b.lat"))
    placed = segments.withColumn("at", at)
    measured = placed.withColumns({"metres": geo.haversine("lng", "lat", F.col("at.x"), F.col("at.y")), "d": F.sqrt(F.pow(F.col("at.x") - F.col("lng"), F.lit(2.0)) + F.pow(F.col("at.y") - F.col("lat"), F.lit(2.0)))})
    best = measured.groupBy("point_id", "trail_id").agg(F.min_by(F.struct("d", "metres"), F.struct("metres", "seq")).alias("b"))
    return best.select("point_id", "trail_id", "b.d", "b.metres")


def profile(route_points: DataFrame, dem_tiles: DataFrame, z: int = 14) -> DataFrame:
    """route_id, seq, elev: nearest pixel of elevation tiles (x, y, px, py, elev); what is missing counts as 0 m."""
    placed = route_points.withColumn("p", geo.tile_pixel("lng", "lat", z)).select("route_id", "seq", "p.x", "p.y", "p.px", "p.py")
    return placed.join(dem_tiles, ["x", "y", "px", "py"], "left").select("route_id", "seq", F.coalesce("elev", F.lit(0.0)).alias("elev"))


def ascent(elevations: DataFrame) -> DataFrame:
    """route_id, ascent, descent: sums of the steps up and of the steps down."""
    d = F.col("elev") - F.col("prev_elev")
    return with_previous(elevations, "route_id", "seq", "elev").groupBy("route_id").agg(F.sum(F.greatest(F.coalesce(d, F.lit(0.0)), F.lit(0.0))).alias("ascent"), F.sum(F.greatest(F.coalesce(-d, F.lit(0.0)), F.lit(0.0))).alias("descent"))


def interpolated(points: DataFrame) -> DataFrame:
    """route_id, seq, elev: kept points as they are, others on straight lines in distance between kept neighbours."""
    w = Window.partitionBy("route_id").orderBy("seq")
    kept = F.when(F.col("keep"), F.struct("distance", "elev"))
    left = F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(kept, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    p = points.withColumns({"l": left, "r": right})
    t = F.try_divide(F.col("distance") - F.col("l.distance"), F.col("r.distance") - F.col("l.distance"))
    return p.select("route_id", "seq", F.when(F.col("keep"), F.col("elev")).otherwise(F.col("l.elev") + F.coalesce(t, F.lit(0.0)) * (F.col("r.elev") - F.col("l.elev"))).alias("elev"))


def smoothed(route_points: DataFrame, elevations: DataFrame, epsilon: float = 3.0) -> DataFrame:
    """route_id, seq, elev without jitter: the profile (distance, elevation) is thinned and the dropped points lie between the kept ones."""
    full = lengths(route_points).join(elevations, ["route_id", "seq"]).select("route_id", "seq", "distance", "elev")

    def run(key, table):
        table = table.sort_by("seq")
        line = np.stack([table.column("distance").to_numpy(), table.column("elev").to_numpy()], 1)
        return table.append_column("keep", pa.array(kernels.keep_flags(line, epsilon)))

    return interpolated(full.groupBy("route_id").applyInArrow(run, "route_id long, seq int, distance double, elev double, keep boolean"))


def trip_distance(fixes: DataFrame) -> DataFrame:
    """trip_id, segment, metres, seconds.

    Start and resume open a segment; only fixes of an open one count.  A step is counted when it is longer than a metre, the last fix always moves on.  Seconds
    run from a segment's first to its last event.
    """
    w = Window.partitionBy("trip_id").orderBy("ts", "seq")
    opens = F.col("event").isin("start", "resume").cast("int")
    marked = fixes.withColumn("segment", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.last(F.when(F.col("event") != "fix", F.col("event")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    active = marked.withColumn("state", state).where("state in ('start', 'resume')")
    own = Window.partitionBy("trip_id", "segment").orderBy("ts", "seq")
    fix = active.where("event = 'fix'").withColumns({"plng": F.lag("lng").over(own), "plat": F.lag("lat").over(own)})
    step = geo.haversine_asin("plng", "plat", "lng", "lat")
    metres = fix.groupBy("trip_id", "segment").agg(F.coalesce(F.sum(F.when(step > 1.0, step)), F.lit(0.0)).alias("metres"))
    spans = active.groupBy("trip_id", "segment").agg(F.floor((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1_000_000).cast("long").alias("seconds"))
    return spans.join(metres, ["trip_id", "segment"], "left").select("trip_id", "segment", F.coalesce("metres", F.lit(0.0)).alias("metres"), "seconds")


def throttled(events: DataFrame, key: str, gap_ms: int = 120) -> DataFrame:
    """Events (key, ms, seq) that come at least ``gap_ms`` after the last one let through of their key.

    Events of a key are sorted by the shuffle and streamed; what a task keeps is the time of one event.
    """

    def run(batches):
        at, last = None, None
        for b in batches:
            keep = []
            for k, ms in zip(b.column(b.schema.get_field_index(key)).to_pylist(), b.column(b.schema.get_field_index("ms")).to_pylist(), strict=True):
                ok = k != at or last is None or ms - last >= gap_ms
                at, last = k, ms if ok else last
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return events.repartition(key).sortWithinPartitions(key, "ms", "seq").mapInArrow(run, events.schema)


#: How fast one goes, in km/h, on a way of no other class, and by class; None: not at all.  A model of this engine's own.
PROFILES: dict[str, tuple[float | None, dict[str, float | None]]] = {
    "pedestrian": (5.0, {"motorway": None, "trunk": None, "steps": 2.5, "path": 4.0}),
    "bicycle": (18.0, {"motorway": None, "trunk": None, "steps": None, "footway": None, "path": 8.0, "track": 12.0}),
    "auto": (50.0, {"motorway": 120.0, "trunk": 90.0, "primary": 70.0, "residential": 30.0, "track": None, "path": None, "footway": None, "steps": None, "cycleway": None, "bridleway": None}),
}


def edge_cost(metres: Column, highway: Column, profile: str = "pedestrian") -> Column:
    """Seconds that an edge takes; null where the profile does not go there, so that `shortest_paths` passes it over."""
    usual, own = PROFILES[profile]

    def seconds(kmh: float | None) -> Column:
        return F.lit(None).cast("double") if kmh is None else metres * F.lit(3.6 / kmh)

    cost = seconds(usual)
    for kind, kmh in own.items():
        cost = F.when(highway == kind, seconds(kmh)).otherwise(cost)
    return cost


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, cost: least cost of edges (a, b, cost) from each source (source, node), edges taken both ways.

    Rounds of relaxation; each joins the nodes that changed with their edges and keeps the least, and its result is
    checkpointed.  Ends when nothing changes, after as many rounds as the longest of the least-cost paths has edges, and
    one.  Edges without a cost are not taken; a negative cost is an error, since no path would be the least.
    """
    cost = F.when(F.col("cost") < 0, F.raise_error(F.lit("negative cost")).cast("double")).otherwise(F.col("cost")).alias("cost")
    given = edges.where("cost is not null").select("a", "b", cost)
    both = durable(given.unionByName(given.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")).groupBy("a", "b").agg(F.min("cost").alias("cost")))
    known = sources.select("source", "node", F.lit(0.0).alias("cost"))
    front = known
    while True:
        steps = front.join(both.select(F.col("a").alias("node"), F.col("b").alias("next"), F.col("cost").alias("step")), "node").select("source", F.col("next").alias("node"), (F.col("cost") + F.col("step")).alias("cost"))
        best = known.withColumn("old", F.col("cost")).unionByName(steps.withColumn("old", F.lit(None).cast("double"))).groupBy("source", "node").agg(F.min("cost").alias("cost"), F.min("old").alias("old"))
        best = durable(best)
        front = best.where("old is null or cost < old").select("source", "node", "cost")
        known = best.select("source", "node", "cost")
        if front.isEmpty():
            return known


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the cluster's folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
