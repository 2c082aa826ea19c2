"""Ways: classification by tags, joins with coordinates, lengths and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators.mvt import LAYERS


def _with_key(tags: Column, key: str) -> Column:
    return F.filter(tags, lambda t: t["k"] == key)


def _last(tags: Column, key: str) -> Column:
    return F.try_element_at(_with_key(tags, key), F.lit(-1))["v"]


def classify(ways: DataFrame) -> DataFrame:
    """way columns with layer, class, sac_scale, name in place of tags (pairs k, v in order).

    The layer is the first of highway, waterway, natural, landuse that a way has, its class the first value of that
    key; of other keys that repeat the last counts.  Grades stay on highways only, empty names are null.  Ways without
    a layer key are dropped.
    """
    tags = F.col("tags")
    layer, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i in reversed(range(len(LAYERS))):
        own = _with_key(tags, LAYERS[i])
        layer = F.when(F.size(own) > 0, F.lit(i)).otherwise(layer)
        kind = F.when(F.size(own) > 0, F.get(own, F.lit(0))["v"]).otherwise(kind)
    rest = [c for c in ways.columns if c != "tags"]
    out = ways.select(*rest, layer.alias("layer"), kind.alias("class"), _last(tags, "sac_scale").alias("s"), F.nullif(_last(tags, "name"), F.lit("")).alias("name"))
    return out.where("layer is not null").select(*rest, "layer", "class", F.when(F.col("layer") == 0, F.col("s")).alias("sac_scale"), "name")


def keep(ways: DataFrame) -> DataFrame:
    """Classified ways with two references at least."""
    return classify(ways.where(F.size("refs") >= 2))


def vertices(ways: DataFrame, coordinates: DataFrame, *carry: str) -> DataFrame:
    """way_id, pos, node_id and coordinates of every reference whose node is known; references that repeat stay.

    An inner equi-join on the node: both sides shuffle by node, which spreads ways of any length.
    """
    walked = ways.select("way_id", *carry, F.posexplode("refs").alias("pos", "node_id"))
    return walked.join(coordinates, "node_id")


def lines(ways: DataFrame, coordinates: DataFrame, *carry: str) -> DataFrame:
    """way_id, line: coordinates in order; ways of which fewer than two vertices are known are dropped.

    Lines group by way and only then meet the ways' other columns, so those do not travel with each vertex.
    """
    points = vertices(ways, coordinates.select("node_id", "mx", "my"))
    made = points.groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mx", "my"))), lambda p: F.struct(p["mx"].alias("x"), p["my"].alias("y"))).alias("line")).where(F.size("line") >= 2)
    return made.join(ways.select("way_id", *carry), "way_id") if carry else made


def with_previous(points: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return points.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns))


def lengths(points: DataFrame, key: str = "route_id", order: str = "seq") -> DataFrame:
    """key, order, cumulative metres along the points."""
    stepped = with_previous(points, key, order, "lng", "lat")
    step = F.coalesce(geo.haversine("prev_lng", "prev_lat", "lng", "lat"), F.lit(0.0))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("step", step).select(*points.columns, F.sum("step").over(w).alias("distance"))


def require_tags(ways: DataFrame, tags: DataFrame) -> DataFrame:
    """Ways with their tag rows; a way without one is an error when its row is read."""
    found = ways.join(tags.withColumn("__found", F.lit(True)), "way_id", "left")
    checked = F.when(F.col("__found"), F.col("way_id")).otherwise(F.raise_error(F.concat(F.lit("no tags for way "), F.col("way_id").cast("string"))).cast("long"))
    return found.withColumn("way_id", checked).drop("__found")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
