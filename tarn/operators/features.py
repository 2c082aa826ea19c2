"""Feature files written by tasks: features in the order of the Hilbert curve, and a packed R-tree over their boxes."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators.archive import put_in_place
from tarn.operators.export import or_default
from tarn.operators.ranking import numbered
from tarn.sources import feature_file as ff
from tarn.sources.scratch import Scratch

#: The curve's grid over the extent has 2**GRID cells a side; nodes that go to the file at once; features of a block whose sizes are summed together.
GRID, NODES_AT_ONCE, BLOCK = 16, 4096, 1 << 16


def _encode(batches):
    for b in batches:
        lines, out = b.column(b.schema.get_field_index("coords")), []
        offs = lines.offsets.to_numpy()
        xy = np.stack([lines.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
        names = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("id", "name", "highway"))
        for a, z, *own in zip(offs[:-1].tolist(), offs[1:].tolist(), *names, strict=True):
            out.append(ff.pack_feature(xy[a:z], *own))
        keep = [b.column(b.schema.get_field_index(c)) for c in ("k", *ff.BOX)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(map(len, out), pa.int64()), pa.array(out, pa.binary())], names=["k", *ff.BOX, "size", "blob"])


def _nodes(_key, table):
    rows = table.sort_by("node")
    nodes = np.zeros(rows.num_rows, ff.NODE)
    for c in (*ff.BOX, "offset"):
        nodes[c] = rows.column(c).to_numpy()
    return pa.table([rows.column("node").slice(0, 1), pa.array([nodes.tobytes()], pa.binary())], names=["node", "blob"])


def write_features(trails: DataFrame, path: str, name: str = "trails") -> None:
    """``trails`` (id, name, highway, coords) as one FlatGeobuf file with its index; lines without points are left out.

    Features are numbered by ranges of their box's place on the curve, encoded by tasks and put in their places from
    there; each level of the tree is an aggregation of the one below, a sixteenth of its size.  The driver sees the
    extent and a number for every 65,536 features.  ``path`` must be seen by driver and tasks alike; the file appears
    under its name when it is whole.
    """
    scratch = Scratch(trails.sparkSession, "features")
    lng, lat = F.transform("coords", lambda p: p["lng"]), F.transform("coords", lambda p: p["lat"])
    boxed = trails.where(F.size("coords") > 0).select("id", "name", "highway", "coords", F.array_min(lng).alias("min_x"), F.array_min(lat).alias("min_y"), F.array_max(lng).alias("max_x"), F.array_max(lat).alias("max_y"))
    e = boxed.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y"), F.count(F.lit(1))).first()
    n, side = e[4], 1 << GRID

    def cell(low: str, high: str, first: float, last: float):
        span = (last or 0.0) - (first or 0.0)
        return F.least(F.floor(((F.col(low) + F.col(high)) / 2 - first) / span * side), F.lit(side - 1)).cast("long") if span > 0 else F.lit(0).cast("long")

    curve = geo.hilbert_id(F.lit(GRID), cell("min_x", "max_x", e[0], e[2]), cell("min_y", "max_y", e[1], e[3]))
    placed = numbered(boxed.withColumn("curve", curve), "curve", "id", name="place").withColumn("k", F.col("place") - 1)
    kept = placed.select("k", *ff.BOX, F.col("id").cast("long").alias("id"), F.col("name").cast("string").alias("name"), F.col("highway").cast("string").alias("highway"), F.col("coords").cast("array<struct<lng:double,lat:double>>").alias("coords"))
    made = scratch.keep("made", kept.mapInArrow(_encode, "k long, min_x double, min_y double, max_x double, max_y double, size long, blob binary"))
    block = F.floor(F.col("k") / BLOCK)
    begins, at = [], 0
    for b, size in made.groupBy(block.alias("block")).agg(F.sum("size")).orderBy("block").collect():
        begins.append((b, at))
        at += size
    before = F.sum("size").over(Window.partitionBy("block").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    starts = trails.sparkSession.createDataFrame(begins, "block long, begin long")
    leaves = made.drop("blob").withColumn("block", block).withColumn("within", before).join(F.broadcast(starts), "block").select("k", *ff.BOX, (F.col("begin") + F.col("within")).alias("offset"))
    leaves = scratch.keep("leaves", leaves)
    sizes = ff.level_sizes(n) if n else []
    first = ff.level_starts(sizes)
    head = ff.pack_header(name, tuple(e[:4]) if n else None, n)
    level, nodes = leaves, None
    for k in range(len(sizes)):
        if k:
            up = level.groupBy(F.floor(F.col("k") / ff.FAN).alias("k")).agg(*((F.min if c < 2 else F.max)(b).alias(b) for c, b in enumerate(ff.BOX)))
            level = scratch.keep(f"level{k}", up.withColumn("offset", F.lit(first[k - 1]) + F.col("k") * ff.FAN))
        own = level.select((F.lit(first[k]).cast("long") + F.col("k")).alias("node"), *ff.BOX, F.col("offset").cast("long").alias("offset"))
        nodes = own if nodes is None else nodes.unionByName(own)
    body = len(head) + ff.NODE.itemsize * sum(sizes)
    part = f"{path}.part"
    with open(part, "wb") as out:
        out.write(head)
        out.truncate(body + at)
        out.flush()
        os.fsync(out.fileno())
    if n:
        packed = nodes.groupBy(F.floor(F.col("node") / NODES_AT_ONCE).alias("run")).applyInArrow(_nodes, "node long, blob binary")
        put_in_place(packed.select((F.lit(len(head)) + F.col("node") * ff.NODE.itemsize).alias("at"), "blob"), part, body - len(head))
        put_in_place(made.select("k", "blob").join(leaves.select("k", "offset"), "k").select((F.lit(body) + F.col("offset")).alias("at"), "blob"), part, at)
    os.replace(part, path)
    scratch.drop()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a feature file (id, name, highway, coords and box); missing or empty properties take their defaults."""
    ff.register(spark)
    found = spark.read.format("flatgeobuf").load(path).where("type = 'LineString'")
    return found.select(or_default("id", 0), or_default("name", "Unnamed Trail"), or_default("highway", "path"), "coords", *ff.BOX)
