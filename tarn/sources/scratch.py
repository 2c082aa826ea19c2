"""Tables that a job writes for itself in the shared folder, and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarn.sources.files import checkpoint_folder


class Scratch:
    """A folder of one job's tables, each under a name.

    ``keep`` writes a table as Parquet and reads it again, so its lineage ends there and lost executors cost nothing
    but the tasks they had.  Once a table is written, what was kept under its name before is removed: a loop leaves one
    round in the store, not all.  Nothing may read a name's earlier table any more when the name is kept again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        before, self.paths[name] = self.paths.get(name), path
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes the tables of these names, of all if none is given."""
        for name in names or tuple(self.paths):
            remove(self.spark, self.paths.pop(name))
        if not self.paths:
            remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system Spark reads it from."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
