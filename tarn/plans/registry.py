"""All queries and oracles of the map-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.plans import kernel_oracles, online_queries, route_queries, scalar_queries, source_queries, tile_queries

QUERIES = {**scalar_queries.QUERIES, **tile_queries.QUERIES, **online_queries.QUERIES, **source_queries.QUERIES, **route_queries.QUERIES}
ORACLE_SQL = {**scalar_queries.ORACLE_SQL, **tile_queries.ORACLE_SQL, **online_queries.ORACLE_SQL, **source_queries.ORACLE_SQL, **route_queries.ORACLE_SQL, **kernel_oracles.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["geo05_mvt_encode"](spark, sf_dir)
