"""Database source of the directory.

The five upstream tables are read with Spark's JDBC source, each split into
parallel range reads on its numeric key (``partitionColumn``), then joined in
Spark (J4) and reduced to the latest course per lecturer (W1). Connection
options (URL, user, password, driver) always come from the caller; nothing is
stored here. Tested on Parquet stand-ins with the same table shapes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cattedra.operators.directory import build_directory

# --- Fixed values: the upstream table names and their split keys. ---
UPSTREAM_TABLES = {
    "work_prof_id": "prof_id",
    "insegnamento_prof_id": "prof_id",
    "insegnamenti": "insegnamento_id",
    "materia_ssd": "materia_id",
    "materie": "materia_id",
}
# --- end of fixed values ---


@dataclass
class Bounds:
    lower: int
    upper: int
    partitions: int


def read_table(spark: SparkSession, url: str, table: str, options: dict[str, str],
               split_column: str | None = None, bounds: Bounds | None = None) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    if split_column and bounds:
        reader = (reader.option("partitionColumn", split_column)
                  .option("lowerBound", str(bounds.lower)).option("upperBound", str(bounds.upper))
                  .option("numPartitions", str(bounds.partitions)))
    return reader.load()


def read_directory_sources(spark: SparkSession, url: str, options: dict[str, str],
                           bounds: dict[str, Bounds] | None = None) -> dict[str, DataFrame]:
    bounds = bounds or {}
    return {name: read_table(spark, url, name, options, key, bounds.get(name))
            for name, key in UPSTREAM_TABLES.items()}


def directory_from_database(spark: SparkSession, url: str, options: dict[str, str],
                            bounds: dict[str, Bounds] | None = None) -> DataFrame:
    """Q9 over JDBC: the directory table (write it with K2 ``replace``)."""
    return build_directory(read_directory_sources(spark, url, options, bounds))
