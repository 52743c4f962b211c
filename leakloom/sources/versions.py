"""Small keyed tables (users, API keys) whose changes last: one job sees what the one before changed.

A table is a folder with ``data``, where every change writes the hash buckets that it
touches, and ``versions``, with one row per version that names the folder of each bucket.
That row is a single file, so a version is there as a whole or not at all: a job that fails
before leaves the version before, and a bucket that is not touched is not written again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _newest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """Number of the newest version (0: none) and the folder of each bucket that has rows."""
    try:
        versions = spark.read.schema("version long, folders map<int, string>").parquet(f"{path}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    row = versions.orderBy(F.desc("version")).first()
    return (row["version"], row["folders"]) if row else (0, {})


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an earlier one."""
    if version is None:
        _, folders = _newest(spark, path)
    else:
        folders = spark.read.parquet(f"{path}/versions").where(F.col("version") == version).first()["folders"]
    return _rows(spark, path, schema, folders)


def _rows(spark: SparkSession, path: str, schema: str, folders: dict[int, str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    files = [f"{path}/data/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
    return spark.read.schema(schema).parquet(*files)


def upsert(spark: SparkSession, path: str, schema: str, rows: DataFrame, key: str) -> int:
    """A version in which ``rows`` (one for each key) stand in place of the rows with their keys; its number.

    Keys must not be null. At most one row for each bucket comes to the driver. Of two jobs that
    change the same version, the second one fails and has to be run again.
    """
    number, folders = _newest(spark, path)
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    folder = uuid.uuid4().hex
    staged = rows.select(*columns).withColumn("bucket", bucket_of(F.col(key)))
    staged.write.parquet(f"{path}/staged/{folder}")
    staged = spark.read.schema(staged.schema).parquet(f"{path}/staged/{folder}")
    touched = [r["bucket"] for r in staged.select("bucket").distinct().collect()]
    if not touched:
        return number
    old = _rows(spark, path, schema, {b: f for b, f in folders.items() if b in touched})
    stays = old.join(staged.select(key), key, "left_anti").withColumn("bucket", bucket_of(F.col(key)))
    stays.select(*columns, "bucket").union(staged).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    pairs = [(number + 1, folders | {b: folder for b in touched})]
    version = spark.createDataFrame(pairs, "version long, folders map<int, string>").coalesce(1)
    version.write.mode("errorifexists").parquet(f"{path}/versions/n={number + 1:010d}")
    return number + 1
