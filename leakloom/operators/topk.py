"""Per-group ranking that survives a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 64


def first_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt_by: str, salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows of every group, with their rank in ``rank``.

    Groups are ranked in ``salts`` slices first, so that a group holding a large share of
    all rows is spread over many tasks; at most ``n * salts`` of its rows meet in the
    second step. The rank bound lets Spark cut each slice before the shuffle as well.
    """
    slices = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    by_slice = Window.partitionBy(*keys, "_salt").orderBy(*order)
    by_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        slices.withColumn("_slice_rank", F.row_number().over(by_slice))
        .where(F.col("_slice_rank") <= n)
        .drop("_slice_rank", "_salt")
        .withColumn("rank", F.row_number().over(by_group))
        .where(F.col("rank") <= n)
    )
