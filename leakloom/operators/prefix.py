"""Running sums per group of a log, in one shuffle that spreads a group of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def running(df: DataFrame, keys: list[str], order: list[str], weight: Column, folder: str) -> DataFrame:
    """Add ``running``: the sum of ``weight`` (0 or more) over the rows of a group up to each row.

    A segmented prefix scan. Rows are range-partitioned by group and order, so that a hot
    group lies in several partitions, and summed up within their partition on the way to
    ``folder``. Only the first group of a partition can have begun before it: what the
    partitions before hold of that group is carried to it, one number for each partition.
    ``df`` is read once; ``folder`` has to be new and in reach of all executors.
    """
    if any(c in df.columns for c in ("running", "_part", "_head", "_weight")):
        raise ValueError("the columns running, _part, _head and _weight are made here")
    weighed = df.withColumn("_weight", F.coalesce(weight.cast("long"), F.lit(0)))
    placed = weighed.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    fields = [T.StructField("_part", T.IntegerType()), T.StructField("_head", T.BooleanType()), T.StructField("running", T.LongType())]
    schema = T.StructType(weighed.schema.fields + fields)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total, head = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for key in keys:
                codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            group = [tuple(batch.column(key)[i].as_py() for key in keys) for i in (0, n - 1)]
            new[0] = last is not None and group[0] != last
            sums = np.cumsum(batch.column("_weight").to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(new)
            # What a row's group starts from: the sum before it, or what earlier batches held.
            before = np.concatenate([[-total], np.r_[0, sums][starts]])
            stretch = np.cumsum(new)
            sums = sums - before[stretch]
            heads = (stretch == 0) & head
            head = head and not len(starts)
            last, total = group[1], int(sums[-1])
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(heads), pa.array(sums)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_part", "_head", "running"])

    placed.mapInArrow(add_up, schema).write.parquet(folder)
    summed = df.sparkSession.read.schema(schema).parquet(folder)
    group = F.struct(*keys)
    ends = summed.groupBy("_part").agg(
        F.min(group).alias("first"), F.max(F.struct(group.alias("group"), F.col("running"))).alias("last")
    )
    # A partition asks for its first group before it adds what it holds of its last one.
    asks = ends.select("_part", F.col("first").alias("group"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("held"))
    adds = ends.select("_part", F.col("last.group").alias("group"), F.lit(1).alias("step"), F.col("last.running").alias("held"))
    earlier = Window.partitionBy("group").orderBy("_part", "step").rowsBetween(Window.unboundedPreceding, 0)
    carried = asks.union(adds).withColumn("_carried", F.sum("held").over(earlier)).where("step = 0")
    return (
        summed.join(F.broadcast(carried.select("_part", "_carried")), "_part")  # a row for each partition
        .withColumn("running", F.col("running") + F.when(F.col("_head"), F.col("_carried")).otherwise(0))
        .drop("_part", "_head", "_carried", "_weight")
    )
