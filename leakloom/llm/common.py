"""Helpers of the corpus operators: work tables in the shared folder, fixed character classes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Six ASCII white space characters part words; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A-Z to a-z on bytes, all other bytes unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_local_root: list[str] = []
#: Work folders made inside scratch(), for each one that is open.
_scratch: list[list[str]] = []


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder that driver and executors share.

    A local master without that setting gets one temporary folder for the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="corpus-"))
        root = _local_root[0]
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Work folders made in this context go at its end; what is needed later has to be written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read back.

    Cuts the lineage: what follows survives lost executors without computing df again,
    and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = work_path(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._work_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the folder of a frame made by saved() that nothing reads any more.

    Shuffle files of earlier plans go as well: Spark drops them once both sides have
    collected their garbage, which long loops cannot wait for.
    """
    spark = df.sparkSession
    _delete(spark, df._work_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body mentions it.

    A lambda variable is the only name that the optimizer never replaces by its expression.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
