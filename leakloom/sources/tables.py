"""Code tables, text files, saved findings; nested and tabular sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from leakloom.functions import catalog, text as tx
from leakloom.operators import usage


def code_table(df: DataFrame) -> DataFrame:
    """A table with ``code``; a missing file name column or value takes the default."""
    if "filename" not in df.columns:
        return df.withColumn("filename", F.lit(catalog.DEFAULT_FILENAME))
    return df.withColumn("filename", F.coalesce("filename", F.lit(catalog.DEFAULT_FILENAME)))


def decode_files(files: DataFrame) -> DataFrame:
    """``path, content`` (bytes) to ``path, filename, code`` with unified newlines."""
    return files.select(
        "path",
        tx.base_name(F.col("path")).alias("filename"),
        tx.unify_newlines(tx.decode_utf8(F.col("content"))).alias("code"),
    )


# What a task of file_tree reads, at most or nearly so; a single file can be larger.
FILES_PER_TASK, BYTES_PER_TASK = 1024, 128 * 2**20


def file_tree(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Text files below ``path``, one row per file, read in parallel as bytes.

    Spark counts each file as 4 MB at least and would start a task for every few small ones.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    n_files = len(files._jdf.inputFiles())  # a count; the names stay in the JVM
    n_bytes = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    needed = max(-(-n_files // FILES_PER_TASK), -(-n_bytes // BYTES_PER_TASK))
    return decode_files(files.coalesce(max(spark.sparkContext.defaultParallelism, needed)))


NO_KEY = "__HIVE_DEFAULT_PARTITION__"
# Of all tasks, about; some tasks get no rows. Where a tree has more than 32, Spark lists them by as many tasks.
FOLDERS = 256


def write_file_tree(texts: DataFrame, path: str) -> None:
    """``key, text`` to one file per key and task below ``path``, a line end after each text.

    The key, a number, is in the path: ``<column>=<key>.txt``. Without its native library, Hadoop's
    local file system starts processes for every file, and it keeps checksums beside each, so tasks
    write there by themselves; in other stores Spark's writer makes a folder ``<column>=<key>`` with the file.
    """
    key, value = texts.columns
    spark = texts.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        texts.write.partitionBy(key).text(path)
        return
    root = system.makeQualified(folder).toUri().getPath()
    os.makedirs(root)
    rows = texts.select(key, F.col(value).cast("binary"))
    writer = _file_writer(root, key, -(-FOLDERS // max(1, rows.rdd.getNumPartitions())))
    # What an attempt writes is in a folder that readers do not see; here the files of those that count come out of it.
    for part, made in rows.mapInArrow(writer, "part string, made array<int>").collect():
        for i in made:
            os.rename(f"{root}/_{part}/{i}", f"{root}/{part}-{i}")
        os.rmdir(f"{root}/_{part}")


def _file_writer(root: str, key: str, folders: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        folder = f"{root}/_{part}"
        os.mkdir(folder)
        made = set()
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                i = hash((k,)) % folders
                if i not in made:
                    os.mkdir(f"{folder}/{i}")
                    made.add(i)
                with open(f"{folder}/{i}/{key}={NO_KEY if k is None else k}.txt", "ab") as file:
                    file.write((text.as_py() or b"") + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sorted(made)], pa.list_(pa.int32()))], ["part", "made"])

    return write


_FINDING = "struct<type:string,severity:string,line:int,match:string,confidence:string>"


def saved_findings(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts, each a bare list of findings or an object with findings and code."""
    text = F.col(column)
    as_list = F.from_json(text, f"array<{_FINDING}>")
    as_object = F.from_json(text, f"struct<findings:array<{_FINDING}>,code:string>")
    bare = F.startswith(F.ltrim(text), F.lit("["))
    empty = F.from_json(F.lit("[]"), f"array<{_FINDING}>")
    return documents.select(
        *[c for c in documents.columns if c != column],
        F.when(bare, as_list).otherwise(F.coalesce(as_object["findings"], empty)).alias("findings"),
        F.when(bare, F.lit("")).otherwise(F.coalesce(as_object["code"], F.lit(""))).alias("code"),
    )


def read_saved_findings(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return saved_findings(spark.read.text(path, wholetext=True))


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per scan, written in parallel as JSON lines."""
    results.write.mode("errorifexists").json(path)


def append_usage(rows: DataFrame, path: str) -> None:
    """Append usage rows, laid out by day.

    The rebalance hint gathers a day into few files and splits a day that is too large.
    """
    with_day = rows.withColumn("ts_date", F.to_date("ts"))
    with_day.hint("rebalance", "ts_date").write.mode("append").partitionBy("ts_date").parquet(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage log; parts written before it had owners get null owners."""
    return usage.read_log([spark.read.option("mergeSchema", "true").parquet(path)])
