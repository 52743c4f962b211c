"""ZIP archives as rows.

Spark has no ZIP reader, so two Arrow functions wrap Python's decoder. The first lists
the directory, the second inflates only the entries Spark asks for. All decisions in
between are column expressions.

Both look at one archive at a time. Of a batch, Python holds the packed bytes as Spark sent
them; what is inflated leaves the worker a few archives at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LISTING = (
    "struct<is_zip:boolean,failed:boolean,"
    "entries:array<struct<entry_idx:int,name:string,size:bigint,is_dir:boolean>>>"
)
INFLATED = "array<struct<entry_idx:int,content:binary,failed:boolean>>"
# Python hands over what it has inflated when it is this much, or one archive if that is more.
INFLATED_BYTES = 4 * 1024 * 1024


def list_entries(content: Column) -> Column:
    """Directory of each archive. A damaged one ends that archive, not the job."""

    def listing(data: bytes) -> tuple:
        import io
        import zipfile

        if not zipfile.is_zipfile(io.BytesIO(data)):
            return False, False, []
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return True, False, [
                    {"entry_idx": i, "name": e.filename, "size": e.file_size, "is_dir": e.is_dir()}
                    for i, e in enumerate(z.infolist())
                ]
        except Exception:
            return True, True, []

    entry = pa.struct({"entry_idx": pa.int32(), "name": pa.string(), "size": pa.int64(), "is_dir": pa.bool_()})
    kind = pa.struct({"is_zip": pa.bool_(), "failed": pa.bool_(), "entries": pa.list_(entry)})

    def batch(content: pa.Array) -> pa.Array:
        return pa.array([dict(zip(kind.names, listing(x.as_py()))) for x in content], kind)

    return F.arrow_udf(batch, LISTING)(content)


def _inflater():
    """A function over batches of archives and wanted entries, which gives its results in bounded pieces."""

    def read(data: bytes, indexes) -> list[dict]:
        import io
        import zipfile

        if not indexes:
            return []
        out = []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            for i in indexes:
                try:
                    body, failed = z.read(infos[i]), False
                except Exception:
                    body, failed = None, True
                out.append({"entry_idx": i, "content": body, "failed": failed})
        return out

    kind = pa.list_(pa.struct({"entry_idx": pa.int32(), "content": pa.binary(), "failed": pa.bool_()}))

    def batches(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for content, wanted in parts:
            done, held = [], 0
            for d, w in zip(content, wanted):
                done.append(read(d.as_py(), w.as_py()))
                held += sum(len(e["content"] or b"") for e in done[-1])
                if held >= INFLATED_BYTES:
                    yield pa.array(done, kind)
                    done, held = [], 0
            yield pa.array(done, kind)

    return batches


def inflate(content: Column, wanted: Column) -> Column:
    """Bytes of the wanted entries. An unreadable entry is reported as failed."""
    return F.arrow_udf(_inflater(), INFLATED)(content, wanted)


def archive_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Archives below ``path``: archive (its path), n_bytes, content (null beyond the limit)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select(
        F.col("path").alias("archive"),
        F.col("length").alias("n_bytes"),
        F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"),
    )
