"""Archive entries: admission, path safety, which entries are scanned, result caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakloom.functions import catalog, text as tx
from leakloom.operators import findings as fd

OK, REJECTED, ERROR = "ok", "rejected", "error"


def safe_name(name: Column) -> Column:
    """Normalised entry path, or null for an absolute, climbing or empty one."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", "."))
    unsafe = (
        F.startswith(path, F.lit("/"))
        | F.rlike(path, F.lit(r"\A[a-zA-Z]:"))
        | F.array_contains(parts, "..")
        | (F.size(parts) == 0)
    )
    return F.when(~unsafe, F.array_join(parts, "/"))


def is_scannable(path: Column) -> Column:
    """Source code by base name or suffix. A leading dot alone does not make a suffix."""
    base = F.lower(tx.base_name(path))
    suffix = F.regexp_extract(base, r"(?s)\A.+(\.[^.]+)\z", 1)
    return base.isin(*catalog.BARE_NAMES) | suffix.isin(*catalog.CODE_SUFFIXES)


def is_small_enough(size: Column, limit: int | None = catalog.MAX_ENTRY_BYTES) -> Column:
    """None is no limit."""
    return F.lit(True) if limit is None else size <= limit


def looks_binary(content: Column) -> Column:
    head = F.substring(content, 1, catalog.BINARY_PROBE_BYTES)
    return F.contains(head, F.lit(b"\x00"))


def archive_reason(
    n_bytes: Column,
    is_zip: Column,
    n_entries: Column,
    total_size: Column,
    max_bytes: int | None = catalog.MAX_ARCHIVE_BYTES,
    max_entries: int | None = catalog.MAX_ARCHIVE_ENTRIES,
    max_total: int | None = catalog.MAX_ARCHIVE_EXPANDED,
) -> Column:
    """First failing check of a whole archive, or null when it is admitted. A limit of None is none."""
    over = lambda value, limit: F.lit(False) if limit is None else value > limit
    return (
        F.when(over(n_bytes, max_bytes), "too_large")
        .when(~is_zip, "not_a_zip")
        .when(over(n_entries, max_entries), "too_many_entries")
        .when(over(total_size, max_total), "too_large_expanded")
    )


NO_CAP = 2**31 - 1


def cap_entries(
    entries: DataFrame, per_entry: int | None = None, per_archive: int | None = None
) -> DataFrame:
    """Apply the result caps of an archive, walking its entries in directory order.

    None is no cap.

    Input: archive, entry_idx, ``event`` (null, 'rejected' or 'error' for an entry that
    ends the archive), ``scanned`` (boolean) and ``n`` (findings of a scanned entry).
    Adds ``keep`` (findings that stay), ``emitted`` and ``archive_status``; entries
    behind the stop are dropped.

    The window sees one archive at a time. Only admitted archives get here, so a
    partition holds at most the admitted number of entries and no archive can be hot.
    """
    per_entry, per_archive = (NO_CAP if x is None else x for x in (per_entry, per_archive))
    by_archive = Window.partitionBy("archive")
    earlier = by_archive.orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("scanned"), F.least(F.col("n"), F.lit(per_entry))).otherwise(0)
    df = entries.withColumn("_n", counted)
    df = df.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    stops = F.when(F.col("scanned") & (F.col("_before") >= per_archive), F.col("entry_idx"))
    df = df.withColumn("_stop", F.min(stops).over(by_archive))
    df = df.where(F.col("_stop").isNull() | (F.col("entry_idx") <= F.col("_stop")))
    first_event = F.min(
        F.when(F.col("event").isNotNull(), F.struct("entry_idx", "event"))
    ).over(by_archive)
    return df.select(
        *entries.columns,
        F.greatest(F.lit(0), F.least("_n", F.lit(per_archive) - F.col("_before")))
        .cast("int")
        .alias("keep"),
        (F.col("scanned") & (F.col("_before") < per_archive)).alias("emitted"),
        F.coalesce(first_event["event"], F.lit(OK)).alias("archive_status"),
    )


def kept(values: Column, keep: Column) -> Column:
    return F.slice(values, F.lit(1), keep)


def with_kept_counts(capped: DataFrame) -> DataFrame:
    """Cut ``findings`` to the kept ones and count them per severity."""
    df = capped.withColumn("findings", kept(F.col("findings"), F.col("keep")))
    return df.withColumn("kept_counts", fd.severity_counts(F.col("findings")))


def _totals() -> list[Column]:
    return [
        F.count_if("scanned").alias("files_scanned"),
        F.count_if(F.col("keep") > 0).alias("files_with_findings"),
        F.sum("keep").cast("long").alias("total"),
        *[
            F.sum(F.coalesce(F.col("kept_counts")[s], F.lit(0))).cast("long").alias(s)
            for s in catalog.SEVERITIES
        ],
    ]


def _files(fields: tuple[str, ...]) -> Column:
    item = F.struct(
        "entry_idx", F.col("filename").alias("file"), F.col("keep").alias("count"), *fields
    )
    # Entries that are not emitted give null, which is not collected.
    return F.sort_array(F.collect_list(F.when(F.col("emitted"), item))).alias("findings_by_file")


def rollup(capped: DataFrame, *keys: str) -> DataFrame:
    """One row per archive. ``capped`` carries ``kept_counts``, a struct per severity."""
    return capped.groupBy("archive", *keys).agg(*_totals())


def files_list(capped: DataFrame, *fields: str) -> DataFrame:
    """Emitted entries of each archive as one array in directory order.

    The array is bounded: an admitted archive has a limited number of entries and its
    findings are capped before they are collected.
    """
    return capped.groupBy("archive").agg(_files(fields))


def archive_results(capped: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Rollup, entries that only their size left out, and file list in one aggregation, so that the scan below runs once."""
    skipped = F.count_if("too_large").alias("files_too_large")
    return capped.groupBy("archive", *keys).agg(*_totals(), skipped, _files(fields))
