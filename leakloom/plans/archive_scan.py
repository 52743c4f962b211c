"""The archive scan: bytes, directory, entries, findings, caps, rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakloom.functions import catalog, text as tx
from leakloom.operators import entries as en, findings as fd, report
from leakloom.sources import archives as src


def directories(archives: DataFrame, **limits: int | None) -> DataFrame:
    """Admission of whole archives: adds ``entries`` and ``reason``; keeps ``content``.

    ``limits`` are those of ``entries.archive_reason``.

    The entries of an archive that is not admitted are dropped here, unread.
    """
    listed = archives.withColumn("_dir", src.list_entries(F.coalesce("content", F.lit(b""))))
    total = F.aggregate(
        "_dir.entries", F.lit(0).cast("bigint"), lambda acc, e: acc + e["size"]
    )
    reason = en.archive_reason(
        F.col("n_bytes"), F.col("_dir.is_zip"), F.size("_dir.entries"), total, **limits
    )
    listed = listed.select(
        "archive", "n_bytes", "content", "_dir", reason.alias("reason"),
        F.col("_dir.failed").alias("failed"),
    )
    refused = F.col("reason").isNotNull() | F.col("failed")
    return listed.select(
        "archive", "n_bytes", "content", "reason", "failed",
        F.when(~refused, F.col("_dir.entries")).alias("entries"),
    )


def entry_rows(dirs: DataFrame, max_entry_bytes: int | None = catalog.MAX_ENTRY_BYTES) -> DataFrame:
    """One row per entry: archive, entry_idx, filename, event, scanned, too_large, code.

    Only entries that pass the name and size tests are inflated; ``too_large`` marks those that
    only the size limit (None: no limit) leaves out. An archive without
    entries keeps one row, so that it still gets a result.
    """
    carried = ("archive", "n_bytes", "reason", "failed")
    checked = dirs.withColumn(
        "entries",
        F.transform(
            "entries",
            lambda e: F.struct(
                e["entry_idx"].alias("entry_idx"),
                e["size"].alias("size"),
                e["is_dir"].alias("is_dir"),
                en.safe_name(e["name"]).alias("path"),
            ),
        ),
    )
    named = lambda e: e["path"].isNotNull() & ~e["is_dir"] & en.is_scannable(e["path"])
    wanted = lambda e: named(e) & en.is_small_enough(e["size"], max_entry_bytes)
    empty = F.array().cast("array<struct<entry_idx:int,size:bigint,is_dir:boolean,path:string>>")
    entries = F.coalesce("entries", empty)
    picked = checked.withColumns(
        {
            "_read": F.filter(entries, wanted),
            "_rest": F.filter(entries, lambda e: ~F.coalesce(wanted(e), F.lit(False))),
        }
    )
    data = src.inflate(
        F.coalesce("content", F.lit(b"")), F.transform("_read", lambda e: e["entry_idx"])
    )
    # Bytes meet their entry by position, so that a row holds those of one entry only.
    item = lambda e, content, failed, large: F.struct(
        e["entry_idx"].alias("entry_idx"), e["path"].alias("path"),
        content.alias("content"), failed.alias("failed"), F.coalesce(large, F.lit(False)).alias("too_large"),
    )
    read = F.zip_with("_read", "_data", lambda e, d: item(e, d["content"], d["failed"], F.lit(False)))
    rest = F.transform("_rest", lambda e: item(e, F.lit(None).cast("binary"), F.lit(False), named(e)))
    rows = (
        picked.withColumn("_data", data)
        .select(*carried, F.explode_outer(F.concat(read, rest)).alias("d"))
        .select(*carried, "d.entry_idx", F.col("d.path").alias("filename"), "d")
    )
    text_file = F.coalesce(
        F.col("d.content").isNotNull() & ~en.looks_binary(F.col("d.content")), F.lit(False)
    )
    unsafe = F.col("entry_idx").isNotNull() & F.col("filename").isNull()
    return rows.select(
        *carried,
        "entry_idx",
        "filename",
        F.when(unsafe, en.REJECTED).when(F.col("d.failed"), en.ERROR).alias("event"),
        text_file.alias("scanned"),
        F.coalesce("d.too_large", F.lit(False)).alias("too_large"),
        F.when(text_file, tx.decode_utf8(F.col("d.content"))).alias("code"),
    )


def scan_entries(
    rows: DataFrame,
    per_entry: int | None = None,
    per_archive: int | None = None,
    with_reports: bool = False,
) -> DataFrame:
    """Scan entry rows, then apply the caps (None: no cap).

    Code stays behind before the shuffle by archive; of a report only the snippets travel,
    its fixed texts are filled in afterwards.
    """
    rows = rows.withColumn("code", F.when(F.col("scanned"), F.col("code")).otherwise(""))
    found = fd.with_findings(rows)
    sized = found.withColumn("n", F.size("findings"))
    if per_entry is not None:
        sized = sized.withColumn("findings", F.slice("findings", 1, per_entry))
    if with_reports:
        sized = report.with_snippets(sized)
    capped = en.cap_entries(sized.drop("code"), per_entry, per_archive)
    capped = en.with_kept_counts(capped)
    if with_reports:
        snippets = en.kept(F.col("snippets"), F.col("keep"))
        items = report.report_items(F.col("findings"), snippets)
        capped = capped.withColumn("report", items).drop("snippets")
    return capped


def scan_archives(
    archives: DataFrame,
    with_reports: bool = True,
    per_entry: int | None = None,
    per_archive: int | None = None,
    max_entry_bytes: int | None = catalog.MAX_ENTRY_BYTES,
    **admission: int | None,
) -> DataFrame:
    """One row per archive: its status and, when it is 'ok', counts and nested results.

    ``per_entry`` and ``per_archive`` cap the findings, ``admission`` sets the limits of
    ``entries.archive_reason`` and ``max_entry_bytes`` that of an entry; None is no limit, and
    ``files_too_large`` says what the last one left out. The nested list is bounded by the admitted entries and the
    caps; without caps, read entries as flat rows from ``scan_entries`` instead.

    Other statuses: 'rejected' (with the failed admission check, or an unsafe path) and
    'error' (damaged directory or entry).
    """
    rows = entry_rows(directories(archives, **admission), max_entry_bytes)
    capped = scan_entries(rows, per_entry, per_archive, with_reports)
    fields = ("findings", "report") if with_reports else ("findings",)
    keys = ("n_bytes", "reason", "failed", "archive_status")
    results = en.archive_results(capped, keys, fields)
    status = (
        F.when(F.col("reason").isNotNull(), en.REJECTED)
        .when(F.col("failed"), en.ERROR)
        .otherwise(F.col("archive_status"))
    )
    results = results.withColumns(
        {
            "status": status,
            "reason": F.coalesce(
                "reason", F.when(F.col("archive_status") == en.REJECTED, "unsafe_path")
            ),
        }
    ).drop("failed", "archive_status")
    only_ok = [c for c in results.columns if c not in ("archive", "n_bytes", "status", "reason")]
    return results.select(
        "archive", "n_bytes", "status", "reason",
        *[F.when(F.col("status") == en.OK, F.col(c)).alias(c) for c in only_ok],
    )


def usage_inputs(results: DataFrame) -> DataFrame:
    """What the usage log gets from archive scans: rejected archives leave no row.

    A failed archive is logged with zeros; the size is in bytes.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return results.where(F.col("status") != en.REJECTED).select(
        "archive",
        F.col("n_bytes").cast("int").alias("size"),
        *[zero(c) for c in ("total", *catalog.SEVERITIES)],
        "status",
    )
