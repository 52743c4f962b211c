"""The code scan, from requests to nested results and usage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakloom.functions import catalog
from leakloom.operators import admission, findings as fd, report
from leakloom.sources import tables


def scan_files(files: DataFrame) -> DataFrame:
    """Whole-file scan: file, findings, total, summary, without a cap."""
    return fd.with_summary(fd.with_findings(files))


def scan_requests(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Admitted requests to scan results, one nested row each. No shuffle is involved.

    ``limit`` caps the findings of a request; without it all stay.
    """
    found = fd.with_findings(tables.code_table(requests), limit)
    if limit is None:
        found = found.withColumn("findings_truncated", F.lit(False))
    return report.with_report(fd.with_summary(found)).withColumn("status", F.lit("ok"))


def scan_bodies(
    bodies: DataFrame, column: str = "body", max_chars: int | None = catalog.MAX_CODE_CHARS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON request bodies to results, blank results and refused requests; max_chars as in admission."""
    checked = admission.with_admission(bodies, column, max_chars).drop(column)
    return (
        scan_requests(admission.admitted(checked)),
        checked.where(F.col("reason") == admission.BLANK),
        admission.quarantined(checked),
    )


def scan_document(results: DataFrame, *keys: str) -> DataFrame:
    """The published fields of a scan result; the code itself is not repeated."""
    published = F.transform(
        "findings",
        lambda f: F.struct(
            *[
                f[c].alias(c)
                for c in ("type", "severity", "line", "column", "match", "description", "confidence")
            ]
        ),
    )
    return results.select(
        *keys, "status", F.col("filename").alias("file"), "total", "findings_truncated",
        "summary", published.alias("findings"), "report",
    )


def blank_document(requests: DataFrame, *keys: str) -> DataFrame:
    """Blank code: an empty result without summary; it never reaches the usage log."""
    blank = requests.where(F.col("reason") == admission.BLANK)
    return blank.select(
        *keys,
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("file"),
        F.lit(0).alias("total"),
        F.lit(None).cast("struct<critical:int,high:int,medium:int,low:int>").alias("summary"),
    )
