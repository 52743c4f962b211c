"""Which scan requests are scanned, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.functions import catalog, text as tx

SCAN = "scan"
BLANK = "blank"


def parse_request(body: Column) -> Column:
    """JSON text to a variant; null when it is not JSON."""
    return F.try_parse_json(body)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def with_admission(
    df: DataFrame, body: str = "body", max_chars: int | None = catalog.MAX_CODE_CHARS
) -> DataFrame:
    """Add ``reason`` (first failing check, else 'blank' or 'scan'), ``filename``, ``code``.

    ``max_chars`` is the service's limit of a request unless given; None is no limit.

    A missing file name takes the default; a null one is not a string and is refused.
    """
    df = df.withColumn("_v", parse_request(F.col(body)))
    pick = lambda name, t="variant": F.try_variant_get("_v", f"$.{name}", t)
    df = df.select(
        *[c for c in df.columns if c != "_v"],
        pick("code").alias("_code"),
        pick("filename").alias("_name"),
    ).withColumns(
        {
            "code": F.when(_kind(F.col("_code")) == "STRING", F.col("_code").cast("string")),
            "filename": F.when(F.col("_name").isNull(), F.lit(catalog.DEFAULT_FILENAME)).when(
                _kind(F.col("_name")) == "STRING", F.col("_name").cast("string")
            ),
        }
    )
    reason = (
        F.when(F.col("_code").isNull(), "no_code")
        .when(F.col("code").isNull(), "code_not_text")
        .when(
            F.col("filename").isNull()
            | (F.length("filename") > catalog.MAX_FILENAME_CHARS),
            "bad_filename",
        )
        .when(F.lit(False) if max_chars is None else F.length("code") > max_chars, "code_too_long")
        .when(tx.is_blank(F.col("code")), BLANK)
        .otherwise(SCAN)
    )
    return tx.compute_once(df, "reason", reason).drop("_code", "_name")


def admitted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason") == SCAN).drop("reason")


def quarantined(df: DataFrame) -> DataFrame:
    """Refused requests with their reason; blank ones are not refused, just empty."""
    return df.where(~F.col("reason").isin(SCAN, BLANK))
