"""Precedence, ordering, caps and per-document summaries of findings.

The document is the unit of all of these, so they work on the hit array inside the
row. Only flat findings leave the row, and they no longer carry the text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.functions import catalog
from leakloom.functions.catalog import RULES
from leakloom.operators import matches

FINDING_FIELDS = (
    "line", "severity", "rule", "type", "column", "match", "description", "confidence"
)


def apply_precedence(hits: Column) -> Column:
    """One secret per line, and no format finding where a concatenation was found.

    ``hits`` is ordered by (line, rule), so a rule that beats another one on the same
    line is its direct predecessor. It must be a materialised column.
    """

    def survives(h, i):
        prev = F.get(hits, i - 1)
        beaten = (h["rule"] <= catalog.LAST_SECRET_RULE) | (
            (h["rule"] == catalog.SQL_FORMAT_RULE) & (prev["rule"] == catalog.SQL_CONCAT_RULE)
        )
        return (i == 0) | (prev["line"] != h["line"]) | ~beaten

    return F.filter(hits, survives)


def _by_rule(field: str, rule: Column) -> Column:
    values = F.array(*[F.lit(getattr(r, field)) for r in RULES])
    return F.get(values, rule)


def describe(hits: Column) -> Column:
    """Hits to full findings, ordered by line, severity as text, rule."""
    return F.sort_array(
        F.transform(
            hits,
            lambda h: F.struct(
                h["line"].alias("line"),
                _by_rule("severity", h["rule"]).alias("severity"),
                h["rule"].alias("rule"),
                _by_rule("type", h["rule"]).alias("type"),
                h["column"].alias("column"),
                h["match"].alias("match"),
                _by_rule("description", h["rule"]).alias("description"),
                _by_rule("confidence", h["rule"]).alias("confidence"),
            ),
        )
    )


@lru_cache
def _findings() -> Column:
    return describe(apply_precedence(F.col("_hits"))).alias("findings")


def with_findings(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Scan ``code`` (with ``filename``) and add ``findings``; clean rows get an empty array.

    With ``limit`` only the first findings in report order stay, and
    ``findings_truncated`` tells whether any were cut.
    """
    keep = df.columns
    df = matches.with_hits(df).select(*keep, _findings())
    if limit is None:
        return df
    return df.select(
        *keep,
        F.slice("findings", 1, limit).alias("findings"),
        (F.size("findings") > limit).alias("findings_truncated"),
    )


def severity_counts(findings: Column) -> Column:
    """Struct of counts per severity, zero-filled."""

    def count(severity):
        return F.size(F.filter(findings, lambda f: f["severity"] == severity)).alias(severity)

    return F.struct(*[count(s) for s in catalog.SEVERITIES])


def with_summary(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.size("findings").alias("total"),
        severity_counts(F.col("findings")).alias("summary"),
    )


def explode_findings(df: DataFrame, *keys: str) -> DataFrame:
    """One slim row per finding, in the fields of ``FINDING_FIELDS``."""
    return df.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.*")
