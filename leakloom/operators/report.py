"""Findings in plain language, with a code snippet."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.functions import catalog, text as tx


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_label(severity: Column) -> Column:
    return F.coalesce(_lookup(catalog.SEVERITY_LABELS, severity), severity)


def template_field(kind: Column, field: int) -> Column:
    known = _lookup({k: v[field] for k, v in catalog.TEMPLATES.items()}, kind)
    return F.coalesce(known, F.lit(catalog.DEFAULT_TEMPLATE[field]))


def report_items(findings: Column, snippets: Column) -> Column:
    """Array of report items, in the order of the findings.

    The field names are those of the wire format. Missing snippets become empty.
    """
    return F.zip_with(
        findings,
        snippets,
        lambda f, s: F.struct(
            severity_label(f["severity"]).alias("severity"),
            f["severity"].alias("severity_raw"),
            f["line"].alias("line"),
            template_field(f["type"], 0).alias("titlu"),
            template_field(f["type"], 1).alias("explicatie"),
            template_field(f["type"], 2).alias("fix_prompt"),
            F.coalesce(f["match"], F.lit("")).alias("match_redactat"),
            F.coalesce(s, F.lit("")).alias("snippet"),
            F.coalesce(f["confidence"], F.lit("medium")).alias("confidence"),
        ),
    )


@lru_cache
def _items() -> Column:
    return report_items(F.col("findings"), F.col("snippets"))


@lru_cache
def _snippets() -> Column:
    return F.transform("findings", lambda f: tx.snippet(F.col("_lines"), f["line"]))


def with_snippets(df: DataFrame) -> DataFrame:
    """Add ``snippets``, one per finding. Lines are cut only where something was found."""
    lines = F.when(
        (F.size("findings") > 0) & (F.length("code") > 0), F.split("code", "\n", -1)
    )
    return tx.compute_once(df.withColumn("_lines", lines), "snippets", _snippets()).drop("_lines")


def with_report(df: DataFrame) -> DataFrame:
    """Add ``report`` next to ``findings``; both have the same length and order."""
    return tx.compute_once(with_snippets(df), "report", _items()).drop("snippets")
