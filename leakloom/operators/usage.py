"""The usage log: one metadata row per scan, and its statistics.

The log never holds code, snippets or raw addresses.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakloom.functions import catalog, digests
from leakloom.operators import topk

LOG_COLUMNS = (
    "id", "ts", "key_id", "ip_hash", "size", "findings", *catalog.SEVERITIES,
    "duration_ms", "status", "owner_id",
)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def window_start(as_of: datetime, days: int) -> datetime:
    """Start of the window, cut to whole seconds as the log's times are."""
    return (as_of - timedelta(days=days)).replace(microsecond=0)


def _in_window(log: DataFrame, since: datetime) -> Column:
    # The bound is spelled out, so that it is read in the session time zone, and takes the
    # type of the column, so that the filter reaches the parquet reader.
    bound = F.lit(since.isoformat(sep=" ")).cast(log.schema["ts"].dataType)
    return F.col("ts") >= bound


def _windowed(log: DataFrame, since: datetime) -> DataFrame:
    """Rows of the window. In a log laid out by day, older folders are not even listed."""
    if "ts_date" in log.columns:
        log = log.where(F.col("ts_date") >= F.lit(since.date()))
    return log.where(_in_window(log, since))


def findings_total(total: Column, *severities: Column) -> Column:
    """The given total, or the sum of the severities when it is zero or missing."""
    summed = sum((F.coalesce(s, F.lit(0)) for s in severities), F.lit(0))
    return F.when(F.coalesce(total, F.lit(0)) != 0, total).otherwise(summed)


def log_rows(scans: DataFrame, pepper: str | None) -> DataFrame:
    """Scan outcomes to log rows.

    Input: id, ts, key_id, ip, size, total, critical, high, medium, low, duration_ms,
    status, owner_id. Missing counts are zero and a missing status is 'ok'.
    """
    number = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return scans.select(
        "id",
        F.date_trunc("second", "ts").alias("ts"),
        "key_id",
        digests.address_pseudonym(F.col("ip"), pepper).alias("ip_hash"),
        number("size"),
        findings_total(F.col("total"), *[F.col(s) for s in catalog.SEVERITIES])
        .cast("int")
        .alias("findings"),
        *[number(s) for s in catalog.SEVERITIES],
        number("duration_ms"),
        F.coalesce("status", F.lit("ok")).alias("status"),
        "owner_id",
    )


def read_log(frames: list[DataFrame]) -> DataFrame:
    """One log from parts of different age; parts without owner_id get null owners."""
    log = frames[0]
    for part in frames[1:]:
        log = log.unionByName(part, allowMissingColumns=True)
    if "owner_id" not in log.columns:
        log = log.withColumn("owner_id", F.lit(None).cast("long"))
    return log


def total_scans(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total_all_time"))


def scans_since(log: DataFrame, since: datetime) -> DataFrame:
    return _windowed(log, since).agg(F.count("*").alias("total_last_days"))


def daily(log: DataFrame, since: datetime, days: int) -> DataFrame:
    """Scans and findings per day in the window, newest first, at most ``days`` rows."""
    return (
        _windowed(log, since)
        .groupBy(F.to_date("ts").alias("date"))
        .agg(F.count("*").alias("scans"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
        .orderBy(F.desc("date"))
        .limit(days)
    )


def by_key(log: DataFrame, since: datetime) -> DataFrame:
    """Scans and findings per key in the window, most scans first, then by key."""
    return (
        _windowed(log, since)
        .groupBy(F.col("key_id").alias("key"))
        .agg(F.count("*").alias("scans"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
        .orderBy(F.desc("scans"), "key")
    )


def errors(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("status") != "ok").alias("errors"))


def mean_duration(log: DataFrame) -> DataFrame:
    ok = F.when(F.col("status") == "ok", F.col("duration_ms"))
    return log.agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("avg_duration_ms"))


def stats(log: DataFrame, since: datetime, days: int) -> DataFrame:
    """All statistics in one long frame: section, item, scans, findings, value.

    The log is reduced to sums per key and day; grouping sets over those give the totals,
    the days and the keys. The per-key section stays distributed rows, as its length grows
    with the number of keys. Which days are the newest is one row, found from the times of
    the window alone, so the rows of keys are neither ranked nor moved again.
    """
    inside = _in_window(log, since)
    ok = F.col("status") == "ok"
    sums = ("n", "n_in", "f_in", "n_err", "ms", "n_ms")
    base = log.groupBy("key_id", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n"),
        F.count_if(inside).alias("n_in"),
        F.coalesce(F.sum(F.when(inside, F.col("findings"))), F.lit(0)).alias("f_in"),
        F.count_if(~ok).alias("n_err"),
        F.coalesce(F.sum(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("ms"),
        F.count(F.when(ok, F.col("duration_ms"))).alias("n_ms"),
    )
    # One row of zeros, so that an empty log has totals too.
    zeros = log.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("key_id"),
        F.lit(None).cast("date").alias("date"),
        *[F.lit(0).cast("bigint").alias(c) for c in sums],
    )
    grouped = (
        base.unionByName(zeros)
        .groupingSets([[], ["date"], ["key_id"]], "date", "key_id")
        .agg(
            F.grouping("date").alias("no_date"), F.grouping("key_id").alias("no_key"),
            *[F.sum(c).alias(c) for c in sums],
        )
    )
    is_total = (F.col("no_date") == 1) & (F.col("no_key") == 1)
    none = F.lit(None).cast("bigint")

    def row(section, item, scans, found, value):
        return F.struct(
            section.alias("section"), item.alias("item"), scans.alias("scans"),
            found.alias("findings"), value.cast("double").alias("value"),
        )

    mean = F.coalesce(F.try_divide("ms", "n_ms"), F.lit(0.0))
    totals = [
        row(F.lit("total"), F.lit(name), none, none, value)
        for name, value in (
            ("total_all_time", F.col("n")),
            ("total_last_days", F.col("n_in")),
            ("errors", F.col("n_err")),
            ("avg_duration_ms", mean),
        )
    ]
    group = row(
        F.when(F.col("no_date") == 0, "daily").otherwise("by_key"),
        F.coalesce(F.col("date").cast("string"), "key_id"),
        F.col("n_in"), F.col("f_in"), F.lit(None),
    )
    listed = (
        grouped.where(is_total | (F.col("n_in") > 0))
        .select(F.inline(F.when(is_total, F.array(*totals)).otherwise(F.array(group))))
    )
    dates = _windowed(log, since).select(F.to_date("ts").alias("d")).distinct()
    first = dates.orderBy(F.desc("d")).limit(days).agg(F.min("d").cast("string")).scalar()
    return listed.where((F.col("section") != "daily") | (F.col("item") >= first))


def latest(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(limit).select(
        "ts", "key_id", "ip_hash", "size", "findings", "duration_ms", "status"
    )


OWNER_COLUMNS = ("ts", "key_id", "size", "findings", "duration_ms", "status")


def latest_of_owner(log: DataFrame, owner_id: int, limit: int = 20) -> DataFrame:
    mine = log.where(F.col("owner_id") == owner_id)
    return mine.orderBy(F.desc("id")).limit(clamp(limit, 1, 100)).select(*OWNER_COLUMNS)


def latest_per_owner(log: DataFrame, limit: int = 20) -> DataFrame:
    """The same for every owner at once."""
    owned = log.where(F.col("owner_id").isNotNull()).select("owner_id", "id", *OWNER_COLUMNS)
    return topk.first_per_group(
        owned, ["owner_id"], [F.desc("id")], clamp(limit, 1, 100), salt_by="id"
    )


# --- sums that are kept up ---------------------------------------------------------


def partial_sums(log: DataFrame) -> DataFrame:
    """Sums of some rows of the log per day and key; sums of all parts add up to those of the log."""
    ok = F.col("status") == "ok"
    return log.groupBy(F.to_date("ts").alias("date"), "key_id").agg(
        F.count("*").alias("scans"), F.sum("findings").alias("findings"), F.count_if(~ok).alias("errors"),
        F.count_if(ok & F.col("duration_ms").isNotNull()).alias("timed"), F.sum(F.when(ok, F.col("duration_ms"))).alias("timed_ms"),
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """date, key_id, scans, findings, errors, timed, timed_ms of all parts written below ``path``."""
    parts = spark.read.option("basePath", path).parquet(path)
    return parts.groupBy("date", "key_id").agg(*(F.sum(c).alias(c) for c in ("scans", "findings", "errors", "timed", "timed_ms")))


def all_time(rollup: DataFrame) -> DataFrame:
    """total_scans, errors and avg_duration_ms of all time, as of U03, U07 and U08, without reading the log."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mean = F.coalesce(F.try_divide(F.sum("timed_ms"), F.sum("timed")), F.lit(0.0))
    return rollup.agg(total("scans").alias("total_scans"), total("errors").alias("errors"), mean.alias("avg_duration_ms"))
