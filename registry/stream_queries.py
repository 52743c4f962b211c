"""Streaming jobs run over what is available, compared with the batch statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.operators import findings as fd, tenants, usage
from leakloom.streaming import jobs
from registry import scan_sql as sq, usage_queries as uq, views as v

QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


class _Streams:
    """Stands in for a session whose table reads are streams."""

    def __init__(self, spark):
        self._spark = spark
        self.conf = spark.conf
        self.read = self

    def parquet(self, path):
        return jobs.table_stream(self._spark, path)


def _run(spark, start):
    """Start a query with fresh folders and wait until it has read everything."""
    path = v.work_dir(spark, "stream")
    query = start(path, v.work_dir(spark, "state"))
    query.awaitTermination()
    return spark.read.option("basePath", path).parquet(path)


def scan_stream(spark, sf):
    results = jobs.scan_stream(v.corpus(_Streams(spark), sf)).select("doc_id", "filename", "findings")
    done = _run(spark, lambda path, state: jobs.write_files(results, path, state))
    return fd.explode_findings(done, "doc_id", "filename").select(
        "doc_id", "filename", "line", "column", "type", "match"
    )


add(
    "ST01_scan_stream",
    scan_stream,
    f'{sq.with_findings()} SELECT doc_id, filename, line, "column", type, match FROM findings',
)


def _scans_stream(spark, sf):
    return v.scans(_Streams(spark), sf).withColumn("ts", F.col("ts").cast("timestamp"))


def usage_stream(spark, sf):
    scans = _scans_stream(spark, sf).withColumn("total", F.col("findings"))
    log = _run(spark, lambda path, state: jobs.usage_stream(scans, path, state, uq.PEPPER))
    return log.select(
        "id", uq.ts_text(), "ip_hash", "findings", "status", F.col("ts_date").cast("string").alias("ts_date")
    )


add(
    "ST02_usage_stream",
    usage_stream,
    f"{uq._PLAIN_LOG} SELECT id, {uq._TS}, ip_hash, findings, status, "
    "CAST(CAST(ts AS DATE) AS VARCHAR) AS ts_date FROM log",
)


def _called_stream(spark, sf):
    return tenants.with_caller(
        v.requests(_Streams(spark), sf), v.api_keys(spark, sf), v.users(spark, sf), v.LEGACY_KEYS
    )


def rate_stream(spark, sf):
    limited = tenants.with_rate_limit(_called_stream(spark, sf))
    counts = jobs.rate_stream(limited, lateness="1 hour")
    updates = _run(spark, lambda path, state: jobs.write_batches(counts, path, state, mode="update"))
    newest = updates.groupBy("route", "bucket", "minute").agg(
        F.max_by(F.struct("requests", "minute_limit", "over"), "batch_id").alias("c")
    )
    return newest.select("route", "bucket", uq.ts_text("minute"), "c.*")


add(
    "ST03_rate_stream",
    rate_stream,
    f"""{uq._CALLED}, limited AS (SELECT *, CASE WHEN registered THEN rate_limit WHEN legacy THEN 300 ELSE 30 END
  AS minute_limit FROM called)
SELECT route, bucket, {uq._MINUTE}, count(*) AS requests, max(minute_limit) AS minute_limit,
  greatest(0, count(*) - max(minute_limit)) AS over
FROM limited GROUP BY 1, 2, 3""",
)


def quota_stream(spark, sf):
    requests = _called_stream(spark, sf)
    log = _run(spark, lambda path, state: jobs.quota_stream(requests, path, state, uq.LIMITS))
    return log.select("id", "route", "caller", "blocked")


add("ST04_quota_stream", quota_stream, uq._QUOTA)


def totals_stream(spark, sf):
    totals = jobs.totals_stream(_scans_stream(spark, sf), lateness="1 day")
    updates = _run(spark, lambda path, state: jobs.write_batches(totals, path, state, mode="update"))
    # Every update carries the new totals of its day and key: the latest one holds.
    newest = updates.groupBy("date", "key_id").agg(
        F.max_by(F.struct("scans", "findings"), "batch_id").alias("t")
    )
    return newest.select(F.col("date").cast("string").alias("date"), "key_id", "t.scans", "t.findings")


add(
    "ST05_totals_stream",
    totals_stream,
    f"{uq._SCANS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, key_id, count(*) AS scans, "
    "CAST(sum(findings) AS BIGINT) AS findings FROM scans GROUP BY 1, 2",
)


def rollup(spark, sf):
    path, state = v.work_dir(spark, "rollup"), v.work_dir(spark, "state")
    jobs.rollup_stream(_scans_stream(spark, sf), path, state).awaitTermination()
    return usage.read_rollup(spark, path)


add(
    "U03_all_time_from_rollup",
    lambda spark, sf: usage.all_time(rollup(spark, sf)),
    f"""{uq._SCANS} SELECT count(*) AS total_scans, count(*) FILTER (status <> 'ok') AS errors,
  coalesce(avg(duration_ms) FILTER (status = 'ok'), 0) AS avg_duration_ms FROM scans""",
)
add(
    "ST05_totals_from_rollup",
    lambda spark, sf: rollup(spark, sf).select(F.col("date").cast("string").alias("date"), "key_id", "scans", "findings", "errors"),
    f"""{uq._SCANS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, key_id, count(*) AS scans,
  CAST(sum(findings) AS BIGINT) AS findings, count(*) FILTER (status <> 'ok') AS errors FROM scans GROUP BY 1, 2""",
)
