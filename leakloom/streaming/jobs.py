"""Streaming jobs. They call the batch operators on unbounded frames or on micro-batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from leakloom.functions import catalog
from leakloom.operators import tenants, usage
from leakloom.plans import scan


def file_stream(
    spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int | None = None
) -> DataFrame:
    """A stream over the parquet files of a folder, with the schema they have now."""
    found = spark.read.option("pathGlobFilter", glob).parquet(folder)
    reader = spark.readStream.schema(found.schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over one parquet table, be it a single file or a folder of part files."""
    # The stream reader takes a single file only by a pattern; this one matches the path alone.
    one = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(one)


def scan_stream(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Continuous scan. Scanning works inside each row, so it streams without state."""
    return scan.scan_requests(requests, limit)


def write_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once file sink over what is available now."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", transform=None
) -> StreamingQuery:
    """Write every micro-batch, or what ``transform`` makes of it, to its own ``batch_id=N`` folder.

    A repeated batch overwrites its folder, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch_id={batch_id}"
        out = transform(batch) if transform else batch
        writer = out.write.mode("overwrite")
        if "ts_date" in out.columns:
            writer = writer.partitionBy("ts_date")
        writer.parquet(target)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def usage_stream(scans: DataFrame, path: str, checkpoint: str, pepper: str | None) -> StreamingQuery:
    """One log row per scan outcome, laid out by batch and day."""
    rows = usage.log_rows(scans, pepper).withColumn("ts_date", F.to_date("ts"))
    return write_batches(rows, path, checkpoint)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query refused because they came later than its lateness allows."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def rate_stream(limited: DataFrame, lateness: str) -> DataFrame:
    """Requests per route, bucket and clock minute, for update mode: the newest count holds.

    Minutes stay open for ``lateness``; later rows are refused and counted by ``late_rows``.
    """
    return (
        limited.withWatermark("ts", lateness)
        .groupBy("route", "bucket", F.window("ts", "1 minute"))
        .agg(F.count("*").alias("requests"), F.max("minute_limit").alias("minute_limit"))
        .select(
            "route", "bucket", F.col("window.start").alias("minute"), "requests", "minute_limit",
            F.greatest(F.lit(0), F.col("requests") - F.col("minute_limit")).alias("over"),
        )
    )


def totals_stream(log: DataFrame, lateness: str) -> DataFrame:
    """Scans and findings per day and key, updated as rows arrive; see rate_stream for lateness."""
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "key_id")
        .agg(F.count("*").alias("scans"), F.sum("findings").alias("findings"))
        .select(F.to_date("window.start").alias("date"), "key_id", "scans", "findings")
    )


def rollup_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sums of the usage log per day and key, kept up as rows arrive (read them by usage.read_rollup).

    Every batch leaves its own partial sums, which add up in any order: rows may come as late
    as they like, none is refused, nothing is held as state, and a repeated batch replaces itself.
    """
    return write_batches(log, path, checkpoint, transform=usage.partial_sums)


def rate_rollup_stream(limited: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Requests per route, bucket and minute like rate_stream, as partial sums that no row is too late for."""

    def counts(batch: DataFrame) -> DataFrame:
        return tenants.rate_counts(batch).drop("over")

    return write_batches(limited, path, checkpoint, transform=counts)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.option("basePath", path).parquet(path)
    summed = parts.groupBy("route", "bucket", "minute").agg(F.sum("requests").alias("requests"), F.max("minute_limit").alias("minute_limit"))
    return summed.withColumn("over", F.greatest(F.lit(0), F.col("requests") - F.col("minute_limit")))


def _daily_quota(state_days: float) -> StatefulProcessor:
    """Requests accepted so far of the callers of one bucket, by caller and UTC day, as keyed state."""
    columns = [c.split()[0] for c in _DECISION.split(", ")]
    lifetime = int(state_days * 86_400_000)

    # A class of this function, so that it travels as it is to workers without this package.
    class DailyQuota(StatefulProcessor):
        def init(self, handle):
            self._used = handle.getValueState("used", "accounts array<string>, used array<long>, changed array<long>", lifetime)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            # The rows of a bucket in one micro-batch, whose size the source bounds.
            batch = pd.concat(list(rows)).sort_values(["ts", "id"], ignore_index=True)
            counts = batch["valid"] & (batch["caller"] != "anon")
            if not counts.any():
                yield batch.assign(blocked=False, consumed=False)[columns]
                return
            # One value for the whole bucket: a round trip to the store per bucket, not per caller and day.
            now = timerValues.getCurrentProcessingTimeInMs()
            kept = zip(*self._used.get()) if self._used.exists() else ()
            state = {a: (used, changed) for a, used, changed in kept if now < changed + lifetime}
            own = batch[counts]
            codes, accounts = pd.factorize(own["account"])
            used = pd.Series([state.get(a, (0, 0))[0] for a in accounts])
            before = used.to_numpy()[codes] + own.groupby(codes).cumcount()
            blocked = (own["route"] == "code") & (before >= own["day_limit"])
            accepted = (~blocked).groupby(codes).sum()
            if accepted.any():
                state |= {str(accounts[i]): (int(used[i] + n), now) for i, n in accepted.items() if n}
                totals, changes = zip(*state.values())
                self._used.update((list(state), list(totals), list(changes)))
            refused = blocked.reindex(batch.index, fill_value=False)
            yield batch.assign(blocked=refused, consumed=counts & ~refused)[columns]

        def close(self):
            pass

    return DailyQuota()


_DECISION = "id long, ts timestamp, route string, caller string, valid boolean, blocked boolean, consumed boolean"
#: State with a lifetime needs RocksDB, and would run empty batches without end.
_STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def quota_stream(
    called: DataFrame,
    path: str,
    checkpoint: str,
    limits: dict[str, int] = catalog.PLAN_PER_DAY,
    state_days: float = 1,
    buckets: int = 512,
) -> StreamingQuery:
    """Quota decisions in arrival order; within a micro-batch by time, then id.

    The number of accepted requests of each (caller, UTC day) is keyed state in RocksDB, in
    the checkpoint, and leaves it ``state_days`` after its last change. Refused, invalid and
    anonymous requests change no state; those without a caller are spread over all buckets.
    Nothing that was written before is read again.

    Callers share ``buckets`` values of state, so calls to the store follow the buckets and not
    the callers; a checkpoint needs the same ``buckets`` at every start.
    """
    spark = called.sparkSession
    spread = F.when(F.col("caller") == "anon", F.xxhash64("id")).otherwise(F.xxhash64("caller"))
    bucket = F.pmod(spread, F.lit(buckets)).cast("int")
    limit = tenants.daily_limit(F.coalesce("plan", F.lit(catalog.DEFAULT_PLAN)), limits)
    day = F.coalesce(F.to_date("ts").cast("string"), F.lit("-"))
    rows = called.select(
        "id", "ts", "route", "caller", "valid", limit.alias("day_limit"),
        F.concat_ws(" ", day, "caller").alias("account"), bucket.alias("bucket"),
    )
    decided = rows.groupBy("bucket").transformWithStateInPandas(
        _daily_quota(state_days), outputStructType=_DECISION, outputMode="append", timeMode="processingTime"
    )
    before = {name: spark.conf.get(name, None) for name in _STATEFUL}
    for name, value in _STATEFUL.items():
        spark.conf.set(name, value)
    try:  # a query keeps the settings that it was started with
        return write_batches(decided.withColumn("ts_date", F.to_date("ts")), path, checkpoint)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
