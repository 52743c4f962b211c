"""Usage log, quotas and rates against plain loops; nothing private is logged."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leakloom.operators import admission, prefix, tenants, topk, usage
from leakloom.plans import scan
from leakloom.sources import tables
from leakloom.streaming import jobs
from registry import scan_queries, stream_queries

START = datetime(2024, 3, 1, 22, 0)


def requests(spark, n=4000, seed=1):
    """A request log in which one key sends a third of everything."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice(["hot"] * 4 + ["k1", "k2", "k3", "old", "bad", None, "  ", "gone"])
        rows.append((i, START + timedelta(seconds=rnd.randint(0, 20000)), rnd.choice(["code", "code", "archive"]),
                     f"10.0.0.{rnd.randint(1, 3)}", key))
    return rows, spark.createDataFrame(rows, "id long, ts timestamp, route string, ip string, key_text string")


def directory(spark):
    users = spark.createDataFrame([(1, "a@x", "pro"), (2, "b@x", "free"), (3, "c@x", "odd")], "id long, email string, plan string")
    keys = spark.createDataFrame(
        [(11, 1, "hot", 300, False), (12, 2, "k1", 30, False), (13, 2, "k2", 30, False), (14, 3, "k3", 30, False), (15, 1, "gone", 300, True)],
        "id long, user_id long, key string, rate_limit int, revoked boolean",
    )
    keys = keys.withColumns({"key_hash": F.sha2("key", 256), "key_prefix": F.left("key", F.lit(8))}).drop("key")
    return keys, users


LABELS = {"hot": "user:a@x key:hot", "k1": "user:b@x key:k1", "k2": "user:b@x key:k2", "k3": "user:c@x key:k3", "old": "key:old"}


def replay(rows, limits):
    used, blocked = {}, set()
    for i, ts, route, _, key in sorted(rows, key=lambda r: (r[1], r[0])):
        caller = LABELS.get((key or "").strip(), "anon")
        if (key or "").strip() and caller == "anon":
            continue  # invalid key
        if caller == "anon":
            continue
        plan = "pro" if key == "hot" else "free"
        slot = (caller, ts.date())
        if route == "code" and used.get(slot, 0) >= limits[plan]:
            blocked.add(i)
        else:
            used[slot] = used.get(slot, 0) + 1
    return blocked


@pytest.mark.parametrize("limits", [{"free": 50, "pro": 500}, {"free": 1, "pro": 2}, {"free": 0, "pro": 0}])
def test_quota_equals_a_replay(spark, limits):
    rows, frame = requests(spark)
    called = tenants.with_caller(frame, *directory(spark), legacy=("old",))
    got = {r.id for r in tenants.quota_decisions(called, limits).where("blocked").select("id").collect()}
    assert got == replay(rows, limits) and got


def test_quota_stream_over_many_batches(spark, tmp_path):
    rows, _ = requests(spark, 900, seed=5)
    rows.sort(key=lambda r: (r[1], r[0]))
    for part in range(3):
        chunk = rows[part * 300 : (part + 1) * 300]
        spark.createDataFrame(chunk, "id long, ts timestamp, route string, ip string, key_text string") \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    limits = {"free": 5, "pro": 40}
    source = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    called = tenants.with_caller(source, *directory(spark), legacy=("old",))
    jobs.quota_stream(called, str(tmp_path / "out"), str(tmp_path / "cp"), limits).awaitTermination()
    log = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert log.select("batch_id").distinct().count() == 3 and log.count() == 900
    assert {r.id for r in log.where("blocked").select("id").collect()} == replay(rows, limits)


def quota_log(spark, tmp_path, limits, out):
    source = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    called = tenants.with_caller(source, *directory(spark), legacy=("old",))
    jobs.quota_stream(called, str(tmp_path / out), str(tmp_path / "cp"), limits).awaitTermination()
    return spark.read.option("basePath", str(tmp_path / out)).parquet(str(tmp_path / out))


def test_quota_stream_goes_on_after_a_restart(spark, tmp_path):
    """Counts are in the checkpoint: a second run decides new rows as if it had never stopped, without the first one's output."""
    rows, _ = requests(spark, 1200, seed=9)
    rows.sort(key=lambda r: (r[1], r[0]))
    limits, decided = {"free": 7, "pro": 60}, {}
    for run in ("first", "second"):
        for part in range(2):
            at = 600 * (run == "second") + 300 * part
            spark.createDataFrame(rows[at : at + 300], "id long, ts timestamp, route string, ip string, key_text string") \
                .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new = {r.id: r.blocked for r in quota_log(spark, tmp_path, limits, run).collect()}
        assert len(new) == 600 and not new.keys() & decided.keys()
        decided |= new
    assert {i for i, blocked in decided.items() if blocked} == replay(rows, limits)
    assert list((tmp_path / "cp" / "state").rglob("*.zip")), "the counts are in a RocksDB state store"


def test_quota_stream_keeps_state_by_bucket(spark, tmp_path):
    """Hundreds of accounts over three days share four values of state, and are decided as one by one."""
    rnd = random.Random(3)
    plain = [(i, START + timedelta(hours=rnd.randint(0, 60)), rnd.choice(["code", "code", "archive"]), rnd.choice([None, "anon", *(f"user:{j}" for j in range(150))]))
             for i in range(3000)]
    plain.sort(key=lambda r: (r[1], r[0]))
    schema = "id long, ts timestamp, route string, caller string"
    for part in range(2):
        spark.createDataFrame(plain[part * 1500 : (part + 1) * 1500], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    called = stream.withColumns({"valid": F.lit(True), "plan": F.when(F.col("caller") < "user:3", "pro")})
    query = jobs.quota_stream(called, str(tmp_path / "out"), str(tmp_path / "cp"), {"free": 4, "pro": 9}, buckets=4)
    query.awaitTermination()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]] == [4, 4]
    used, want = {}, set()
    for i, ts, route, caller in plain:
        n = used.get((caller, ts.date()), 0)
        if caller == "anon":
            continue
        if route == "code" and n >= (9 if caller and caller < "user:3" else 4):
            want.add(i)
        else:
            used[caller, ts.date()] = n + 1
    log = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).collect()
    assert len(log) == 3000 and {r.id for r in log if r.blocked} == want and want
    assert all(r.consumed == (r.caller != "anon" and not r.blocked) for r in log)


def test_streams_read_tables_of_several_files(spark, tmp_path):
    """A table may be one file or a folder of part files."""
    docs = spark.createDataFrame([(i, "web", f"text {i}\napi_key") for i in range(60)], "doc_id long, source string, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = stream_queries.QUERIES["ST01_scan_stream"](spark, str(tmp_path))
    want = scan_queries.QUERIES["scan_corpus"](spark, str(tmp_path)).select(got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 0


def test_sums_take_late_rows_and_repeated_batches(spark, tmp_path):
    """Twelve batches in any order of time: no row is refused, and a batch that is done again counts once."""
    rnd = random.Random(6)
    rows = [(i, START + timedelta(seconds=rnd.randint(-500_000, 500_000)), f"k{rnd.randint(0, 3)}", rnd.randint(0, 9),
             rnd.choice(["ok", "ok", "error"]), rnd.choice([None, 5, 11])) for i in range(600)]
    schema = "id long, ts timestamp, key_id string, findings int, status string, duration_ms int"
    for part in range(12):
        spark.createDataFrame(rows[part::12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.createDataFrame(rows, schema)
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    jobs.rollup_stream(stream, str(tmp_path / "sums"), str(tmp_path / "cp")).awaitTermination()
    again = spark.read.parquet(str(tmp_path / "sums" / "batch_id=3"))
    rows_of = again.collect()
    spark.createDataFrame(rows_of, again.schema).write.mode("overwrite").parquet(str(tmp_path / "sums" / "batch_id=3"))
    kept = usage.read_rollup(spark, str(tmp_path / "sums"))
    whole = usage.partial_sums(log)
    assert sorted(map(tuple, kept.select(whole.columns).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    total = usage.all_time(kept).first()
    timed = [r[5] for r in rows if r[4] == "ok" and r[5] is not None]
    assert (total.total_scans, total.errors) == (600, sum(r[4] != "ok" for r in rows))
    assert total.avg_duration_ms == pytest.approx(sum(timed) / len(timed))
    assert usage.all_time(whole.limit(0)).first() == (0, 0, 0.0)
    limited = log.select("id", "ts", F.lit("code").alias("route"), F.col("key_id").alias("bucket"), F.lit(1).alias("minute_limit"))
    wide = stream.select("id", "ts", F.lit("code").alias("route"), F.col("key_id").alias("bucket"), F.lit(1).alias("minute_limit"))
    jobs.rate_rollup_stream(wide, str(tmp_path / "rates"), str(tmp_path / "cp2")).awaitTermination()
    rates = jobs.read_rates(spark, str(tmp_path / "rates"))
    want = tenants.rate_counts(limited)
    assert sorted(map(tuple, rates.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_running_sums_of_a_hot_group(spark, tmp_path):
    """One group holds half of all rows, several groups end and begin in one partition, and keys may be null."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["hot"] * 6 + [f"g{j}" for j in range(5)] + [None]), rnd.randint(0, 40), rnd.randint(0, 3)) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id long, g string, t long, w int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix.running(frame, ["g"], ["t", "id"], F.col("w"), str(tmp_path / "run")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, sums = {}, {}
    for i, g, t, w in sorted(rows, key=lambda r: (r[2], r[0])):
        sums[g] = want[i] = sums.get(g, 0) + w
    assert {r.id: r.running for r in got} == want and len(got) == 6000
    kept = spark.read.parquet(str(tmp_path / "run"))
    assert kept.where("g = 'hot'").select("_part").distinct().count() > 1  # not one task's
    assert prefix.running(frame.limit(0), ["g"], ["t", "id"], F.col("w"), str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        prefix.running(frame.withColumn("running", F.lit(1)), ["g"], ["t"], F.col("w"), str(tmp_path / "bad"))


def test_quotas_read_the_log_once(spark):
    _, frame = requests(spark, 200)
    called = tenants.with_caller(frame, *directory(spark), legacy=("old",))
    for decided in (tenants.quota_decisions(called, {"free": 1, "pro": 2}), tenants.rate_violations(tenants.with_rate_limit(called))):
        plan = decided._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "key_hash" not in plan.split("Relation")[0]


def test_callers_and_limits(spark):
    rows, frame = requests(spark, 300)
    called = tenants.with_rate_limit(tenants.with_caller(frame, *directory(spark), legacy=("old",))).collect()
    for r in called:
        key = (r.key_text or "").strip()
        assert r.caller == LABELS.get(key, "anon")
        assert r.valid == (not key or key in LABELS)
        assert r.minute_limit == {"hot": 300, "old": 300}.get(key, 30)
        assert r.bucket.startswith("key:") == bool(key)
        if key == "k1":
            assert r.bucket == "key:12"
        if not key:
            assert r.bucket == f"ip:{r.ip}"


@pytest.mark.parametrize("limit, want", [(500, 300), (0, 800), (-1, 800), (799, 1), (800, 0), (1, 799)])
def test_rate_violations_of_any_limit(spark, limit, want):
    start = F.lit("2024-03-01 10:00:00").cast("timestamp") + F.make_dt_interval(secs=(F.col("id") % 60).cast("decimal(18,6)"))
    flood = spark.range(800).select(
        "id", start.alias("ts"), F.lit("code").alias("route"), F.lit("key:1").alias("bucket"), F.lit(limit).alias("minute_limit")
    )
    rows = sorted((r.ts, r.id) for r in flood.collect())
    got = {r.id for r in tenants.rate_violations(flood).collect()}
    assert got == {i for _, i in rows[max(0, limit):]} and len(got) == want
    assert tenants.rate_counts(flood).first().over == min(want, 800 - max(limit, 0)) if limit >= 0 else True


def test_building_a_lookup_runs_no_job(spark):
    _, frame = requests(spark, 100)
    keys, users = directory(spark)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    tenants.with_caller(frame, keys, users, ("old",))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_rate_violations_equal_a_count(spark):
    rows, frame = requests(spark, 3000)
    called = tenants.with_rate_limit(tenants.with_caller(frame, *directory(spark), legacy=("old",)))
    called = called.withColumn("minute_limit", F.lit(3))
    seen, want = {}, set()
    for r in sorted(called.select("id", "ts", "route", "bucket").collect(), key=lambda r: (r.ts, r.id)):
        slot = (r.route, r.bucket, r.ts.replace(second=0))
        seen[slot] = seen.get(slot, 0) + 1
        if seen[slot] > 3:
            want.add(r.id)
    assert {r.id for r in tenants.rate_violations(called).select("id").collect()} == want and want


def test_first_per_group_with_a_hot_group(spark):
    frame = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"))
    got = topk.first_per_group(frame, ["g"], [F.desc("id")], 4, "id").collect()
    want = {}
    for i in range(19999, -1, -1):
        g = 0 if i % 3 == 0 else i % 50
        if len(want.setdefault(g, [])) < 4:
            want[g].append(i)
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r.g, []).append(r.id)
    assert mine == want


def test_registration_rules(spark):
    regs = spark.createDataFrame(
        [(1, " n@x ", "pro", "key_one1x"), (2, "n@x", "free", "key_two2x"), (3, "b@x", "pro", "key_thr3x"), (4, "", "free", "k"),
         (5, "no-at", "free", "k"), (6, "y@" + "z" * 260, "free", "k"), (7, "q@x", "gold", "k"), (8, "q@x", None, "key_fou4x")],
        "seq long, email string, plan string, key_text string",
    )
    _, users = directory(spark)
    checked = tenants.check_registrations(regs)
    assert {r.seq: r.reason for r in checked.collect()} == {
        1: None, 2: None, 3: None, 4: "email", 5: "email", 6: "email", 7: "plan", 8: None}
    valid = checked.where("reason IS NULL")
    assert {(r.email, r.plan) for r in tenants.new_users(users, valid).collect()} == {("n@x", "pro"), ("q@x", "free")}
    rows = {r.seq: r for r in tenants.register_keys(users, valid).collect()}
    # A pro key of a free user: the minute limit is pro, the day stays free.
    assert (rows[3].rate_limit, rows[3].daily_limit, rows[3].key_prefix) == (300, 50, "key_thr3")
    assert (rows[2].rate_limit, rows[2].daily_limit) == (30, 500)


def test_log_holds_nothing_private(spark, tmp_path):
    code = "pwd = 'very-private-one'"
    scans = scan.scan_requests(spark.createDataFrame([(1, "a.py", code)], "id long, filename string, code string"))
    outcome = scans.select(
        "id", F.lit("2024-03-01 10:00:00.9").cast("timestamp").alias("ts"), F.lit("anon").alias("key_id"),
        F.lit("192.0.2.77").alias("ip"), F.length("code").alias("size"), "total", "summary.*",
        F.lit(7.9).alias("duration_ms"), "status", F.lit(None).cast("long").alias("owner_id"),
    )
    rows = usage.log_rows(outcome, "pepper")
    assert tuple(rows.columns) == usage.LOG_COLUMNS
    tables.append_usage(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log")).collect()[0]
    assert "private" not in str(back) and "192.0.2.77" not in str(back)
    assert (back.findings, back.high, back.duration_ms, len(back.ip_hash)) == (1, 1, 7, 16)
    assert str(back.ts) == "2024-03-01 10:00:00"
    assert usage.log_rows(outcome, None).first().ip_hash == "pepper-unset"


def test_daily_window_drops_the_oldest_date(spark):
    log = spark.range(40).select(
        "id", (F.lit("2024-03-10 12:00:00").cast("timestamp") - F.make_dt_interval(F.col("id") % 20)).alias("ts"),
        F.lit("k").alias("key_id"), F.lit(2).alias("findings"), F.lit("ok").alias("status"), F.lit(4).alias("duration_ms"),
    )
    since = usage.window_start(datetime(2024, 3, 10, 11, 0), 3)
    days = [str(r.date) for r in usage.daily(log, since, 3).collect()]
    assert days == ["2024-03-10", "2024-03-09", "2024-03-08"]
    stats = usage.stats(log.where("id < 0"), since, 3).collect()
    assert {r.item: r.value for r in stats} == {"total_all_time": 0, "total_last_days": 0, "errors": 0, "avg_duration_ms": 0}


def test_window_prunes_days_and_reaches_the_reader(spark, tmp_path):
    log = spark.range(40).select(
        "id", (F.lit("2024-03-10 12:00:00").cast("timestamp") - F.make_dt_interval(F.col("id") % 20)).alias("ts"),
        F.lit("k").alias("key_id"), F.lit(2).alias("findings"),
    )
    tables.append_usage(log, str(tmp_path / "log"))
    recent = usage.daily(tables.read_usage(spark, str(tmp_path / "log")), datetime(2024, 3, 8, 12, 0), 14)
    assert [(str(r.date), r.scans) for r in recent.collect()] == [("2024-03-10", 2), ("2024-03-09", 2), ("2024-03-08", 2)]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "ts_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in plan


def test_admission(spark):
    bodies = {
        "none": '{"filename": "a"}', "list": "[1]", "text": "oops", "null": '{"code": null}', "number": '{"code": 1}',
        "name": '{"code": "x", "filename": 1}', "nullname": '{"code": "x", "filename": null}',
        "longname": '{"code": "x", "filename": "%s"}' % ("n" * 256), "long": '{"code": "%s"}' % ("x" * 100001),
        "blank": '{"code": " \\n\\u00a0\\u001c"}', "ok": '{"code": "%s", "filename": "%s"}' % ("x" * 100000, "n" * 255), "default": '{"code": "x"}',
    }
    frame = spark.createDataFrame(list(bodies.items()), "id string, body string")
    got = {r.id: (r.reason, r.filename) for r in admission.with_admission(frame).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "none": "no_code", "list": "no_code", "text": "no_code", "null": "code_not_text", "number": "code_not_text",
        "name": "bad_filename", "nullname": "bad_filename", "longname": "bad_filename", "long": "code_too_long",
        "blank": "blank", "ok": "scan", "default": "scan"}
    assert got["default"][1] == "input.py"
    results, blank, refused = scan.scan_bodies(frame)
    assert (results.count(), blank.count(), refused.count()) == (2, 1, 9)
    results, blank, refused = scan.scan_bodies(frame, max_chars=None)
    assert (results.count(), blank.count(), refused.count()) == (3, 1, 8)
