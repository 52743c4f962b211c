"""Usage log, tenants, quotas, rates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from leakloom.functions import catalog, digests
from leakloom.operators import tenants, usage
from leakloom.plans import accounts, gate
from leakloom.sources import tables
from registry import views as v

QUERIES, ORACLES = {}, {}

AS_OF = datetime(2024, 1, 31, 9, 30)
DAYS = 14
SINCE = usage.window_start(AS_OF, DAYS)
_IN = f"ts >= TIMESTAMP '{SINCE}'"
PEPPER = "test-pepper"

_SCANS = f"WITH scans AS ({v.SCANS_SQL})"


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def ts_text(name="ts"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def log_input(spark, sf):
    """Scan outcomes whose totals and counts are partly missing."""
    s = v.scans(spark, sf)
    return s.withColumns(
        {
            "total": F.when(F.col("id") % 3 == 0, F.col("findings")).when(F.col("id") % 3 == 1, 0),
            "low": F.when(F.col("id") % 5 != 0, F.col("low")),
            "status": F.when((F.col("id") % 9 == 0) & (F.col("status") == "ok"), None).otherwise(F.col("status")),
        }
    )


_LOG_SQL = f"""{_SCANS}, log AS (
SELECT id, date_trunc('second', ts) AS ts, key_id, left(sha256('{PEPPER}:' || ip), 16) AS ip_hash, size,
  CASE WHEN id % 3 = 0 AND findings <> 0 THEN findings
    ELSE critical + high + medium + CASE WHEN id % 5 <> 0 THEN low ELSE 0 END END AS findings,
  critical, high, medium, CASE WHEN id % 5 <> 0 THEN low ELSE 0 END AS low, duration_ms, status, owner_id
FROM scans)"""

add(
    "A05_findings_total",
    lambda spark, sf: log_input(spark, sf).select(
        "id",
        usage.findings_total(F.col("total"), *[F.col(s) for s in catalog.SEVERITIES])
        .cast("int").alias("findings"),
    ),
    f"{_LOG_SQL} SELECT id, findings FROM log",
)
add(
    "U01_address_pseudonym",
    lambda spark, sf: v.requests(spark, sf).select(
        "id", digests.address_pseudonym(F.col("ip"), PEPPER).alias("ip_hash"),
        digests.address_pseudonym(F.col("ip"), None).alias("unsalted"),
    ),
    f"WITH r AS ({v.REQUESTS_SQL}) SELECT id, left(sha256('{PEPPER}:' || ip), 16) AS ip_hash, "
    "'pepper-unset' AS unsalted FROM r",
)
_LOG_COLS = [c for c in usage.LOG_COLUMNS if c != "ts"]
add(
    "U02_log_rows",
    lambda spark, sf: usage.log_rows(log_input(spark, sf), PEPPER).select(ts_text(), *_LOG_COLS),
    f"{_LOG_SQL} SELECT {_TS}, {', '.join(_LOG_COLS)} FROM log",
)


def append_sink(spark, sf):
    path = v.work_dir(spark, "usage")
    rows = usage.log_rows(v.scans(spark, sf).withColumn("total", F.col("findings")), PEPPER)
    tables.append_usage(rows.where(F.col("status") == "ok"), path)
    tables.append_usage(rows.where(F.col("status") != "ok"), path)
    return (
        tables.read_usage(spark, path)
        .groupBy(F.col("ts_date").cast("string").alias("ts_date"), "status")
        .agg(F.count("*").alias("scans"), F.sum("findings").alias("findings"))
    )


add(
    "S12_usage_append",
    append_sink,
    f"{_SCANS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS ts_date, status, count(*) AS scans, "
    "CAST(sum(findings) AS BIGINT) AS findings FROM scans GROUP BY 1, 2",
)
add("U03_total_scans", lambda spark, sf: usage.total_scans(v.scans(spark, sf)),
    f"{_SCANS} SELECT count(*) AS total_all_time FROM scans")
add("U04_scans_in_window", lambda spark, sf: usage.scans_since(v.scans(spark, sf), SINCE),
    f"{_SCANS} SELECT count(*) FILTER ({_IN}) AS total_last_days FROM scans")
_SUMS = "count(*) AS scans, CAST(coalesce(sum(findings), 0) AS BIGINT) AS findings"
_DAILY = (
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {_SUMS} FROM scans "
    f"WHERE {_IN} GROUP BY 1 ORDER BY 1 DESC LIMIT {DAYS}"
)
add(
    "U05_daily",
    lambda spark, sf: usage.daily(v.scans(spark, sf), SINCE, DAYS).withColumn("date", F.col("date").cast("string")),
    f"{_SCANS} {_DAILY}",
)
_BY_KEY = f"SELECT key_id AS key, {_SUMS} FROM scans WHERE {_IN} GROUP BY 1"
add("U06_by_key", lambda spark, sf: usage.by_key(v.scans(spark, sf), SINCE), f"{_SCANS} {_BY_KEY}")
add("U07_errors", lambda spark, sf: usage.errors(v.scans(spark, sf)),
    f"{_SCANS} SELECT count(*) FILTER (status <> 'ok') AS errors FROM scans")
add("U08_mean_duration", lambda spark, sf: usage.mean_duration(v.scans(spark, sf)),
    f"{_SCANS} SELECT coalesce(avg(CASE WHEN status = 'ok' THEN duration_ms END), 0) AS avg_duration_ms FROM scans")
_TOTAL = (
    "SELECT 'total' AS section, '{0}' AS item, CAST(NULL AS BIGINT) AS scans, "
    "CAST(NULL AS BIGINT) AS findings, CAST({1} AS DOUBLE) AS value FROM scans"
)
add(
    "U09_stats",
    lambda spark, sf: usage.stats(v.scans(spark, sf), SINCE, DAYS),
    f"{_SCANS} "
    + " UNION ALL ".join(
        [
            _TOTAL.format("total_all_time", "count(*)"),
            _TOTAL.format("total_last_days", f"count(*) FILTER ({_IN})"),
            _TOTAL.format("errors", "count(*) FILTER (status <> 'ok')"),
            _TOTAL.format("avg_duration_ms", "coalesce(avg(duration_ms) FILTER (status = 'ok'), 0)"),
            f"SELECT 'daily', date, scans, findings, NULL FROM ({_DAILY})",
            f"SELECT 'by_key', key, scans, findings, NULL FROM ({_BY_KEY})",
        ]
    ),
)
_PLAIN_LOG = f"""{_SCANS}, log AS (SELECT *, left(sha256('{PEPPER}:' || ip), 16) AS ip_hash FROM scans)"""


def plain_log(spark, sf):
    return v.scans(spark, sf).withColumn("ip_hash", digests.address_pseudonym(F.col("ip"), PEPPER))


add(
    "U10_latest",
    lambda spark, sf: usage.latest(plain_log(spark, sf), 50).withColumn("ts", ts_text()),
    f"{_PLAIN_LOG} SELECT {_TS}, key_id, ip_hash, size, findings, duration_ms, status "
    "FROM log ORDER BY id DESC LIMIT 50",
)
_OWNER = "key_id, size, findings, duration_ms, status"
add(
    "U11_latest_of_owner",
    lambda spark, sf: usage.latest_of_owner(plain_log(spark, sf), 7, 1000).withColumn("ts", ts_text()),
    f"{_PLAIN_LOG} SELECT {_TS}, {_OWNER} FROM log WHERE owner_id = 7 ORDER BY id DESC LIMIT 100",
)
add(
    "U11_latest_per_owner",
    lambda spark, sf: usage.latest_per_owner(plain_log(spark, sf), 5).withColumn("ts", ts_text()),
    f"""{_PLAIN_LOG} SELECT owner_id, id, {_TS}, {_OWNER}, CAST(rank AS INT) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY id DESC) AS rank FROM log) WHERE rank <= 5""",
)
add(
    "U12_owner_column",
    lambda spark, sf: usage.read_log(
        [
            v.scans(spark, sf).where("status = 'error'").drop("owner_id").select("id", "key_id"),
            v.scans(spark, sf).where("status = 'ok'").select("id", "key_id", "owner_id"),
        ]
    ),
    f"{_SCANS} SELECT id, key_id, CASE WHEN status = 'ok' THEN owner_id END AS owner_id FROM scans",
)

# --- users and keys ---------------------------------------------------------------

_REGS = f"WITH users AS ({v.USERS_SQL}), api_keys AS ({v.API_KEYS_SQL}), regs AS ({v.REGISTRATIONS_SQL})"
_VALID = "(email LIKE '%@%' AND length(email) <= 254 AND plan IN ('free', 'pro'))"
_NEW = f"""new_users AS (SELECT email, arg_min(plan, seq) AS plan,
  strftime(min(make_timestamp((1704067200 + seq) * 1000000)), '%Y-%m-%d %H:%M:%S') AS created_at FROM regs WHERE {_VALID}
  AND email NOT IN (SELECT email FROM users) GROUP BY email)"""


def valid_regs(spark, sf):
    regs = v.registrations(spark, sf).withColumn("created_at", F.timestamp_seconds(F.col("seq") + 1704067200))
    return tenants.check_registrations(regs).where("reason IS NULL")


def _made(digest):
    return f"(CAST('0x' || left({digest}, 15) AS BIGINT) + 1152921504606846976)"


add(
    "K01_user_upsert",
    lambda spark, sf: tenants.upsert_users(v.users(spark, sf), valid_regs(spark, sf)).withColumn("created_at", ts_text("created_at")),
    f"""{_REGS}, {_NEW} SELECT id, email, plan, NULL AS created_at FROM users
UNION ALL SELECT {_made("md5(email)")}, email, plan, created_at FROM new_users""",
)
add(
    "K02_key_registration",
    lambda spark, sf: tenants.register_keys(v.users(spark, sf), valid_regs(spark, sf)).withColumn("created_at", ts_text("created_at")),
    f"""{_REGS}, {_NEW}, everyone AS (SELECT id, email, plan FROM users UNION ALL SELECT {_made("md5(email)")}, email, plan FROM new_users)
SELECT r.seq, r.email, {_made("sha256(r.key_text)")} AS id,
  strftime(make_timestamp((1704067200 + seq) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at, sha256(r.key_text) AS key_hash, left(r.key_text, 8) AS key_prefix,
  CASE WHEN r.plan = 'pro' THEN 300 ELSE 30 END AS rate_limit, false AS revoked, e.id AS user_id,
  CASE WHEN e.plan = 'pro' THEN 500 ELSE 50 END AS daily_limit
FROM regs r JOIN everyone e USING (email) WHERE r.email LIKE '%@%' AND r.plan IN ('free', 'pro')""",
)


def key_lifecycle(spark, sf):
    """Register keys, use them, revoke some by id, use them again."""
    regs = valid_regs(spark, sf)
    users, keys = v.users(spark, sf), v.api_keys(spark, sf)
    everyone = tenants.upsert_users(users, regs)
    stored = keys.unionByName(tenants.register_keys(users, regs), allowMissingColumns=True)
    calls = regs.select(
        F.col("seq").alias("id"), F.timestamp_seconds(F.col("seq")).alias("ts"), F.lit("code").alias("route"),
        F.lit("10.0.0.1").alias("ip"), "key_text",
    )
    before = tenants.with_caller(calls, stored, everyone)
    gone = before.where(F.col("id") % 3 == 0).select(F.col("caller_key_id").alias("id"))
    after = tenants.with_caller(calls, tenants.revoke(stored, gone, by="id"), everyone)
    return before.select(F.col("id").alias("seq"), "user_id", "caller", "valid").join(
        after.select(F.col("id").alias("seq"), F.col("caller").alias("caller_after"), F.col("valid").alias("valid_after")), "seq"
    )


add(
    "K02_key_lifecycle",
    key_lifecycle,
    f"""{_REGS}, {_NEW}, everyone AS (SELECT id, email FROM users UNION ALL SELECT {_made("md5(email)")}, email FROM new_users)
SELECT r.seq, e.id AS user_id, 'user:' || r.email || ' key:' || left(r.key_text, 8) AS caller, true AS valid,
  CASE WHEN r.seq % 3 = 0 THEN 'anon' ELSE 'user:' || r.email || ' key:' || left(r.key_text, 8) END AS caller_after,
  r.seq % 3 <> 0 AS valid_after
FROM regs r JOIN everyone e USING (email) WHERE r.email LIKE '%@%' AND r.plan IN ('free', 'pro')""",
)
add(
    "K03_registration_check",
    lambda spark, sf: tenants.check_registrations(v.registrations(spark, sf)).select("seq", "email", "plan", "reason"),
    f"""{_REGS} SELECT seq, email, plan, CASE WHEN email NOT LIKE '%@%' THEN 'email'
  WHEN plan NOT IN ('free', 'pro') THEN 'plan' END AS reason FROM regs""",
)
_CALLED = f"""WITH users AS ({v.USERS_SQL}), api_keys AS ({v.API_KEYS_SQL}), requests AS ({v.REQUESTS_SQL}),
called AS (SELECT r.*, k.id AS key_id, k.user_id, k.key_prefix, k.rate_limit, u.email, u.plan,
    k.id IS NOT NULL AS registered, coalesce(r.key_text = '{v.LEGACY_KEYS[0]}', false) AS legacy,
    CASE WHEN k.id IS NOT NULL THEN 'user:' || u.email || ' key:' || k.key_prefix
      WHEN r.key_text = '{v.LEGACY_KEYS[0]}' THEN 'key:' || left(r.key_text, 8) ELSE 'anon' END AS caller,
    CASE WHEN k.id IS NOT NULL THEN 'key:' || CAST(k.id AS VARCHAR)
      WHEN r.key_text IS NOT NULL THEN 'key:' || left(sha256(r.key_text), 16) ELSE 'ip:' || r.ip END AS bucket
  FROM requests r
  LEFT JOIN (SELECT * FROM api_keys WHERE NOT revoked) k ON k.key_hash = sha256(r.key_text)
  LEFT JOIN users u ON u.id = k.user_id)"""


def called(spark, sf):
    return tenants.with_caller(
        v.requests(spark, sf), v.api_keys(spark, sf), v.users(spark, sf), v.LEGACY_KEYS
    )


add(
    "K04_key_lookup",
    lambda spark, sf: called(spark, sf).select("id", "caller_key_id", "user_id", "email", "plan", "caller_rate"),
    f"{_CALLED} SELECT id, key_id AS caller_key_id, user_id, email, plan, rate_limit AS caller_rate FROM called",
)


_CALLED_THEN = f"""WITH users AS ({v.USERS_SQL}), api_keys AS ({v.TIMED_API_KEYS_SQL}), requests AS ({v.REQUESTS_SQL}),
called AS (SELECT r.*, k.id AS key_id, u.plan, k.id IS NOT NULL AS registered, coalesce(r.key_text = '{v.LEGACY_KEYS[0]}', false) AS legacy,
    CASE WHEN k.id IS NOT NULL THEN 'user:' || u.email || ' key:' || k.key_prefix
      WHEN r.key_text = '{v.LEGACY_KEYS[0]}' THEN 'key:' || left(r.key_text, 8) ELSE 'anon' END AS caller
  FROM requests r
  LEFT JOIN api_keys k ON k.key_hash = sha256(r.key_text) AND k.created_at <= r.ts AND (k.revoked_at IS NULL OR r.ts < k.revoked_at)
  LEFT JOIN users u ON u.id = k.user_id)"""


def called_then(spark, sf):
    keys = v.timed_api_keys(spark, sf)
    return tenants.with_caller(v.requests(spark, sf), keys, v.users(spark, sf), v.LEGACY_KEYS, as_of_request=True)


add(
    "K04_key_at_request",
    lambda spark, sf: called_then(spark, sf).select("id", "caller_key_id", "caller"),
    f"{_CALLED_THEN} SELECT id, key_id AS caller_key_id, caller FROM called",
)
add(
    "K14_validity_at_request",
    lambda spark, sf: called_then(spark, sf).select("id", "valid"),
    f"{_CALLED_THEN} SELECT id, key_text IS NULL OR registered OR legacy AS valid FROM called",
)


def revoked_prefixes(spark, sf):
    keys = v.api_keys(spark, sf)
    some = keys.where(F.col("id") % 9 == 0).select("key_prefix")
    return keys, some.union(spark.createDataFrame([("nobody__",)], "key_prefix string"))


def _id_targets(spark, sf):
    return v.api_keys(spark, sf).where("id % 8 = 3").select((F.col("id") * 3).alias("id"))


add(
    "K05_revoke_prefix",
    lambda spark, sf: tenants.revoke(*revoked_prefixes(spark, sf), by="key_prefix").select("id", "key_prefix", "revoked"),
    f"""WITH api_keys AS ({v.API_KEYS_SQL}) SELECT id, key_prefix,
  revoked OR key_prefix IN (SELECT key_prefix FROM api_keys WHERE id % 9 = 0) AS revoked FROM api_keys""",
)
add(
    "K05_revoke_outcome",
    lambda spark, sf: tenants.revoke_outcome(*revoked_prefixes(spark, sf), by="key_prefix"),
    f"""WITH api_keys AS ({v.API_KEYS_SQL}) SELECT DISTINCT key_prefix,
  key_prefix IN (SELECT key_prefix FROM api_keys WHERE NOT revoked) AS changed
FROM (SELECT key_prefix FROM api_keys WHERE id % 9 = 0 UNION ALL SELECT 'nobody__')""",
)
add(
    "K06_revoke_id",
    lambda spark, sf: tenants.revoke(v.api_keys(spark, sf), _id_targets(spark, sf), by="id").select("id", "revoked"),
    f"""WITH api_keys AS ({v.API_KEYS_SQL}) SELECT id,
  revoked OR id IN (SELECT id * 3 FROM api_keys WHERE id % 8 = 3) AS revoked FROM api_keys""",
)
add(
    "K07_key_listing",
    lambda spark, sf: tenants.list_keys(v.api_keys(spark, sf), v.users(spark, sf)),
    f"""WITH users AS ({v.USERS_SQL}), api_keys AS ({v.API_KEYS_SQL})
SELECT k.id, key_prefix, rate_limit, revoked, email, plan FROM api_keys k JOIN users u ON u.id = k.user_id""",
)


def legacy_lists(spark, sf):
    c = F.col("c_custkey")
    key = lambda x: F.concat(F.lit("k_"), F.left(F.md5(x.cast("string")), F.lit(18)))
    return v.table(spark, sf, "customer").select(
        F.concat(F.lit(" , "), key(c * 2), F.lit(" ,"), F.lit("old_"), F.floor(c / 2).cast("string"), F.lit(",")).alias("env_keys")
    )


add(
    "K08_legacy_seed",
    lambda spark, sf: tenants.seed_legacy(v.api_keys(spark, sf), legacy_lists(spark, sf), v.users(spark, sf)),
    f"""WITH api_keys AS ({v.API_KEYS_SQL}), listed AS (
  SELECT 'k_' || left(md5(CAST(c_custkey * 2 AS VARCHAR)), 18) AS k FROM customer
  UNION SELECT 'old_' || CAST(c_custkey // 2 AS VARCHAR) FROM customer)
SELECT sha256(k) AS key_hash, 'legacy@local' AS email, left(k, 8) AS key_prefix, 30 AS rate_limit, false AS revoked,
  {_made("sha256(k)")} AS id, {_made("md5('legacy@local')")} AS user_id
FROM listed WHERE sha256(k) NOT IN (SELECT key_hash FROM api_keys)""",
)


def durable_accounts(spark, sf):
    """Four jobs in a row on stored tables: the first users and keys, registrations, revocations, legacy keys."""
    path = v.work_dir(spark, "accounts")
    accounts.store(spark, path, v.users(spark, sf), v.api_keys(spark, sf))
    accounts.register(spark, path, v.registrations(spark, sf).withColumn("created_at", F.timestamp_seconds(F.col("seq") + 1704067200)))
    registered = accounts.keys(spark, path).where("created_at IS NOT NULL AND rate_limit = 300")
    accounts.revoke(spark, path, registered.select("id").union(_id_targets(spark, sf)), by="id", at="2024-02-01 00:00:00")
    accounts.seed_legacy(spark, path, legacy_lists(spark, sf))
    owners = accounts.users(spark, path).select(F.col("id").alias("user_id"), "email", "plan")
    return accounts.keys(spark, path).join(owners, "user_id").select(
        "id", "email", "plan", "key_prefix", "rate_limit", "revoked", F.col("revoked_at").isNotNull().alias("revoked_here")
    )


add(
    "K02_durable_accounts",
    durable_accounts,
    f"""{_REGS}, {_NEW}, listed AS (SELECT 'k_' || left(md5(CAST(c_custkey * 2 AS VARCHAR)), 18) AS k FROM customer
  UNION SELECT 'old_' || CAST(c_custkey // 2 AS VARCHAR) FROM customer),
everyone AS (SELECT id, email, plan FROM users UNION ALL SELECT {_made("md5(email)")}, email, plan FROM new_users
  UNION ALL SELECT {_made("md5('legacy@local')")}, 'legacy@local', 'free'),
stored AS (SELECT id, user_id, key_prefix, rate_limit, revoked, id IN (SELECT id * 3 FROM api_keys WHERE id % 8 = 3) AS hit FROM api_keys
  UNION ALL SELECT {_made("sha256(r.key_text)")}, e.id, left(r.key_text, 8), CASE WHEN r.plan = 'pro' THEN 300 ELSE 30 END, false, r.plan = 'pro'
  FROM regs r JOIN everyone e USING (email) WHERE r.email LIKE '%@%' AND length(r.email) <= 254 AND r.plan IN ('free', 'pro')
  UNION ALL SELECT {_made("sha256(k)")}, {_made("md5('legacy@local')")}, left(k, 8), 30, false, false
  FROM listed WHERE sha256(k) NOT IN (SELECT key_hash FROM api_keys))
SELECT s.id, email, plan, key_prefix, rate_limit, revoked OR hit AS revoked, hit AND NOT revoked AS revoked_here
FROM stored s JOIN everyone e ON e.id = s.user_id""",
)
add("K09_owner", lambda spark, sf: called(spark, sf).select("id", F.col("user_id").alias("owner_id")),
    f"{_CALLED} SELECT id, user_id AS owner_id FROM called")
add(
    "K10_scans_per_day",
    lambda spark, sf: tenants.scans_per_day(
        called(spark, sf).select(F.col("caller").alias("key_id"), "ts")
    ).withColumn("day", F.col("day").cast("string")),
    f"{_CALLED} SELECT caller AS key_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS used "
    "FROM called WHERE caller <> 'anon' GROUP BY 1, 2",
)
add(
    "K11_daily_limit",
    lambda spark, sf: called(spark, sf).select("id", tenants.daily_limit(F.col("plan")).alias("daily_limit")),
    f"{_CALLED} SELECT id, CASE WHEN plan = 'pro' THEN 500 ELSE 50 END AS daily_limit FROM called",
)
# The real limits never bind on these tables.
LIMITS = {"free": 1, "pro": 2}
_VALID_CALL = "(key_text IS NULL OR registered OR legacy)"
_QUOTA = f"""{_CALLED}, ranked AS (SELECT *, {_VALID_CALL} AS valid,
  sum(CASE WHEN {_VALID_CALL} THEN 1 ELSE 0 END) OVER (PARTITION BY caller, CAST(ts AS DATE) ORDER BY ts, id) AS nth
FROM called)
SELECT id, route, caller, caller <> 'anon' AND valid AND route = 'code'
  AND nth > CASE WHEN plan = 'pro' THEN {LIMITS['pro']} ELSE {LIMITS['free']} END AS blocked FROM ranked"""
add(
    "K12_quota_decisions",
    lambda spark, sf: tenants.quota_decisions(called(spark, sf), LIMITS).select("id", "route", "caller", "blocked"),
    _QUOTA,
)


def with_bodies(spark, sf):
    i = F.col("id")
    body = (
        F.when(i % 10 == 1, "{}").when(i % 10 == 2, '{"code": 3}').when(i % 10 == 3, '{"code": " "}')
        .otherwise(F.to_json(F.struct(F.concat(F.lit("x = "), i.cast("string")).alias("code"))))
    )
    return v.requests(spark, sf).withColumn("body", F.when(F.col("route") == "code", body))


add(
    "K12_request_outcomes",
    lambda spark, sf: gate.decide(
        with_bodies(spark, sf), v.api_keys(spark, sf), v.users(spark, sf), v.LEGACY_KEYS, LIMITS
    ).select("id", "route", "caller", "outcome"),
    f"""{_CALLED}, checked AS (SELECT *, {_VALID_CALL} AS valid, CASE id % 10 WHEN 1 THEN 'no_code'
  WHEN 2 THEN 'code_not_text' WHEN 3 THEN 'blank' ELSE 'scan' END AS reason FROM called),
counted AS (SELECT *, count(*) FILTER (valid AND (route = 'archive' OR reason = 'scan')) OVER (
  PARTITION BY caller, CAST(ts AS DATE) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM checked)
SELECT id, route, caller, CASE WHEN route = 'code' AND reason = 'no_code' THEN 'no_code'
  WHEN NOT valid THEN 'invalid_key'
  WHEN route = 'code' AND caller <> 'anon' AND used >= CASE WHEN plan = 'pro' THEN {LIMITS['pro']} ELSE {LIMITS['free']} END
    THEN 'daily_limit'
  WHEN route = 'archive' THEN 'scan' ELSE reason END AS outcome FROM counted""",
)
add("K13_caller_label", lambda spark, sf: called(spark, sf).select("id", "caller"),
    f"{_CALLED} SELECT id, caller FROM called")
add("K14_key_validity", lambda spark, sf: called(spark, sf).select("id", "valid"),
    f"{_CALLED} SELECT id, {_VALID_CALL} AS valid FROM called")
add("K15_rate_bucket", lambda spark, sf: called(spark, sf).select("id", "bucket"),
    f"{_CALLED} SELECT id, bucket FROM called")


def routed(spark, sf):
    """Requests of which some go to the routes that are limited by address."""
    i = F.col("id")
    route = (
        F.when(i % 17 == 0, "stats").when(i % 17 == 1, "history").when(i % 17 == 2, "keys")
        .otherwise(F.col("route"))
    )
    return tenants.with_rate_limit(called(spark, sf).withColumn("route", route))


_ROUTED = f"""{_CALLED}, routed AS (SELECT id, ts, ip, registered, legacy, rate_limit, bucket AS own_bucket,
  CASE id % 17 WHEN 0 THEN 'stats' WHEN 1 THEN 'history' WHEN 2 THEN 'keys' ELSE route END AS route FROM called),
limited AS (SELECT id, ts, route, CASE WHEN route IN ('code', 'archive') THEN own_bucket ELSE 'ip:' || ip END AS bucket,
  CASE route WHEN 'stats' THEN 10 WHEN 'history' THEN 60 WHEN 'keys' THEN 10
    ELSE CASE WHEN registered THEN rate_limit WHEN legacy THEN 300 ELSE 30 END END AS minute_limit FROM routed)"""
add("K16_minute_limit", lambda spark, sf: routed(spark, sf).select("id", "route", "bucket", "minute_limit"),
    f"{_ROUTED} SELECT id, route, bucket, minute_limit FROM limited")


def tightened(spark, sf):
    """One request per minute, so that the rule binds on sparse data."""
    return routed(spark, sf).withColumn("minute_limit", F.lit(1))


def crowded(spark, sf):
    """All requests of a day in one minute per address, with limits of 0, 1, 2, 301 and more."""
    limit = F.element_at(F.array(*map(F.lit, (0, 1, 2, 301, 350))), (F.dayofyear("ts") % 5 + 1).cast("int"))
    return called(spark, sf).select(
        "id", F.date_trunc("day", "ts").alias("ts"), F.lit("code").alias("route"), F.lit("all").alias("bucket"), limit.alias("minute_limit")
    )


_MINUTE = "strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute"
add(
    "K17_rate_counts",
    lambda spark, sf: tenants.rate_counts(tightened(spark, sf)).withColumn("minute", ts_text("minute")),
    f"""{_ROUTED} SELECT route, bucket, {_MINUTE}, count(*) AS requests, 1 AS minute_limit,
  greatest(0, count(*) - 1) AS over FROM limited GROUP BY 1, 2, 3""",
)
add(
    "K17_mixed_limits",
    lambda spark, sf: tenants.rate_violations(crowded(spark, sf)).select("id", "minute_limit", ts_text("minute")),
    f"""WITH r AS (SELECT id, date_trunc('day', ts) AS ts, ([0, 1, 2, 301, 350])[dayofyear(ts) % 5 + 1] AS minute_limit
  FROM ({v.REQUESTS_SQL}))
SELECT id, minute_limit, strftime(ts, '%Y-%m-%d %H:%M:%S') AS minute FROM r
QUALIFY row_number() OVER (PARTITION BY ts ORDER BY id) > minute_limit""",
)
add(
    "K17_rate_violations",
    lambda spark, sf: tenants.rate_violations(tightened(spark, sf)).select("id", "route", "bucket", ts_text("minute")),
    f"""{_ROUTED} SELECT id, route, bucket, {_MINUTE} FROM limited QUALIFY
  row_number() OVER (PARTITION BY route, bucket, date_trunc('minute', ts) ORDER BY ts, id) > 1""",
)
