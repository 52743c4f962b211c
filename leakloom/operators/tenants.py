"""Users, API keys, ownership, quotas and rates, evaluated over logs of requests.

Frames: users(id, email, plan), api_keys(id, user_id, key_hash, key_prefix, rate_limit,
revoked), requests(id, ts, route, ip, key_text). The request log is the large side. Keys
are joined to it by key; Spark sends them to all tasks when their measured size allows it and
handles skew otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakloom import session
from leakloom.functions import catalog, digests, text as tx
from leakloom.operators import prefix

SCAN_ROUTES = ("code", "archive")
# Ids made from a text lie above any serial number.
FIRST_MADE_ID = 2**60


def made_id(hex_digest: Column) -> Column:
    """An id from a hexadecimal digest: the same on every run, without a counter."""
    return F.conv(F.left(hex_digest, F.lit(15)), 16, 10).cast("long") + F.lit(FIRST_MADE_ID)


def _plan_value(plan: Column, values: dict[str, int]) -> Column:
    """Limit of a plan; unknown plans count as free."""
    expr = F.lit(values[catalog.DEFAULT_PLAN])
    for name, value in values.items():
        expr = F.when(plan == name, F.lit(value)).otherwise(expr)
    return expr


def daily_limit(plan: Column, values: dict[str, int] = catalog.PLAN_PER_DAY) -> Column:
    return _plan_value(plan, values)


# --- registration -----------------------------------------------------------------


def check_registrations(regs: DataFrame) -> DataFrame:
    """Trim and check registrations (seq, email, plan, key_text); adds ``reason``, null if valid."""
    email = tx.strip(F.coalesce("email", F.lit("")))
    plan = F.coalesce(F.nullif("plan", F.lit("")), F.lit(catalog.DEFAULT_PLAN))
    regs = regs.withColumns({"email": email, "plan": tx.strip(plan)})
    bad_email = (
        (F.col("email") == "")
        | ~F.contains("email", F.lit("@"))
        | (F.length("email") > catalog.MAX_EMAIL_CHARS)
    )
    known = F.col("plan").isin(*catalog.PLAN_PER_MINUTE)
    return regs.withColumn("reason", F.when(bad_email, "email").when(~known, "plan"))


def new_users(users: DataFrame, regs: DataFrame) -> DataFrame:
    """Users to insert: unseen e-mails, with the plan of their first registration.

    Their id follows from the e-mail; ``created_at`` is that of the registration, where
    registrations have it.
    """
    carried = [c for c in ("created_at",) if c in regs.columns]
    first = regs.groupBy("email").agg(
        F.min_by("plan", "seq").alias("plan"), *(F.min_by(c, "seq").alias(c) for c in carried)
    )
    unseen = first.join(users.select("email"), "email", "left_anti")
    return unseen.select(made_id(F.md5("email")).alias("id"), "email", "plan", *carried)


def upsert_users(users: DataFrame, regs: DataFrame) -> DataFrame:
    """First write wins on the e-mail; plans of existing users stay."""
    new = new_users(users, regs)
    if "created_at" in new.columns and "created_at" not in users.columns:
        users = users.withColumn("created_at", F.lit(None).cast(new.schema["created_at"].dataType))
    return users.unionByName(new, allowMissingColumns=True)


def register_keys(users: DataFrame, regs: DataFrame) -> DataFrame:
    """Key rows for valid registrations. The per-minute limit follows the requested plan.

    The daily limit follows the plan of the user, which a registration does not change.
    """
    digest = digests.key_digest(F.col("key_text"))
    keyed = regs.select(
        "seq", "email",
        made_id(digest).alias("id"),
        digest.alias("key_hash"),
        digests.key_prefix(F.col("key_text")).alias("key_prefix"),
        _plan_value(F.col("plan"), catalog.PLAN_PER_MINUTE).alias("rate_limit"),
        F.lit(False).alias("revoked"),
        *(c for c in ("created_at",) if c in regs.columns),
    )
    owners = upsert_users(users, regs).select(
        F.col("id").alias("user_id"), "email",
        daily_limit(F.col("plan")).alias("daily_limit"),
    )
    return keyed.join(owners, "email")


def legacy_user(users: DataFrame) -> DataFrame:
    """The owner of legacy keys, id and e-mail: the stored user, or the one to insert."""
    spark = users.sparkSession
    own = spark.range(1).select(F.lit(catalog.LEGACY_EMAIL).alias("email"))
    stored = users.where(F.col("email") == catalog.LEGACY_EMAIL).groupBy("email").agg(F.min("id").alias("id"))
    return own.join(stored, "email", "left").select(
        F.coalesce("id", made_id(F.md5("email"))).alias("id"), "email",
        F.lit(catalog.DEFAULT_PLAN).alias("plan"), F.col("id").isNull().alias("is_new"),
    )


def seed_legacy(
    keys: DataFrame, listed: DataFrame, users: DataFrame, column: str = "env_keys"
) -> DataFrame:
    """Key rows for comma-separated legacy keys whose digest is not stored yet.

    They belong to the legacy user; see ``legacy_user`` for its own row.
    """
    parts = listed.select(F.explode(F.split(column, ",")).alias("k")).select(
        tx.strip(F.col("k")).alias("k")
    )
    rows = parts.where(F.col("k") != "").distinct().select(
        F.lit(catalog.LEGACY_EMAIL).alias("email"),
        made_id(digests.key_digest(F.col("k"))).alias("id"),
        digests.key_digest(F.col("k")).alias("key_hash"),
        digests.key_prefix(F.col("k")).alias("key_prefix"),
        F.lit(catalog.PLAN_PER_MINUTE[catalog.DEFAULT_PLAN]).alias("rate_limit"),
        F.lit(False).alias("revoked"),
    )
    owner = legacy_user(users).select(F.col("id").alias("user_id"), "email")
    return rows.join(keys.select("key_hash"), "key_hash", "left_anti").join(F.broadcast(owner), "email")


# --- key administration -----------------------------------------------------------


def revoke(keys: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """Revoke all active keys whose ``by`` (key_prefix or id) is in ``targets``."""
    marks = targets.select(by).distinct().withColumn("_hit", F.lit(True))
    return keys.join(marks, by, "left").select(
        *[
            (F.col("revoked") | F.coalesce("_hit", F.lit(False))).alias("revoked")
            if c == "revoked" else F.col(c)
            for c in keys.columns
        ]
    )


def revoke_outcome(keys: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """Per target whether any active key was there to revoke."""
    active = keys.where(~F.col("revoked")).groupBy(by).agg(F.count("*").alias("_n"))
    return targets.select(by).distinct().join(active, by, "left").select(
        by, F.col("_n").isNotNull().alias("changed")
    )


def list_keys(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Key listing with owners, by id, without digests."""
    owners = users.select(F.col("id").alias("user_id"), "email", "plan")
    columns = [c for c in ("id", "key_prefix", "rate_limit", "revoked", "created_at")
               if c in keys.columns]
    return keys.join(owners, "user_id").select(*columns, "email", "plan").orderBy("id")


def anywhere() -> Column:
    """A value that matches no key or label, spread over many partitions."""
    return F.concat(F.lit("-"), F.pmod(F.xxhash64("id"), F.lit(1024)).cast("string"))


# --- callers of requests ----------------------------------------------------------


def with_caller(
    requests: DataFrame,
    keys: DataFrame,
    users: DataFrame,
    legacy: tuple[str, ...] = (),
    as_of_request: bool = False,
) -> DataFrame:
    """Add who is behind each request: user_id, email, plan, caller_key_id, caller_prefix,
    caller_rate (null unless registered and active), ``legacy``, ``caller`` (label) and
    ``valid`` (no key, or a key that is known).

    With ``as_of_request`` a key counts as it was at the time of the request: from its
    ``created_at`` (null: always) until before its ``revoked_at`` (null: not revoked), whatever
    its state is now. A digest has one key, so the join finds one row at most.
    """
    if as_of_request:
        known = keys.withColumns({"_from": F.col("created_at").cast("timestamp"), "_until": F.col("revoked_at").cast("timestamp")})
    else:
        none = F.lit(None).cast("timestamp")
        known = keys.where(~F.col("revoked")).withColumns({"_from": none, "_until": none})
    active = (
        known.select("id", "user_id", "key_hash", "key_prefix", "rate_limit", "_from", "_until")
        .join(users.select(F.col("id").alias("user_id"), "email", "plan"), "user_id")
        .select(
            "key_hash", "user_id", "email", "plan",
            F.col("id").alias("caller_key_id"),
            F.col("key_prefix").alias("caller_prefix"),
            F.col("rate_limit").alias("caller_rate"),
            *(("_from", "_until") if as_of_request else ()),
        )
    )
    key = F.nullif(tx.strip(F.col("key_text")), F.lit(""))
    # Requests without a key match nothing; spread them instead of piling up nulls.
    called = requests.withColumn("_key", key).withColumn(
        "key_hash", F.coalesce(digests.key_digest(F.col("_key")), anywhere())
    )
    if as_of_request:
        there = (
            (called["key_hash"] == active["key_hash"])
            & (F.col("_from").isNull() | (F.col("_from") <= F.col("ts")))
            & (F.col("_until").isNull() | (F.col("ts") < F.col("_until")))
        )
        joined = called.join(active, there, "left").drop(active["key_hash"]).drop("_from", "_until")
    else:
        joined = called.join(active, "key_hash", "left")
    registered = F.col("user_id").isNotNull()
    is_legacy = F.coalesce(~registered & F.col("_key").isin(*legacy), F.lit(False)) if legacy \
        else F.lit(False)
    return joined.withColumns(
        {
            "legacy": is_legacy,
            "caller": F.when(
                registered,
                F.concat(F.lit("user:"), "email", F.lit(" key:"), "caller_prefix"),
            )
            .when(is_legacy, F.concat(F.lit("key:"), digests.key_prefix(F.col("_key"))))
            .otherwise("anon"),
            "valid": F.col("_key").isNull() | registered | is_legacy,
            "bucket": F.when(registered, F.concat(F.lit("key:"), F.col("caller_key_id").cast("string")))
            .when(
                F.col("_key").isNotNull(),
                F.concat(F.lit("key:"), F.left("key_hash", F.lit(16))),
            )
            .otherwise(F.concat(F.lit("ip:"), "ip")),
        }
    ).drop("key_hash", "_key")


def with_rate_limit(called: DataFrame) -> DataFrame:
    """Per-minute limit: scan routes by caller, the other routes fixed and by address."""
    by_caller = F.coalesce(
        "caller_rate",
        F.when(F.col("legacy"), F.lit(catalog.LEGACY_PER_MINUTE)),
        F.lit(catalog.ANON_PER_MINUTE),
    )
    limit = F.when(F.col("route").isin(*SCAN_ROUTES), by_caller)
    for route, value in catalog.ADDRESS_ROUTE_PER_MINUTE.items():
        limit = limit.when(F.col("route") == route, F.lit(value))
    by_address = ~F.col("route").isin(*SCAN_ROUTES)
    return called.withColumns(
        {
            "minute_limit": limit,
            "bucket": F.when(by_address, F.concat(F.lit("ip:"), "ip")).otherwise(F.col("bucket")),
        }
    )


def scans_per_day(log: DataFrame) -> DataFrame:
    """Scans per caller label and UTC day; anonymous and blank labels have no quota."""
    counted = log.where(F.col("key_id").isNotNull() & ~F.col("key_id").isin("", "anon"))
    return counted.groupBy("key_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))


# --- quotas and rates, replayed over a request log --------------------------------


def quota_decisions(
    called: DataFrame,
    limits: dict[str, int] = catalog.PLAN_PER_DAY,
    consuming: Column | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Add ``blocked``: code requests of a caller beyond the daily limit.

    Every request that is scanned consumes quota, archives too, but only code requests
    are refused. Until the limit is reached nothing is refused, and afterwards no code
    request is accepted, so a code request is blocked if as many requests as the limit would
    have been scanned before it. ``consuming`` marks those (default: all valid ones). The log
    is read once, sorted by range, and kept in ``folder`` (see prefix.running).
    """
    eligible = F.col("valid") if consuming is None else F.col("valid") & consuming
    limit = daily_limit(F.coalesce("plan", F.lit(catalog.DEFAULT_PLAN)), limits)
    own = F.when(eligible & (F.col("caller") != "anon"), 1).otherwise(0)
    days = called.withColumns({"day": F.to_date("ts"), "_own": own})
    folder = folder or session.shared_dir(called.sparkSession, "quota")
    ran = prefix.running(days, ["caller", "day"], ["ts", "id"], F.col("_own"), folder)
    refusable = (F.col("caller") != "anon") & F.col("valid") & (F.col("route") == "code")
    blocked = refusable & (F.col("running") - F.col("_own") >= limit)
    return ran.withColumn("blocked", blocked).drop("running", "day", "_own")


def rate_counts(limited: DataFrame) -> DataFrame:
    """Requests per route, bucket and clock minute, with how many were above the limit."""
    return (
        limited.groupBy("route", "bucket", F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.count("*").alias("requests"), F.max("minute_limit").alias("minute_limit"))
        .withColumn("over", F.greatest(F.lit(0), F.col("requests") - F.col("minute_limit")))
    )


def rate_violations(limited: DataFrame, folder: str | None = None) -> DataFrame:
    """The requests above the limit of their minute, in order of arrival.

    Limits of any size; a limit of 0 or less refuses every request of its minute. The log is
    read once and kept in ``folder`` (see prefix.running), a hot bucket in several partitions.
    """
    df = limited.withColumn("minute", F.date_trunc("minute", "ts"))
    folder = folder or session.shared_dir(limited.sparkSession, "rates")
    ran = prefix.running(df, ["route", "bucket", "minute"], ["ts", "id"], F.lit(1), folder)
    return ran.where(F.col("running") > F.col("minute_limit")).drop("running")
