"""Users and API keys as tables that last: registering, revoking, legacy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leakloom.operators import tenants
from leakloom.sources import versions

USERS = "id long, email string, plan string, created_at timestamp"
KEYS = (
    "id long, user_id long, key_hash string, key_prefix string, rate_limit int, revoked boolean, "
    "created_at timestamp, revoked_at timestamp"
)


def users(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, f"{path}/users", USERS)


def keys(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, f"{path}/api_keys", KEYS)


def _conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a table; those that df does not have are null."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


def store(spark: SparkSession, path: str, new_users: DataFrame, new_keys: DataFrame) -> None:
    """Users first, so that no version of the keys has an owner who is not there."""
    versions.upsert(spark, f"{path}/users", USERS, _conform(new_users, USERS), "email")
    versions.upsert(spark, f"{path}/api_keys", KEYS, _conform(new_keys, KEYS), "key_hash")


def register(spark: SparkSession, path: str, regs: DataFrame) -> None:
    """Valid registrations (seq, email, plan, key_text, created_at): unseen users and keys are added.

    A key that is there already stays as it is, so a repeated job changes nothing.
    """
    valid = tenants.check_registrations(regs).where(F.col("reason").isNull())
    known_users, known_keys = users(spark, path), keys(spark, path)
    made = tenants.register_keys(known_users, valid)
    first = made.groupBy("key_hash").agg(F.min_by(F.struct(*made.columns), "seq").alias("k")).select("k.*")
    unseen = first.join(known_keys.select("key_hash"), "key_hash", "left_anti")
    store(spark, path, tenants.new_users(known_users, valid), unseen)


def revoke(spark: SparkSession, path: str, targets: DataFrame, by: str, at: str) -> DataFrame:
    """Active keys with a target's ``by`` (id or key_prefix) are revoked at a time; which targets changed any."""
    found = keys(spark, path)
    outcome = tenants.revoke_outcome(found, targets, by)
    hit = found.where(~F.col("revoked")).join(targets.select(by).distinct(), by, "left_semi")
    outcome = outcome.sparkSession.createDataFrame(outcome.collect(), outcome.schema)  # as it was before; a row for each target
    changed = hit.withColumns({"revoked": F.lit(True), "revoked_at": F.lit(at).cast("timestamp")})
    versions.upsert(spark, f"{path}/api_keys", KEYS, _conform(changed, KEYS), "key_hash")
    return outcome


def seed_legacy(spark: SparkSession, path: str, listed: DataFrame, column: str = "env_keys") -> None:
    """Comma-separated legacy keys that are not stored yet, under the legacy user, who is added if need be."""
    known_users, known_keys = users(spark, path), keys(spark, path)
    owner = tenants.legacy_user(known_users).where("is_new")
    store(spark, path, owner, tenants.seed_legacy(known_keys, listed, known_users, column))
