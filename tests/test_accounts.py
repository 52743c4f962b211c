"""Stored users and keys: jobs see each other's changes, a failed one changes nothing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leakloom.operators import tenants
from leakloom.plans import accounts
from leakloom.sources import versions

SCHEMA = "k string, n long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_versions_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path, SCHEMA).count() == 0
    assert versions.upsert(spark, path, SCHEMA, table(spark, [(f"k{i}", i) for i in range(200)]), "k") == 1
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("part-*")}
    assert versions.upsert(spark, path, SCHEMA, table(spark, [("k3", -3), ("new", 7)]), "k") == 2
    assert versions.upsert(spark, path, SCHEMA, table(spark, []), "k") == 2
    want = {f"k{i}": i for i in range(200)} | {"k3": -3, "new": 7}
    assert {r.k: r.n for r in versions.read(spark, path, SCHEMA).collect()} == want
    assert versions.read(spark, path, SCHEMA).count() == 201
    assert {r.k: r.n for r in versions.read(spark, path, SCHEMA, version=1).collect()} == {f"k{i}": i for i in range(200)}
    # Two keys touch two buckets at most; the others are not written again.
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("part-*")}
    assert files.items() <= after.items()
    assert len({p.parent.name for p in after.keys() - files.keys()}) <= 2


def test_a_failed_job_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.upsert(spark, path, SCHEMA, table(spark, [("a", 1), ("b", 2)]), "k")
    bad = table(spark, [("a", 9)]).withColumn("n", F.when(F.col("k") == "a", F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        versions.upsert(spark, path, SCHEMA, bad, "k")
    assert {tuple(r) for r in versions.read(spark, path, SCHEMA).collect()} == {("a", 1), ("b", 2)}
    # Another job has made the next version meanwhile: the later one fails, and what it wrote is not seen.
    newest = versions._newest(spark, path)
    versions.upsert(spark, path, SCHEMA, table(spark, [("a", 5)]), "k")
    monkeypatch.setattr(versions, "_newest", lambda *_: newest)
    with pytest.raises(Exception, match="(?i)exists"):
        versions.upsert(spark, path, SCHEMA, table(spark, [("b", 6)]), "k")
    monkeypatch.undo()
    assert {tuple(r) for r in versions.read(spark, path, SCHEMA).collect()} == {("a", 5), ("b", 2)}


def test_register_revoke_seed(spark, tmp_path):
    path = str(tmp_path / "t")
    regs = spark.createDataFrame(
        [(1, "a@x", "pro", "key_one1x"), (2, "a@x", "free", "key_two2x"), (3, "bad", "free", "k"), (4, "b@x", None, "key_one1x")],
        "seq long, email string, plan string, key_text string",
    )
    for _ in range(2):  # a repeated job changes nothing
        accounts.register(spark, path, regs)
        assert {(r.email, r.plan) for r in accounts.users(spark, path).collect()} == {("a@x", "pro"), ("b@x", "free")}
        assert {(r.key_prefix, r.rate_limit, r.revoked) for r in accounts.keys(spark, path).collect()} == {("key_one1", 300, False), ("key_two2", 30, False)}
    gone = spark.createDataFrame([("key_two2",), ("nobody",)], "key_prefix string")
    assert {tuple(r) for r in accounts.revoke(spark, path, gone, "key_prefix", "2024-01-02").collect()} == {("key_two2", True), ("nobody", False)}
    assert {tuple(r) for r in accounts.revoke(spark, path, gone, "key_prefix", "2024-01-05").collect()} == {("key_two2", False), ("nobody", False)}
    accounts.seed_legacy(spark, path, spark.createDataFrame([(" old_1 , key_one1x,, old_1",)], "env_keys string"))
    stored = {r.key_prefix: r for r in accounts.keys(spark, path).collect()}
    assert set(stored) == {"key_one1", "key_two2", "old_1"} and stored["key_two2"].revoked_at == datetime(2024, 1, 2)
    assert accounts.users(spark, path).where("email = 'legacy@local'").count() == 1


def test_keys_count_as_they_were(spark):
    """Made, used, revoked and used again: each request sees the key of its own time."""
    at = lambda h: datetime(2024, 1, 1, h)
    users = spark.createDataFrame([(1, "a@x", "pro")], "id long, email string, plan string")
    keys = spark.createDataFrame(
        [(11, 1, "k1", 30, True, at(3), at(6)), (12, 1, "k2", 30, False, at(4), None), (13, 1, "k3", 30, True, None, at(5))],
        "id long, user_id long, key string, rate_limit int, revoked boolean, created_at timestamp, revoked_at timestamp",
    ).withColumns({"key_hash": F.sha2("key", 256), "key_prefix": F.col("key")}).drop("key")
    calls = [(f"{k} {h}", at(h), "code", "1", k) for k in ("k1", "k2", "k3") for h in (2, 3, 5, 6)] + [("none", at(2), "code", "1", None)]
    frame = spark.createDataFrame(calls, "id string, ts timestamp, route string, ip string, key_text string")
    then = tenants.with_caller(frame, keys, users, as_of_request=True)
    assert {r.id for r in then.where("valid").collect()} == {"k1 3", "k1 5", "k2 5", "k2 6", "k3 2", "k3 3", "none"}
    assert then.columns == tenants.with_caller(frame, keys, users).columns and then.count() == len(calls)
    now = tenants.with_caller(frame, keys, users)
    assert {r.id for r in now.where("valid").collect()} == {f"k2 {h}" for h in (2, 3, 5, 6)} | {"none"}
