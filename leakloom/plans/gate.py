"""The outcome of every request of a log, in the order in which the checks apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakloom.functions import catalog
from leakloom.operators import admission, tenants


def decide(
    requests: DataFrame,
    keys: DataFrame,
    users: DataFrame,
    legacy: tuple[str, ...] = (),
    limits: dict[str, int] = catalog.PLAN_PER_DAY,
    as_of_request: bool = False,
) -> DataFrame:
    """Add ``outcome`` to requests(id, ts, route, ip, key_text, body); bodies and code stay behind.

    A code request passes: code present, key valid, daily quota left, code and file name
    well-formed, code not blank. Only requests that are scanned consume quota. With
    ``as_of_request`` keys count as they were then (see tenants.with_caller).
    """
    checked = admission.with_admission(requests)
    called = tenants.with_caller(checked.drop("body", "code"), keys, users, legacy, as_of_request)
    is_code = F.col("route") == "code"
    scanned = ~is_code | (F.col("reason") == admission.SCAN)
    decided = tenants.quota_decisions(called, limits, consuming=scanned)
    return decided.withColumn(
        "outcome",
        F.when(is_code & (F.col("reason") == "no_code"), "no_code")
        .when(~F.col("valid"), "invalid_key")
        .when(F.col("blocked"), "daily_limit")
        .when(is_code, F.col("reason"))
        .otherwise(admission.SCAN),
    )
