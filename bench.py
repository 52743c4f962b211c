"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leakloom import session  # noqa: E402
from leakloom.operators import findings as fd  # noqa: E402
from leakloom.plans import scan  # noqa: E402
from registry import scan_queries, usage_queries, views  # noqa: E402

SCAN = ("scan_corpus", "scan_documents", "A01_scan_summary", "T04_report_rows", "A02_archive_rollup")
USAGE = (
    "U05_daily", "U06_by_key", "U09_stats", "U11_latest_per_owner",
    "K04_key_lookup", "K12_quota_decisions", "K17_rate_counts",
)


def timed(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = {**scan_queries.QUERIES, **usage_queries.QUERIES}
    # One short run starts the JVM's compilers; then the first run of each query, and a warm one.
    timed(fd.with_findings(views.corpus(spark, sf_dir).limit(100)))
    # Outside the timing: the documents, one row group here, as a table of several files, as
    # any large table is; and the ZIPs, read back as an archive table.
    work = tempfile.mkdtemp(prefix="bench-")
    views.table(spark, sf_dir, "documents").repartition(int(cpus)).write.parquet(f"{work}/documents")
    plain_table = views.table
    views.table = lambda session_, folder, name: (
        session_.read.parquet(f"{work}/documents") if name == "documents" else plain_table(session_, folder, name)
    )
    views.archives(spark, sf_dir).write.parquet(f"{work}/zips")
    views.archives = lambda session_, _: session_.read.parquet(f"{work}/zips")
    seconds, warm = {}, {}
    for name in SCAN + USAGE:
        for kept in (seconds, warm):
            start = time.perf_counter()
            timed(all_queries[name](spark, sf_dir))
            kept[name] = round(time.perf_counter() - start, 3)
    adversarial = {}
    for token in ("os.system(", "app.run(", "http://", 'execute("', "postgres://", "redis://a:", 'xmlns:a="http://schemas.microsoft.com/x" '):
        text = token * (100_000 // len(token))
        files = spark.createDataFrame([(1, "a.py", text)], "id int, filename string, code string")
        found = scan.scan_files(files)
        adversarial[token.strip()] = round(min(timed(found) for _ in range(2)), 3)
    corpus = views.corpus(spark, sf_dir)
    stats = corpus.selectExpr("count(*) AS files", "sum(octet_length(code)) AS bytes").first()
    scan_seconds = warm["scan_corpus"]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "warm": warm,
                "warm_total": round(sum(warm.values()), 3),
                "adversarial_sec_per_100kb": adversarial,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "files_per_sec": round(stats["files"] / scan_seconds, 1),
                "mb_per_sec": round(stats["bytes"] / 1e6 / scan_seconds, 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
