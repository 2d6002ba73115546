"""Times the headline queries on one local session and prints one JSON line.

Each query runs twice over the whole table into a sink that discards rows; the better time counts.
Writing the derived log and training the shared model happen before and are reported apart.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "audit_features",
    "request_features",
    "log_summary",
    "attack_type_counts",
    "top_uris",
    "status_metrics",
    "period_summary",
    "alert_cooldown",
    "apply_feedback",
    "training_export",
    "describe_numeric",
    "correlation_matrix",
    "uri_tfidf",
    "stratified_split",
    "classification_metrics",
    "has_sqli",
    "score_batch",
    "eda_clean",
    "distinct_profile",
    "smote_oversample",
    "read_audit_text",
    "stream_alert_cooldown",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wardlog-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wardlog.plans import catalog
    from wardlog.plans.driver_log import audit_lines
    from wardlog.plans.q_learning import shared_model
    from wardlog.session import configure

    configure(spark)
    setup = {}
    for name, prepare in (("derive_log", audit_lines), ("train_model", shared_model)):
        start = time.perf_counter()
        prepare(spark, sf_dir)
        setup[name] = round(time.perf_counter() - start, 3)
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "setup": setup,
                "log_rows": rows,
                "audit_features_rows_per_sec": round(rows / times["audit_features"]),
                "score_batch_rows_per_sec": round(rows / times["score_batch"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
