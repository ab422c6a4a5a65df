"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "alerts_by_severity_tactic",
    "detect_alerts",
    "attack_frequency",
    "ip_sequence_window",
    "next_event_predictions",
    "incident_reports",
    "remediation_long",
    "incident_summary",
    "alert_stats",
    "alerts_page",
    "ip_sessions",
    "median_impute",
    "standard_scale",
    "label_cumcount",
    "sequence_dataset",
    "sequence_dataset_global",
    "stratified_split",
    "classification_report",
    "iforest_eval",
    "stream_history",
]


def session(name: str, cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from palisade.plans import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["alerts_by_severity_tactic"](spark, sf_dir).count()  # JVM warm-up, not measured
    seconds = {}
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
