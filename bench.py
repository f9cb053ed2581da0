"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local threads. ``telemetry_ingest``
is the numbering and writing of the event rows that the telemetry queries then read.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tickframe.plans import QUERIES, workload

HEADLINE = (
    "run_summary", "phase_ticks", "live_state", "phase_attribution", "dimension_changes",
    "equipment_changes", "yaw_deltas", "hotbar_slots", "inventory_totals", "inventory_deltas",
    "inventory_repair", "chunk_buckets", "chunk_lookup", "chunk_lookup_orders", "session_ledgers",
    "absolute_times", "tick_packets", "packet_counts", "action_hold", "action_lock_step",
    "camera_yaw", "camera_pitch", "observations", "entity_kills", "position_report", "upload_gaps",
    "upload_ready", "ledger_gaps", "ledger_state", "flag_unpack", "flag_string", "event_labels",
    "admitted_ticks", "tick_log_roundtrip", "event_log_roundtrip", "capture_roundtrip",
    "packet_log_roundtrip", "tick_export", "chunk_crc", "stream_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tickframe-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        start = time.perf_counter()
        action()
        return round(time.perf_counter() - start, 3)

    # Starts the JVM's compiler and the Python workers; neither belongs to a query.
    spark.range(1000).repartition(int(cpus)).mapInArrow(lambda batches: batches, "id long").count()

    seconds = {"telemetry_ingest": timed(lambda: workload.telemetry(spark, sf_dir))}
    for name in HEADLINE:
        seconds[name] = timed(
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
