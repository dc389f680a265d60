"""Measure what each upsert merge strategy reads and shuffles.

    python tools/merge_io.py [sf_dir]

The stored table is the whole ``events`` table, partitioned by day.  Two
batches, both re-stamped (-1/0/+1 hour): the last day (as large as what it
touches) and one user's events (small, touching every day).  Each upsert runs
once per strategy on a fresh copy of the table.  Task metrics are summed per strategy from Spark's event log, written
to a fresh scratch folder.  Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="lakesync-eventlog-")
    spark = (SparkSession.builder.master("local[8]").appName("lakesync-merge-io")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from lakesync.plans.suite import events, events_spec, restamped
    from lakesync.session import content_bytes, scratch_path
    from lakesync.sinks.table import upsert_to_path

    ev = events(spark, sf)
    first_user = ev.agg(F.min("user_id")).first()[0]
    batches = {
        # a day of late and fresh events: the batch is as large as what it touches
        "last_day": restamped(ev.where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))),
        # one user's events: a small batch that touches every day of the table
        "one_user": restamped(ev.where(F.col("user_id") == first_user)),
    }
    out = {}
    for name, batch in batches.items():
        for strategy in ("broadcast", "shuffle"):
            key = f"{name}/{strategy}"
            spec = events_spec(scratch_path(spark, f"io_{name}_{strategy}"))
            upsert_to_path(ev, spec)
            spark.sparkContext.setJobGroup(f"merge-{key}", f"upsert merge ({key})")
            t0 = time.perf_counter()
            r = upsert_to_path(batch, spec, strategy=strategy)
            # what the touched partitions hold afterwards: each byte of it was written once
            touched = sum(content_bytes(spark, f"{spec.path}/event_date={v}") for v in r.touched)
            out[key] = {"touched_bytes": touched, "seconds": round(time.perf_counter() - t0, 3), "stored_rows_read": r.stored_read,
                        "batch_rows": r.rows_in, "touched_partitions": r.partitions}
            spark.sparkContext.setJobGroup("other", "other")
    app_id = spark.sparkContext.applicationId
    spark.stop()

    # Spark 4 writes a rolling log: a folder per application, files in order
    logs = sorted(f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                  if os.path.isfile(f) and app_id in f and "appstatus" not in os.path.basename(f))
    stage_group: dict[int, str] = {}
    totals: dict[str, dict[str, int]] = {}
    for line in (ln for f in logs for ln in open(f)):
        e = json.loads(line)
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id", "")
            for sid in e.get("Stage IDs", []):
                stage_group[sid] = group
        elif kind == "SparkListenerTaskEnd":
            group = stage_group.get(e.get("Stage ID"), "")
            if not group.startswith("merge-"):
                continue
            m = e.get("Task Metrics") or {}
            t = totals.setdefault(group[len("merge-"):], {"input_bytes": 0, "shuffle_write_bytes": 0,
                                                          "shuffle_read_bytes": 0, "output_bytes": 0})
            t["input_bytes"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
            t["output_bytes"] += (m.get("Output Metrics") or {}).get("Bytes Written", 0)
            t["shuffle_write_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            rm = m.get("Shuffle Read Metrics") or {}
            t["shuffle_read_bytes"] += rm.get("Remote Bytes Read", 0) + rm.get("Local Bytes Read", 0)
    for k, v in totals.items():
        out[k].update(v)
    print(json.dumps({"sf": sf, "event_log": log_dir, **out}))


if __name__ == "__main__":
    main()
