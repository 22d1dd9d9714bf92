"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query runs to completion into a no-op sink; the best of BENCH_REPEATS runs counts. Writing
the fleet and feature tables is timed on its own, as other queries read them. A query that takes longer than BENCH_LIMIT
seconds is cancelled and left out, and what is done so far goes to standard error, so one slow query costs its own figure alone.
Names given as arguments replace the headline queries.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from unitlife.plans import registered, views  # noqa: E402
from unitlife.session import local_session  # noqa: E402

HEADLINES = (
    "charge_carry", "validation_counts", "waveform_summaries", "feature_build", "horizon_targets",
    "split_assignment", "baseline_metrics", "eol_cycles", "rul_slope_error", "rul_trajectory_points",
    "drift_report", "drift_by_unit", "projections", "point_in_time", "prefix_drift", "fleet_audit",
    "feature_medians", "ridge_forecast", "ridge_metrics", "rul_model_error",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus, "unitlife-bench", spark__sql__shuffle__partitions=str(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    run = registered.queries()
    seconds: dict[str, float] = {}

    for name, stored in (("write_fleet", views.fleet), ("write_features", views.fleet_features)):
        start = time.perf_counter()
        stored(spark, directory)
        seconds[name] = round(time.perf_counter() - start, 3)
    limit, failed = float(os.environ.get("BENCH_LIMIT", "240")), []
    for name in sys.argv[1:] or HEADLINES:
        best = None
        for _ in range(repeats):
            stop = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
            stop.start()
            start = time.perf_counter()
            try:
                run[name](spark, directory).write.format("noop").mode("overwrite").save()
            except Exception as error:  # noqa: BLE001
                print(f"{name}: {str(error)[:300]}", file=sys.stderr, flush=True)
                failed.append(name)
                break
            finally:
                stop.cancel()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        if best is not None:
            seconds[name] = round(best, 3)
            print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": directory.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "failed": failed,
    }))


if __name__ == "__main__":
    main()
