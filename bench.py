"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line.

Every query is run warm, the median of ``$BENCH_RUNS`` runs counts (default 1
after one warm-up of the session). Results are fully computed into a sink that
discards them.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from stringwatch.plans.catalog import QUERIES  # noqa: E402
from stringwatch.session import local_session  # noqa: E402

HEADLINES = (
    "string_outlier_scores",
    "string_alert_points",
    "string_events",
    "channel_inventory",
    "ewma_alerts",
    "ewma_threshold",
    "peer_irradiance",
    "string_response",
    "residual_scores",
    "residual_alerts",
    "strict_hierarchical_alerts",
    "persistent_alerts",
    "confirmed_memory",
    "reconstructed_events",
    "conditioned_irradiance",
    "alarm_classification",
    "alarm_window_exclusion",
    "alarm_event_coverage",
    "event_metrics",
    "event_recall_summary",
    "version_comparison_events",
    "event_continuity",
    "training_quality",
    "peer_power_features",
    "residual_audit",
)


def run(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or list(HEADLINES)
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "string_events", sf_dir)
    seconds = {name: round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(pathlib.Path(sf_dir).name.removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
