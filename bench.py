"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3: the median counts, after one warm-up run).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberline.catalog import QUERIES  # noqa: E402
from emberline.session import session  # noqa: E402

HEADLINE = [
    "src1_hotspot_scan",
    "src3_bounding_box",
    "src4_season_scan",
    "src5_weather_json",
    "g4_zone_date_spine",
    "k4_first_detection",
    "j1_nearest_join",
    "j2_bounded_nearest_join",
    "j3_nearest_join_by_date",
    "j4_fire_label",
    "j5_station_fallback",
    "j6_source_merge",
    "p11_fwi",
    "p7_zone_indices",
    "training_set",
    "a5_state_summary",
    "a11_roc_auc",
    "a15_model_comparison",
    "a17_ignition_probability",
    "k1_ranked_alerts",
    "w3_split_sequences",
    "x3_next_step",
    "v6_run_summary",
    "ts1_deduplicated_stream",
    "ts2_zone_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
