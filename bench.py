"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from skillgauge.plans import load_all
from skillgauge.session import get_spark

HEADLINE = (
    "metrics_by_model_lead",
    "agg08_grouping_sets",
    "confusion_by_model",
    "agg18_threshold_sweep",
    "agg21_error_quantiles",
    "agg22_lead_quantiles",
    "agg25_box_statistics",
    "jn01_build_verification",
    "jn05_full_outer_records",
    "jn06_nearest_grid_point",
    "bilinear_to_sites",
    "int09_point_bilinear",
    "dq02_validate_all",
    "srt01_top_errors",
    "meta08_weights_by_context",
    "meta09_blend",
    "meta12_ensemble_agreement",
    "blend_holdout",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_ui_enabled="false",
        spark_driver_memory="16g",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            # Every row is produced and none is kept.
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
