"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stridelab.plans import queries as core
from stridelab.session import local_session

HEADLINE = [
    "flagship",
    "label_multiclass",
    "sliding_windows",
    "windows_two_labels",
    "windows_per_subject",
    "fold_distribution",
    "summary_by_subject",
    "describe",
    "corr_matrix",
    "clean_windows",
    "feat_time",
    "feat_freq",
    "feat_wavelet",
    "sample_entropy",
    "feature_table",
    "normalize_train",
    "anova_f",
    "pooled_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    registered = core.queries()
    registered["value_counts"](spark, sf_dir).collect()  # starts the session's machinery
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
