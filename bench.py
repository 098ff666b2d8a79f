"""Time the headline queries on one data set and print one JSON line.

BENCH_SF_DIR: folder with the tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
BENCH_REPEATS: runs of each query, of which the median counts (default 1).
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from assaytrail.plans.queries import QUERIES
from assaytrail.session import local_session

HEADLINE = ["day_values", "rcv_prev_flags", "all_flags", "slopes", "projection", "med_response", "confounders",
            "name_match", "unit_convert", "egfr_recompute", "file_dedup", "kdigo_history", "criteria_recorded", "figures",
            "system_status", "patient_worklist", "label_runs", "number_check", "entity_f1", "group_rows", "rule_tags"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    QUERIES["last_test"](spark, sf_dir).write.format("noop").mode("overwrite").save()       # warm the session
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_REPEATS", "1"))):
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        seconds[name] = round(median(runs), 2)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 2), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
