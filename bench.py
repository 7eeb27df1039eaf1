"""Wall time of the headline queries, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from alarmlake.catalog import QUERIES
from alarmlake.session import build_session

HEADLINE = [
    "AGG1_alarm_rate",
    "AGG2_pareto",
    "AGG3_code_summary",
    "WIN4_flood_runs",
    "AGG8_cooccurrence",
    "GRF1_maximal_cliques",
    "AGG13_alarm_quality",
    "AGG14_sensor_profile",
    "PRJ2_unpivot",
    "STR1_merged_stream",
    "WIN1_zscore",
    "WIN3_running_scale",
    "STR4_collapse",
    "STR6_half_space_trees",
    "STR7_verdicts",
    "STR8_rescored_history",
    "RUL4_example_minting",
    "RUL11_instructions",
    "SET2_multiset_equality",
    "JON7_cell_compare",
    "AGG22_snapshot_digest",
    "JOB6_source_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats + 1):  # the first run warms code and file caches
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total wall time of headline queries, warm median", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
