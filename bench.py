"""Headline queries on local[$BENCH_CPUS]; prints one JSON line with the seconds of each query."""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("SPARK_DRIVER_MEMORY", "16g")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from huskwatch.plans.queries import QUERIES  # noqa: E402
from huskwatch.session import get_spark  # noqa: E402

HEADLINE = ["w3_gap_sessions", "a7_event_host_rollup", "n13_decode_fixed_point", "r1_rule_hits", "c2_session_score", "i4_indicator_hub",
            "b5_anomaly", "f9_campaigns", "t5_beacon_profiles", "j5_lateral_moves", "j7_threat_hits", "w1_reassembled"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    warm = folder.replace("sf0.1", "sf0.001") if "sf0.1" in folder else folder
    times = {}
    for name in names:
        QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        found = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            found.append(time.time() - start)
        times[name] = round(statistics.median(found), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
