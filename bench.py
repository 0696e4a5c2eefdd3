"""Time the registered queries on one machine and print one JSON line.

BENCH_SF_DIR    folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS      executor threads (default 8)
BENCH_RUNS      timed runs per query after a first round of all (default 3; one where the first took over LONG seconds)
BENCH_QUERIES   comma-separated names (default all)

A run writes the whole result to the noop sink; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


LONG = 8.0


def main() -> None:
    from footfall.plans.registry import QUERIES
    from footfall.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "footfall-bench")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    first = {name: once(name) for name in names}
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(once(name) for _ in range(1 if first[name] > LONG else runs)), 4)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
