"""Benchmark the bound queries.

Runs every registered bench query on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:

    {"metric": "total_warm_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed completely with the ``noop`` sink (no collection to
the driver).  After one global warm-up query, every query runs
``$BENCH_REPEATS`` times and the median is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import REGISTRY  # noqa: E402
from tessera.session import build_session  # noqa: E402


def run_once(spark, q, sf_dir: str) -> float:
    t0 = time.perf_counter()
    q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [s for s in os.environ.get("BENCH_QUERIES", "").split(",") if s]
    include_models = os.environ.get("BENCH_MODELS", "0") == "1"
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * cpus))),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    run_once(spark, REGISTRY["rollup_measures"], sf_dir)   # JVM / JIT / file-listing warm-up
    for name, q in REGISTRY.items():
        if only and name not in only:
            continue
        if not only and not q.bench and not include_models:
            continue
        try:
            runs = [run_once(spark, q, sf_dir) for _ in range(repeats)]
            times[name] = round(statistics.median(runs), 3)
        except Exception as e:  # keep benchmarking the others
            errors[name] = repr(e)[:300]
        print(f"# {name}: {times.get(name)}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_warm_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "repeats": repeats}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
