"""Wall time of every query: prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores, BENCH_ONLY an optional
comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

from crawlspark.session import local_session

import crawlspark.plans.queries  # noqa: F401
from crawlspark.plans.registry import QUERIES


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cores, "bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        started = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        except Exception as e:  # a broken query must not hide the others
            failed[name] = str(e)[:200]
        print(name, seconds.get(name, "failed"), file=sys.stderr, flush=True)
    out = {
        "metric": "all_queries_wall_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores,
        "spark": spark.version,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
