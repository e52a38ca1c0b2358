"""Wall time of headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3). The refresh of the curated tables is timed once, each table by itself;
every query is then run once to warm up and BENCH_RUNS times for its median.
Queries that compute signals, coverage or drafts do so from the base tables in every
run, with the refreshed rings and search index; the questions read refreshed tables.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

import pyspark

from ledgerwatch import Workspace, build_session
from ledgerwatch.catalog import build_registry
from ledgerwatch.catalog.registry import present

REFRESH = ["transactions", "hqla_holdings", "cashflow_positions", "t", "rings", "signals", "alerts", "loan_ews", "lcr_daily", "new_cases", "cases", "audit_log", "findings", "evidence", "search_index"]
QUERIES = [
    "s2", "s3", "s4", "s6", "s7", "r14", "r15", "n1", "n2", "n3", "n6", "k2", "c5", "c6", "q3", "q4", "q6", "e1", "e2", "e4", "e5", "e7",
    "g3", "g5", "g8", "io10", "v5", "v6", "v7", "m0", "m5_m8", "b01", "b03", "b06", "b07", "b12", "b20", "b22", "b24", "b25", "b38", "b41", "b44", "d_txn",
]


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ledgerwatch-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times: dict[str, float] = {}
    w = Workspace.shared(spark, data_dir)
    for name in REFRESH:
        t0 = time.perf_counter()
        getattr(w, name)
        times[f"refresh_{name}"] = round(time.perf_counter() - t0, 3)

    registry = build_registry()
    for name in QUERIES:
        seconds = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            present(registry[name].build(Workspace.shared(spark, data_dir))).write.format("noop").mode("overwrite").save()
            if i:
                seconds.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(seconds), 3)

    print(
        json.dumps(
            {
                "metric": "total wall time, refresh once plus median of each query", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": data_dir.rstrip("/").split("sf")[-1], "cpus": cpus, "runs": runs, "spark": pyspark.__version__,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
