"""Time every registered query once the tables are built; print one JSON line.

The refresh that builds the tables is timed first, table by table, and is part of
the total. Each query then runs BENCH_RUNS times (2 by default) to a sink that
discards its rows; its shortest time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from acequia.plans.registry import registered, warehouse  # noqa: E402
from acequia.session import session_settings  # noqa: E402


def scale(name: str) -> float | str:
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    size = sum(f.stat().st_size for f in Path(folder).glob("*.parquet"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("acequia-bench")
    settings = {
        **session_settings(size, cpus),
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    tables = warehouse(spark, folder)
    seconds = {f"refresh_{name}": round(took, 4) for name, took in tables.refresh().items()}
    for key, query in registered().items():
        times = []
        for _ in range(int(os.environ.get("BENCH_RUNS", 2))):
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[key] = round(min(times), 4)
    spark.stop()

    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": scale(Path(folder).name),
    }))


if __name__ == "__main__":
    main()
