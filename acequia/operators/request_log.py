"""Latency report over a log of requests.

The log has run_id, method, endpoint, status and time_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def passed() -> Column:
    """A request passes when its status lies from 200 to 299."""
    return F.coalesce(F.col("status").between(200, 299), F.lit(False))


def with_result(log: DataFrame) -> DataFrame:
    return log.withColumn("result", F.when(passed(), "PASS").otherwise("FAIL"))


def _pass_count() -> Column:
    return F.count_if(F.col("result") == "PASS")


def latency_by_endpoint(log: DataFrame) -> DataFrame:
    return with_result(log).groupBy("method", "endpoint").agg(
        F.avg("time_ms").alias("avg_time"),
        F.count("result").alias("n_requests"),
        _pass_count().alias("pass_count"),
    )


def latency_overall(log: DataFrame) -> DataFrame:
    """One row: runs, requests, passes, failures, pass rate in percent, mean time."""
    total, good = F.count("*"), _pass_count()
    return with_result(log).agg(
        F.count_distinct("run_id").alias("total_runs"),
        total.alias("total_tests"),
        good.alias("pass_count"),
        (total - good).alias("fail_count"),
        F.coalesce(F.try_divide(good, total) * 100, F.lit(0.0)).alias("success_rate"),
        F.avg("time_ms").alias("avg_time"),
    )


def slowest_requests(log: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` slowest requests; equal times follow in the order of the other columns."""
    columns = ("method", "endpoint", "run_id", "status")
    return with_result(log).select("time_ms", *columns, "result").orderBy(
        F.col("time_ms").desc_nulls_last(), *columns
    ).limit(n)
