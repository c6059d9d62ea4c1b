"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.session import table
from leakgauge.streaming import ledger_stream as ls


def stream_hourly_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls and answers of each hour and model, from the log as a stream."""
    schema = table(spark, d, "pilot").schema
    log = ls.log_stream(spark, f"{d}/pilot.parquet", schema)
    log = log.withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    got = ls.run_to_end(ls.windowed_calls(log, "logged_at", ["model"], late="3650 days"), "lg_hourly")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "model", "calls", "answered")


QUERIES = {"stream_hourly_calls": stream_hourly_calls}
SQL = {
    "stream_hourly_calls": """select strftime(date_trunc('hour', logged_at), '%Y-%m-%d %H:%M:%S') as window_start, model, count(*) as calls, count(raw) as answered
      from pilot where logged_at is not null group by all"""
}
