"""Streams over the call log: windowed rollups, last-wins upkeep, running spend."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from leakgauge.operators.ledger import last_wins
from leakgauge.session import cut, shared_dir


def log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A log folder, or one log file of a folder, as a stream of its files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def windowed_calls(log: DataFrame, ts: str, by: list[str], width: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Calls and answers of each window; rows later than the watermark are dropped by Spark."""
    return (
        log.withWatermark(ts, late)
        .groupBy(F.window(ts, width), *by)
        .agg(F.count("*").alias("calls"), F.count("raw").alias("answered"))
        .select(F.col("window.start").alias("window_start"), *by, "calls", "answered")
    )


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote into the shared folder.

    In ``complete`` mode that is the last batch's whole result, else the rows of all
    batches. Nothing passes through the driver; a batch that runs again writes the same.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{name}-{os.urandom(6).hex()}"
    last = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")
        last[:] = [epoch]

    q = df.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    if not last:
        return spark.createDataFrame([], df.schema)
    return spark.read.parquet(f"{at}/out/epoch={last[0]}" if mode == "complete" else f"{at}/out").drop("epoch")


def keep_last(log: DataFrame, key: list[str], order: str, target: str, checkpoint: str, buckets: int = 256):
    """Keep the latest line of each key in parquet folder ``target``, batch by batch.

    The folder is partitioned by ``bucket``, a hash of the key. Each batch is folded
    first, then merged with the buckets it touches, which alone are written anew; a
    batch that runs again gives the same lines.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    kind = StructType([*log.schema.fields, StructField("bucket", IntegerType())])

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = cut(last_wins(batch, key, order).withColumn("bucket", bucket))
        touched = [r.bucket for r in now.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        there = spark.read.schema(kind).parquet(target) if _exists(spark, target) else spark.createDataFrame([], kind)
        both = there.where(F.col("bucket").isin(touched)).unionByName(now)
        new = last_wins(both.drop("bucket"), key, order).withColumn("bucket", bucket)
        cut(new).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def running_spend(log: DataFrame, by: str, cost: str, cap: float) -> DataFrame:
    """Running cost of each key and whether it passed ``cap``, with state kept per key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, calls = state.get if state.exists else (0.0, 0)
        for f in frames:
            spent += float(f[cost].fillna(0).sum())
            calls += len(f)
        state.update((spent, calls))
        yield pd.DataFrame({by: [key[0]], "calls": [calls], "spent": [spent], "over_cap": [spent > cap]})

    return log.groupBy(by).applyInPandasWithState(step, f"{by} string, calls bigint, spent double, over_cap boolean", "spent double, calls bigint", "update", GroupStateTimeout.NoTimeout)
