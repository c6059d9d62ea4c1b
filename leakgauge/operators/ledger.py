"""The ledger of calls: last line wins, resume, failures, rollups, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.operators.prefix import running_totals


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key by ``order``; keys with nulls are keys too.

    An aggregate with map-side combine, not a window, so a hot key is folded
    before it is shuffled.
    """
    rest = [c for c in df.columns if c not in key]
    top = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order))
    got = df.groupBy(*key).agg(top.alias("_last"))
    return got.select(*key, *[F.col("_last").getField(c).alias(c) for c in rest])


def tasks(items: DataFrame, key: str, models: list[str], probes: list[str]) -> DataFrame:
    """Every item with every model and probe, by exploding two short lists."""
    return items.select(
        key,
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
    ).withColumn("probe", F.explode(F.array(*[F.lit(p) for p in probes])))


def todo(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return planned.join(done.select(*key).distinct(), key, "left_anti")


def failed_items(calls: DataFrame, item: list[str], failed: Column) -> DataFrame:
    """Calls of items that failed at least once."""
    bad = calls.where(failed).select(*item).distinct()
    return calls.join(bad, item, "left_semi")


def recurring(calls: DataFrame, item: list[str], order: str, failed: Column) -> DataFrame:
    """``calls`` with ``failed_before``: whether the item failed on an earlier line.

    Only the earliest failing line of an item matters, so an aggregate replaces the
    window over the item's whole history.
    """
    first = calls.where(failed).groupBy(*item).agg(F.min(order).alias("_first"))
    return calls.join(first, item, "left").withColumn("failed_before", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def checkpoints(calls: DataFrame, order: str, value: Column, every: int) -> DataFrame:
    """``calls_logged, accumulated`` at every so many lines, before that line's own value."""
    own = calls.withColumn("_val", F.coalesce(value, F.lit(0)).cast("bigint"))
    both = running_totals(own, order, {"calls_logged": F.lit(1).cast("bigint"), "_upto": F.col("_val")})
    return both.where(F.col("calls_logged") % every == 0).select(F.col("calls_logged").cast("bigint"), (F.col("_upto") - F.col("_val")).cast("bigint").alias("accumulated"))


def first_kept(cache: DataFrame, key: list[str], order: str, texts: list[str]) -> DataFrame:
    """What a cache holds for each key: the texts of the first line that has all of them."""
    has = cache.where(" and ".join(f"`{c}` is not null" for c in texts))
    got = has.groupBy(*key).agg(F.min_by(F.struct(*texts), F.col(order)).alias("_kept"))
    return got.select(*key, *[F.col("_kept").getField(c).alias(c) for c in texts])


def looked_up(items: DataFrame, cache: DataFrame, key: list[str], order: str, texts: list[str]) -> DataFrame:
    """``items`` with the cached texts of their key and ``cached``; what isn't there stays null and has to be asked for."""
    kept = first_kept(cache, key, order, texts).withColumn("cached", F.lit(True))
    return items.join(kept, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def run_events(events: DataFrame, event: str = "event") -> DataFrame:
    """One row: runs started and ended, and whether a run was resumed or interrupted."""
    got = events.agg(F.count_if(F.col(event) == "run_start").alias("run_start"), F.count_if(F.col(event) == "run_end").alias("run_end"))
    return got.withColumn("resumed_or_interrupted", F.col("run_start") > 1)
