"""Running totals in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, order: str, values: dict[str, Column], width: int = 65_536) -> DataFrame:
    """``df`` with a running sum over all rows up to this one by ``order`` for each of ``values``.

    ``order`` is a bigint unique in the table. Rows are put into ranges of
    ``width`` keys (a power of two); sums run inside each range, and the totals of the ranges (one
    row per range) run in a second, far smaller pass of the same kind. All values
    share one pass. Null values count as 0.
    """
    outs = list(values)
    key = F.col(f"`{order}`")
    if width & (width - 1):
        raise ValueError("the width of a range is a power of two")
    rows = df.withColumns({f"_v{i}": F.coalesce(values[o], F.lit(0)) for i, o in enumerate(outs)})
    rows = rows.withColumn("_bucket", F.shiftright(key, width.bit_length() - 1))
    sums = lambda src, dst: [F.sum(f"{src}{i}").alias(f"{dst}{i}") for i in range(len(outs))]
    totals = rows.groupBy("_bucket").agg(*sums("_v", "_t")).withColumn("_outer", F.shiftright("_bucket", 16))
    # Ranges of ranges: the outermost window sees one row per 65,536 ranges.
    top = Window.orderBy("_outer").rowsBetween(Window.unboundedPreceding, -1)
    outer = totals.groupBy("_outer").agg(*sums("_t", "_o"))
    outer = outer.select("_outer", *[F.coalesce(F.sum(f"_o{i}").over(top), F.lit(0)).alias(f"_b{i}") for i in range(len(outs))])
    mid = Window.partitionBy("_outer").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.withColumns({f"_m{i}": F.coalesce(F.sum(f"_t{i}").over(mid), F.lit(0)) for i in range(len(outs))})
    base = inside.join(outer, "_outer").select("_bucket", *[(F.col(f"_m{i}") + F.col(f"_b{i}")).alias(f"_base{i}") for i in range(len(outs))])
    inner = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"_r{i}": F.sum(f"_v{i}").over(inner) for i in range(len(outs))}).join(base, "_bucket")
    done = run.withColumns({o: F.col(f"_r{i}") + F.col(f"_base{i}") for i, o in enumerate(outs)})
    return done.drop("_bucket", *[f"{p}{i}" for i in range(len(outs)) for p in ("_v", "_r", "_base")])


def running_total(df: DataFrame, order: str, value: Column, out: str, width: int = 65_536) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, order, {out: value}, width)
