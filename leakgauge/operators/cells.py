"""Cells of the audit: recall, flips, paired arms, families of tests, the consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakgauge.functions import stats


def recall_cell(df: DataFrame, by: list[str], ok: Column, verbatim: Column, overlap: Column) -> DataFrame:
    """Verbatim rate with its interval, mean and deviation of the overlap over ok rows."""
    rows = df.where(ok).select(*by, F.coalesce(verbatim, F.lit(False)).alias("_v"), F.coalesce(overlap, F.lit(0.0)).alias("_o"))
    mean, sd = stats.mean_sd(F.col("_o"))
    got = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("_v").alias("verbatim_hits"), mean.alias("mean_overlap8"), sd.alias("overlap8_sd"))
    lo, hi = stats.wilson(F.col("verbatim_hits"), F.col("n"))
    return got.select(*by, "n", "verbatim_hits", F.round(F.col("verbatim_hits") / F.col("n"), 4).alias("verbatim_rate"), lo.alias("ci_lo"), hi.alias("ci_hi"), "mean_overlap8", "overlap8_sd")


def arms_wide(long: DataFrame, by: list[str], item: list[str], arm: str, arms: list[str], value: str) -> DataFrame:
    """One row per item with a column per arm, by one aggregate instead of joins."""
    return long.where(F.col(arm).isin(*arms)).groupBy(*by, *item).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms])


def discordant(wide: DataFrame, by: list[str], first: str, second: str, prefix: str = "") -> DataFrame:
    """Pairs where only the first arm is right (pos), only the second (neg), and the exact p."""
    both = wide.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    got = both.groupBy(*by).agg(
        F.count("*").alias(f"{prefix}n_pairs"),
        F.count_if(F.col(first) & ~F.col(second)).alias(f"{prefix}pos"),
        F.count_if(~F.col(first) & F.col(second)).alias(f"{prefix}neg"),
    )
    return got.withColumn(f"{prefix}p_raw", F.round(stats.mcnemar(F.col(f"{prefix}pos"), F.col(f"{prefix}neg")), 4))


def flip_aggs(ok: Column, follows: Column, correct: Column, base_ok: Column, base_correct: Column) -> list[Column]:
    """Counts of answered substituted calls, of those that follow the plant, and of discordant pairs with the base arm.

    Flags are never null; a call that wasn't made isn't ok. An unreadable answer is
    a wrong one, as it was given.
    """
    both = ok & base_ok
    return [
        F.count_if(ok).alias("n_flip"), F.count_if(ok & follows).alias("flip_follows"),
        F.count_if(both & base_correct & ~correct).alias("pos"), F.count_if(both & ~base_correct & correct).alias("neg"),
    ]


def flip_columns(counts: DataFrame) -> DataFrame:
    """Share of calls that follow the plant with its interval, and the exact p of the discordant pairs."""
    lo, hi = stats.wilson(F.col("flip_follows"), F.col("n_flip"))
    rate = F.when(F.col("n_flip") > 0, F.round(F.col("flip_follows") / F.col("n_flip"), 4))
    return counts.withColumns({"flip_follow_rate": rate, "flip_lo": lo, "flip_hi": hi, "n_pairs": F.col("pos") + F.col("neg"), "p_raw": F.round(stats.mcnemar(F.col("pos"), F.col("neg")), 4)})


def _contrasts(arms: list[str]) -> list[tuple[str, str]]:
    return [(arms[0], x) for x in arms[1:]] + [(arms[1], arms[2])] if len(arms) == 3 else [(arms[0], arms[1])]


def matched_aggs(arms: list[str]) -> list[Column]:
    """Counts over the items that all arms answered (none is null)."""
    full = F.greatest(*[F.col(a).isNull().cast("int") for a in arms]) == 0
    aggs = [F.count_if(full).alias("matched_n"), *[F.count_if(full & F.col(a)).alias(f"{a}_correct") for a in arms]]
    for x, y in _contrasts(arms):
        aggs += [F.count_if(full & F.col(x) & ~F.col(y)).alias(f"{y}_vs_{x}_pos"), F.count_if(full & ~F.col(x) & F.col(y)).alias(f"{y}_vs_{x}_neg")]
    return aggs


def matched_columns(counts: DataFrame, arms: list[str]) -> DataFrame:
    """Accuracy of each arm with its interval, and the exact p of each contrast; null where no item is matched."""
    n = F.nullif(F.col("matched_n"), F.lit(0))
    for a in arms:
        lo, hi = stats.wilson(F.col(f"{a}_correct"), F.col("matched_n"))
        counts = counts.withColumns({f"{a}_acc": F.round(F.col(f"{a}_correct") / n, 4), f"{a}_lo": lo, f"{a}_hi": hi})
    for x, y in _contrasts(arms):
        counts = counts.withColumn(f"{y}_vs_{x}_p", F.when(n.isNotNull(), F.round(stats.mcnemar(F.col(f"{y}_vs_{x}_pos"), F.col(f"{y}_vs_{x}_neg")), 4)))
    return counts


def matched_arms(wide: DataFrame, by: list[str], arms: list[str]) -> DataFrame:
    """Accuracy of each arm over the items that all arms answered, and the contrasts."""
    return matched_columns(wide.groupBy(*by).agg(*matched_aggs(arms)).where("matched_n > 0"), arms)


def corrected(pvals: DataFrame, family: list[str], p: str = "p_raw") -> DataFrame:
    """``pvals`` with the family's size and the Bonferroni value of each test."""
    w = Window.partitionBy(*family)
    return pvals.withColumn("tests", F.count("*").over(w)).withColumn("p_bonf", stats.bonferroni(F.col(p), F.col("tests")))


def consensus(cells: DataFrame, margin: float = 0.10, level: float = 0.05) -> DataFrame:
    """Indications and calls with and without the recall modality, and the adjudication.

    Reads ``mean_overlap8, verbatim_rate, flip_rate, b_acc, c_acc, min_p``. Two of
    three indications and a corrected dynamic p under ``level`` make a flag.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    m1 = (zero("mean_overlap8") > 0.5) & (zero("verbatim_rate") > 0.5)
    m2a = zero("flip_rate") > 0.5
    m2b = F.coalesce(F.col("b_acc") < F.col("c_acc") - margin, F.lit(False))
    dynamic = F.coalesce(F.col("min_p"), F.lit(1.0)) < level
    n = lambda *xs: sum((x.cast("int") for x in xs), F.lit(0))
    out = cells.withColumns({"ind_m1": m1, "ind_m2a": m2a, "ind_m2b": m2b})
    i1, i2, i3 = F.col("ind_m1"), F.col("ind_m2a"), F.col("ind_m2b")
    out = out.withColumns({"raw_flag": (n(i1, i2, i3) >= 2) & dynamic, "discount_flag": (n(i2, i3) >= 2) & dynamic})
    call = F.when(F.col("raw_flag") & F.col("discount_flag"), "CONTAMINATED").when(F.col("raw_flag"), "THRESHOLD-DEPENDENT (M1-sensitive)").otherwise("no significant contamination detected")
    return out.withColumn("adjudication", call)
