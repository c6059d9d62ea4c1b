"""Paired statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wilson(k: Column, n: Column, sign: int, z: float) -> Column:
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre + sign * half


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1, four places; (0, 0) for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    lo = F.when(n > 0, F.round(F.greatest(_wilson(k, n, -1, z), F.lit(0.0)), 4)).otherwise(F.lit(0.0))
    hi = F.when(n > 0, F.round(F.least(_wilson(k, n, 1, z), F.lit(1.0)), 4)).otherwise(F.lit(0.0))
    return lo, hi


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z2 = "3.8416"
    c = f"(({k})::double/({n}) + {z2}/(2.0*({n})))/(1+{z2}/({n}))"
    h = f"1.96*sqrt(({k})::double/({n})*(1-({k})::double/({n}))/({n}) + {z2}/(4.0*({n})*({n})))/(1+{z2}/({n}))"
    return (f"case when ({n})>0 then round(greatest({c}-{h},0.0),4) else 0.0 end", f"case when ({n})>0 then round(least({c}+{h},1.0),4) else 0.0 end")


def mcnemar(a: Column, b: Column) -> Column:
    """Exact two-sided p of the discordant counts: twice the smaller binomial tail, 1 at most.

    The tail is summed from logarithms, so no count is too large. The sum runs over
    the smaller count; it is one row's own work and small for any real table.
    """
    n, m = (a + b).cast("double"), F.least(a, b).cast("int")
    # Log of each term from the one before: ln C(n, k+1) = ln C(n, k) + ln((n-k)/(k+1)).
    state = F.struct((-n * F.lit(0.6931471805599453)).alias("t"), F.lit(0.0).alias("s"))

    def step(x: Column, k: Column) -> Column:
        return F.struct((x.t + F.log((n - k) / (k + 1.0))).alias("t"), (x.s + F.exp(x.t)).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(0), m), state, lambda x, k: step(x, k.cast("double")), lambda x: x.s)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar_sql(a: str, b: str) -> str:
    n = f"(({a})+({b}))"
    terms = f"list_transform(range(0, least(({a}),({b}))::bigint+1), lambda k: exp(lgamma({n}+1.0)-lgamma(k+1.0)-lgamma({n}-k+1.0)-{n}*ln(2.0)))"
    return f"case when {n}=0 then 1.0 else least(1.0, 2*list_sum({terms})) end"


def bonferroni(p: Column, tests: Column) -> Column:
    return F.round(F.least(F.lit(1.0), p * tests), 4)


def mean_sd(c: Column) -> tuple[Column, Column]:
    """Mean and population deviation, four places; null for no rows."""
    return F.round(F.avg(c), 4), F.round(F.stddev_pop(c), 4)
