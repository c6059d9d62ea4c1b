"""Seeded samples, permutations and coins that depend on a position only."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows whose seeded key hash is least; ties go to the smaller key.

    A top-k: each partition keeps ``n`` rows, nothing is sorted as a whole.
    """
    return df.withColumn("sample_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).orderBy("sample_hash", key).limit(n)


def twister_sample(spark: SparkSession, population: int, n: int, seed: int = 42) -> DataFrame:
    """``item_idx, row_idx`` of a Mersenne Twister sample without replacement.

    The sample depends on the population's size alone, so the indices are drawn on
    the driver (``n`` of them) and joined with the rows.
    """
    drawn = random.Random(seed).sample(range(population), min(n, population))
    return spark.createDataFrame(list(enumerate(drawn)), "item_idx int, row_idx int")


def coin(position: str, seed: int = 42) -> Column:
    """Whether the true answer of the item at ``position`` stands first; it depends on seed and position only."""

    @F.pandas_udf("boolean")
    def toss(i: pd.Series) -> pd.Series:
        return i.map(lambda k: None if pd.isna(k) else random.Random(seed + int(k)).random() < 0.5)

    return toss(position)


def shuffled(position: str, size: Column, seed: int = 42) -> Column:
    """Places 0 to ``size`` - 1 in the order of the item at ``position``; it depends on seed, position and size only."""

    @F.pandas_udf("array<int>")
    def order(i: pd.Series, k: pd.Series) -> pd.Series:
        def one(pos: int, n: int) -> list[int]:
            places = list(range(int(n)))
            random.Random(seed + int(pos)).shuffle(places)
            return places

        return pd.Series([None if pd.isna(a) or pd.isna(n) else one(a, n) for a, n in zip(i, k)], dtype=object)

    return order(F.col(position), size)


def permuted(choices: Column, perm: Column) -> Column:
    return F.transform(perm, lambda i: F.get(choices, i))


def new_letter(perm: Column, truth_idx: Column) -> Column:
    """Letter of the true choice after the shuffle; null where the index is out of range."""
    at = F.array_position(perm, truth_idx)
    return F.when(at > 0, F.chr((at + 64).cast("int")))
