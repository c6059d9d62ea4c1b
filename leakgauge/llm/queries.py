"""Named queries of the training-text operators. No SQL twin can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.llm import leaks, lookalikes, mojibake, pairs, tokens
from leakgauge.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoke, m1 = table(spark, sf_dir, "smoke_backtrans_bc"), table(spark, sf_dir, "m1_smoke")
    return lookalikes.found([("smoke_backtrans_bc", "soru", smoke), ("m1_smoke", "truth_text", m1), ("m1_smoke", "raw", m1)])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pilot = table(spark, sf_dir, "pilot").select(F.lit("pilot").alias("src_table"), "line_no", "prompt", F.col("raw").alias("answer"))
    name = "transport_smoke_2026_08_16"
    sent = table(spark, sf_dir, name).select(F.lit(name).alias("src_table"), "line_no", "prompt", F.col("content").alias("answer"))
    flagged = pairs.flag_pairs(pilot.unionByName(sent), "prompt", "answer", ["src_table", "line_no"])
    return flagged.where(F.col("defect").isNotNull())


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "heldout_items").withColumn("item_text", F.concat_ws(" ", "soru", "cevap"))
    return leaks.found(table(spark, sf_dir, "documents"), "text", "doc_id", items, "item_text", "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(table(spark, sf_dir, "documents"), "text", ["doc_id"]).where("affected").select("doc_id")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(table(spark, sf_dir, "documents"), "text", ["doc_id"]).where("affected").select("doc_id", "restored")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p4_found": p4_found, "p5_ids": p5_ids, "p6_found": p6_found, "p7_found": p7_found, "p7_restored": p7_restored}


def oracle_sql() -> dict[str, str]:
    return {}
