"""Queries over packed fields and damaged records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.operators import packed, rejects
from leakgauge.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "smoke_backtrans_bc").select(F.lit("smoke_backtrans_bc").alias("src_table"), "line_no", F.col("secenekler").alias("packed"))
    b = table(spark, sf_dir, "datasets_v2").select(F.lit("datasets_v2").alias("src_table"), "line_no", F.col("choices").alias("packed"))
    return packed.split_packed(a.unionByName(b), "packed")


def p3_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every judged record with its reason; null where it loads."""
    raw, key = table(spark, sf_dir, "raw_lines"), ["src_table", "line_no"]
    raw = raw.withColumn("src_table", F.lit("raw_lines"))
    pilot = rejects.judge_records(raw.where("feed = 'pilot'"), "line_text", rejects.PILOT, key)
    spend = rejects.judge_records(raw.where("feed <> 'pilot'"), "line_text", rejects.SPEND, key)
    name = "spend_full_2026_08_16"
    cells = rejects.judge_cells(table(spark, sf_dir, name).withColumn("src_table", F.lit(name)), "calls_logged", rejects.is_digits, key)
    return pilot.select(*key, "reason").unionByName(spend.select(*key, "reason")).unionByName(cells)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_judged(spark, sf_dir).where(F.col("reason").isNotNull())


def p3_loaded_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pilot records that load, typed."""
    raw = table(spark, sf_dir, "raw_lines").where("feed = 'pilot'")
    got = rejects.judge_records(raw, "line_text", rejects.PILOT, ["line_no"]).where(F.col("reason").isNull())
    t = lambda c: F.trim(F.col(c))
    return got.select("line_no", t("i").cast("decimal(38,0)").alias("i"), t("subject").alias("subject"), t("type").alias("type"), t("model").alias("model"), "raw")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_loaded_pilot": p3_loaded_pilot}

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_FIELD = _TRIM.format("case when f[{0}][1] = '\"' then replace(f[{0}][2:length(f[{0}]) - 1], '\"\"', '\"') else f[{0}] end")
_IS_TIME = r"regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') and try_cast({0} as timestamp) is not null"
_AMOUNT = r"regexp_full_match({}, '[0-9]+(\.[0-9]+)?')"
SQL: dict[str, str] = {
    # Rejects only: what loads is tested against the csv module.
    "p3_found": rf"""
with r as (select line_no, feed, coalesce(line_text, '') as x from raw_lines),
s as (select line_no, feed, not regexp_full_match(x, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') as broken,
  regexp_extract_all(',' || x, ',("(?:[^"]|"")*"|[^",]*)', 1) as f from r),
v as (select line_no, feed, broken, len(f) as n, {", ".join(f"coalesce({_FIELD.format(k)}, '') as f{k}" for k in range(1, 6))} from s),
j as (select line_no, case when broken then 'broken_quote' when n <> 5 then 'column_count'
  when feed = 'pilot' and not (regexp_full_match(f1, '[0-9]+') and f2 <> '' and f3 in ('blackbox', 'choice_sub') and f4 <> '') then 'bad_value'
  when feed <> 'pilot' and not ({_IS_TIME.format("f1")} and regexp_full_match(f2, '[0-9]+') and {_AMOUNT.format("f3")} and {_AMOUNT.format("f4")} and lower(f5) in ('true', 'false')) then 'bad_value' end as reason from v)
select 'raw_lines' as src_table, line_no, reason from j where reason is not null
union all select 'spend_full_2026_08_16', line_no, 'bad_value' from spend_full_2026_08_16
  where not coalesce(regexp_full_match({_TRIM.format("calls_logged")}, '[0-9]+'), false)""",
}
