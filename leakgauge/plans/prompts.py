"""Prompts and records of the probes, as data."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.functions import letters, lists, stats
from leakgauge.functions.text import letter_of
from leakgauge.operators import cells, ledger, sample
from leakgauge.operators import items as it
from leakgauge.operators.packed import split_packed
from leakgauge.session import cut, table

SENT = "transport_smoke_2026_08_16"


def _exam(spark: SparkSession, d: str) -> DataFrame:
    """``i, soru, truth_idx, choices`` of every exam item, the last line winning."""
    t = table(spark, d, "smoke_backtrans_bc").select("i", "line_no", "soru", "truth_idx", "secenekler")
    one = ledger.last_wins(t, ["i"], "line_no")
    vals = split_packed(one.select("i", "secenekler"), "secenekler").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("v"))
    return one.select("i", "soru", "truth_idx").join(vals, "i").select("i", "soru", "truth_idx", F.col("v.val").alias("choices"))


def exam_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The question with lettered options and its true letter; a question mark where there is none."""
    t = _exam(spark, d)
    return t.select("i", it.exam_text(F.col("soru"), F.col("choices")).alias("prompt"), F.coalesce(it.index_letter(F.col("truth_idx"), F.size("choices")), F.lit("?")).alias("truth"))


def planted_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The first wrong choice replaced by the next item's answer; degenerate items left out."""
    t = _exam(spark, d).where("truth_idx between 0 and size(choices) - 1").withColumn("correct", F.get("choices", F.col("truth_idx")))
    t = it.following(cut(t), "i", "correct", "other")
    choices, letter = it.plant(F.col("choices"), F.col("correct"), F.col("other"))
    t = t.withColumns({"planted_choices": choices, "planted_letter": letter}).where("planted_letter is not null")
    return t.select("i", "planted_letter", "other", it.exam_text(F.col("soru"), F.col("planted_choices")).alias("prompt"))


def recall_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that ask for the exact text of each held-out answer."""
    return table(spark, d, "heldout_items").select("item_id", it.recall_text(F.col("soru")).alias("prompt"), F.col("cevap").alias("truth_text"))


def recall_exam_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The same for exam items: options in the item's own order, and the true one's text."""
    t = _exam(spark, d).where("truth_idx is not null").withColumn("perm", sample.shuffled("i", F.size("choices")))
    truth = F.coalesce(F.get("choices", F.col("truth_idx")), F.lit(""))
    return t.select("i", it.recall_text(F.col("soru"), sample.permuted(F.col("choices"), F.col("perm"))).alias("prompt"), truth.alias("truth_text"))


def flip_prompts(spark: SparkSession, d: str) -> DataFrame:
    """True against edited answer (here the next item's), sides by a seeded coin."""
    t = it.next_answer(table(spark, d, "heldout_items").select("bench", "item_id", "soru", "cevap"), "bench", "item_id", "cevap", "edited")
    got = t.withColumn("truth_first", sample.coin("item_id"))
    prompt = it.flip_prompt(F.col("soru"), F.col("cevap"), F.col("edited"), F.col("truth_first"))
    return got.select("item_id", F.when(F.col("truth_first"), "A").otherwise("B").alias("truth_letter"), prompt.alias("prompt")).where("prompt is not null")


def call_records(spark: SparkSession, d: str) -> DataFrame:
    """Logged answers as ledger records: key, probe family, answer of at most 400 characters."""
    t = table(spark, d, "pilot")
    return t.select(
        "line_no", F.concat_ws("|", F.lit("exam"), "model", "probe_type", F.col("i").cast("string")).alias("item_key"),
        F.substring_index("probe_type", "_", 1).alias("probe_family"), F.substring("raw", 1, 400).alias("raw"), F.col("raw").isNotNull().alias("ok"),
    )


def m1_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: answers, tokens, cost, hits and mean coverage of the recall log."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return table(spark, d, "m1_smoke").agg(
        F.count("*").alias("calls"), F.count("raw").alias("answered"), z("prompt_tokens"), z("cached_tokens"), z("completion_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count_if("verbatim_hit").alias("hits"), F.round(F.avg("overlap8"), 4).alias("mean_overlap8"),
    )


def mismatch_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first six wrong answers of the log with their letters."""
    truth = ledger.last_wins(table(spark, d, "smoke_backtrans_bc").where("truth_idx is not null").select("i", "line_no", "truth_idx"), ["i"], "line_no")
    t = table(spark, d, "pilot").select("line_no", "i", letters.parse_letter(F.col("raw"), "pilot").alias("letter"), F.substring("raw", 1, 70).alias("shown"))
    got = t.join(truth.select("i", letter_of(F.col("truth_idx")).alias("truth")), "i").where("letter <> truth")
    return got.orderBy("line_no").limit(6).select("line_no", "i", "truth", "letter", "shown")


def naive_lists(spark: SparkSession, d: str) -> DataFrame:
    """Packed choices as the reader that never evaluates sees them."""
    return table(spark, d, "datasets_v2").select("line_no", F.array_join(lists.naive_list(F.coalesce("choices", F.lit(""))), "¦").alias("items"))


def cells_json(spark: SparkSession, d: str) -> DataFrame:
    """Recall cells as one JSON object each."""
    from leakgauge.plans.scoring import m1_cell
    from leakgauge.sources.sinks import stats_json

    return stats_json(m1_cell(spark, d), ["model"])


def answers_wide(spark: SparkSession, d: str) -> DataFrame:
    """Letters of both probes side by side, from the long log."""
    t = table(spark, d, "pilot").select("i", "model", "probe_type", "line_no", "raw")
    last = ledger.last_wins(t, ["i", "model", "probe_type"], "line_no").withColumn("letter", letters.parse_letter(F.col("raw"), "pilot"))
    return cells.arms_wide(last, ["model"], ["i"], "probe_type", ["blackbox", "choice_sub"], "letter")


QUERIES = {f.__name__: f for f in (exam_prompts, planted_prompts, recall_prompts, recall_exam_prompts, flip_prompts, call_records, m1_summary, mismatch_sample, naive_lists, cells_json, answers_wide)}

_P = letters.parse_letter_sql("raw", "pilot")
_LO, _HI = stats.wilson_sql("verbatim_hits", "n")
_COINS = ", ".join(f"({k}, {random.Random(42 + k).random() < 0.5})" for k in range(2_000))
SQL = {
    # The coins of the first ids as a table; the test items' ids are below that.
    "flip_prompts": f"""with c(item_id, truth_first) as (values {_COINS}),
      n as (select item_id, soru, trim(cevap) as t, trim(coalesce(lead(cevap) over w, first_value(cevap) over w)) as e from heldout_items window w as (partition by bench order by item_id))
      select item_id, case when truth_first then 'A' else 'B' end as truth_letter, 'Soru: ' || soru || chr(10) || chr(10) || 'Hangisi doğru cevaptır?' || chr(10) || 'A) ' || case when truth_first then t else e end
      || chr(10) || 'B) ' || case when truth_first then e else t end || chr(10) || chr(10) || 'Cevap (tek harf A/B):' as prompt from n join c using (item_id) where length(t) > 0 and length(e) > 0 and t <> e""",
    "recall_prompts": f"""select item_id, 'Soru: ' || soru || '{it.RECALL_ANSWER.replace(chr(10), "' || chr(10) || '")}' as prompt, cevap as truth_text from heldout_items""",
    "cells_json": """with l as (select * from m1_smoke qualify row_number() over (partition by i, model, seed order by line_no desc) = 1),
      c as (select model, count(*) as n, count(*) filter (where coalesce(verbatim_hit, false)) as verbatim_hits, round(avg(coalesce(overlap8, 0)), 4) as mean_overlap8, round(stddev_pop(coalesce(overlap8, 0)), 4) as overlap8_sd
        from l where raw is not null group by model),
      s as (select model, n, verbatim_hits, round(verbatim_hits::double / n, 4) as verbatim_rate, """ + _LO + " as ci_lo, " + _HI + """ as ci_hi, mean_overlap8, overlap8_sd from c)
      select model as cell, json_object('n', n, 'verbatim_hits', verbatim_hits, 'verbatim_rate', verbatim_rate, 'ci_lo', ci_lo, 'ci_hi', ci_hi, 'mean_overlap8', mean_overlap8, 'overlap8_sd', overlap8_sd)::varchar as stats from s""",
    "call_records": "select line_no, concat_ws('|', 'exam', model, probe_type, i) as item_key, split_part(probe_type, '_', 1) as probe_family, raw[1:400] as raw, raw is not null as ok from pilot",
    "m1_summary": """select count(*) as calls, count(raw) as answered, coalesce(sum(prompt_tokens), 0)::bigint as prompt_tokens, coalesce(sum(cached_tokens), 0)::bigint as cached_tokens,
      coalesce(sum(completion_tokens), 0)::bigint as completion_tokens, round(sum(cost_usd), 6) as cost_usd, count(*) filter (where verbatim_hit) as hits, round(avg(overlap8), 4) as mean_overlap8 from m1_smoke""",
    "mismatch_sample": f"""with truth as (select i, chr((65 + truth_idx)::int) as truth from smoke_backtrans_bc where truth_idx is not null qualify row_number() over (partition by i order by line_no desc) = 1),
      a as (select line_no, p.i, truth, {_P} as letter, raw[1:70] as shown from pilot p join truth t on t.i = p.i)
      select line_no, i, truth, letter, shown from a where letter <> truth order by line_no limit 6""",
    "naive_lists": r"""with n as (select line_no, regexp_replace(trim(coalesce(choices, '')), '^[\[\]()\s]+|[\[\]()\s]+$', '', 'g') as b from datasets_v2)
      select line_no, case when length(b) > 0 then array_to_string(list_filter(list_transform(string_split(b, ','), lambda x: regexp_replace(trim(x), '^[''"\s]+|[''"\s]+$', '', 'g')), lambda x: length(x) > 0), '¦') else '' end as items from n""",
    "answers_wide": f"""with l as (select * from pilot qualify row_number() over (partition by i, model, probe_type order by line_no desc) = 1)
      select model, i, max({_P}) filter (where probe_type = 'blackbox') as blackbox, max({_P}) filter (where probe_type = 'choice_sub') as choice_sub from l group by model, i""",
}
