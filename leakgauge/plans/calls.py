"""The call ledger: last line wins, resume, failures, rollups, checkpoints."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.operators import items as it
from leakgauge.operators import ledger, sample
from leakgauge.operators.packed import split_packed
from leakgauge.operators.prefix import running_total
from leakgauge.session import table

SENT = "transport_smoke_2026_08_16"
SPEND = "spend_full_2026_08_16"
PROBES = ["blackbox", "choice_sub"]
EVERY = 500
# Fixed value: errors after which a call may be tried again.
RETRYABLE = r"(?i)(429|5\d\d|rate.?limit|overload|too many|timeout|timed out|connection|econn)"


def ledger_dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pilot").select("i", "probe_type", "model", "line_no", "raw")
    return ledger.last_wins(t, ["i", "probe_type", "model"], "line_no")


def _models(spark: SparkSession, d: str) -> list[str]:
    """Names of the models, a list as short as a run's configuration."""
    return [r[0] for r in table(spark, d, "pilot").select("model").distinct().orderBy("model").collect()]


def task_crossjoin(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "heldout_items").select("item_id", "bench")
    planned = ledger.tasks(items.select("item_id"), "item_id", _models(spark, d), PROBES)
    kinds = items.join(planned, "item_id").where("not (bench = 'ragturk_like' and probe = 'choice_sub')")
    return kinds.groupBy("bench", "model", "probe").agg(F.count("*").alias("n_tasks"))


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of the items seen so far that no logged call has done."""
    log = table(spark, d, "pilot").select("i", "model", F.col("probe_type").alias("probe"))
    planned = ledger.tasks(log.select("i").distinct(), "i", _models(spark, d), PROBES)
    return ledger.todo(planned, log, ["i", "model", "probe"])


def failed_items_semi(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, SENT).select("line_no", "model", "prompt", "ok")
    return ledger.failed_items(calls, ["model", "prompt"], ~F.coalesce("ok", F.lit(False))).select("line_no", "ok")


def recurring_failure(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, SENT).select("line_no", "prompt", "ok")
    return ledger.recurring(calls, ["prompt"], "line_no", ~F.coalesce("ok", F.lit(False))).select("line_no", "failed_before")


def _usage() -> list[Column]:
    """Nested usage as flat counts, missing structs as nought."""
    inside = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_tokens_details.cached_tokens", "completion_tokens_details.reasoning_tokens")
    return [F.coalesce(F.col(f"usage_api.{c}"), F.lit(0)).cast("bigint").alias(c.rpartition(".")[2]) for c in inside]


def usage_flat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, SENT).select("line_no", *_usage())


def spend_by_model(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, SENT).select("model", "ok", "retries", *_usage())
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("fail"),
        F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "reasoning_tokens")],
    )


def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Logged cost of each model; a model without a rate has none, which isn't nought."""
    t = table(spark, d, "m1_smoke").groupBy("model").agg(F.count("*").alias("calls"), F.count("cost_usd").alias("priced"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    return t.withColumn("has_rate", F.col("priced") > 0)


def spend_totals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, SENT)
    return t.agg(F.count("*").alias("calls"), F.coalesce(F.sum("usage_api.total_tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries"))


def ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Calls and answers by model, by probe and in all, in one pass over the log."""
    t = table(spark, d, "pilot").select("model", "probe_type", "raw")
    return t.groupingSets([["model"], ["probe_type"], []], "model", "probe_type").agg(F.count("*").alias("calls"), F.count("raw").alias("answered"))


def spend_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return ledger.checkpoints(table(spark, d, SENT).select("line_no", "usage_api"), "line_no", F.col("usage_api.total_tokens"), EVERY)


def run_event_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, SPEND).withColumn("t", F.try_to_timestamp("ts", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return t.groupBy("run_id").agg(
        F.count("*").alias("checkpoints"), F.date_format(F.min("t"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.date_format(F.max("t"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"),
        (F.unix_timestamp(F.max("t")) - F.unix_timestamp(F.min("t"))).alias("elapsed_s"), F.coalesce(F.bool_or("abort"), F.lit(False)).alias("aborted"),
        F.round(F.max("accumulated_cost_est_usd"), 6).alias("max_cost"),
    )


def retryable_errors(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, SENT).where("error is not null")
    return t.groupBy("error", F.col("error").rlike(RETRYABLE).alias("retryable")).agg(F.count("*").alias("n"))


def message_text(spark: SparkSession, d: str) -> DataFrame:
    """What a call has to show: its content, else the end of its error."""
    t = table(spark, d, SENT)
    return t.select("line_no", F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.right(F.col("error"), F.lit(200))).alias("message"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.hash_sample(table(spark, d, "heldout_items").select("item_id", "bench"), "item_id", 50)


def mt_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of the items by their order, the same for every reader."""
    t = table(spark, d, "heldout_items").select("item_id", "bench")
    # Places in the order come from a prefix sum, so no task sees all items.
    pos = running_total(t, "item_id", F.lit(1), "place").select("item_id", "bench", (F.col("place") - 1).cast("int").alias("row_idx"))
    return pos.join(F.broadcast(sample.twister_sample(spark, t.count(), 50)), "row_idx").select("item_idx", "item_id", "bench")


def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct questions by source (spelling folded) and split."""
    t = table(spark, d, "datasets_v2")
    name = F.regexp_replace(F.lower(F.trim("source")), r"[^a-z0-9]+", "_")
    return t.groupBy(name.alias("source"), "split_name").agg(F.count("*").alias("rows"), F.countDistinct("question").alias("questions"), F.count_if(F.col("answer").isNull()).alias("null_answers"))


def normal_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as letter and index among five choices."""
    letter, idx = it.normal_answer(F.col("answer"), F.lit(5))
    return table(spark, d, "datasets_v2").select("line_no", letter.alias("letter"), idx.cast("int").alias("idx"), it.index_letter(idx, F.lit(5)).alias("shown"))


def answer_index(spark: SparkSession, d: str) -> DataFrame:
    """Index of the true choice: the item's stored one, else the logged letter's."""
    stored = ledger.last_wins(table(spark, d, "smoke_backtrans_bc").where("truth_idx is not null").select("i", "line_no", "truth_idx"), ["i"], "line_no").select("i", "truth_idx")
    t = table(spark, d, "m1_smoke").select("line_no", "i", "truth_letter").join(stored, "i", "left")
    return t.select("line_no", it.true_index(F.col("truth_idx"), F.col("truth_letter"), F.lit(5)).cast("int").alias("idx"))


def translation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The logged items with their cached translation and back-translation, and the English text or an empty one."""
    items = table(spark, d, "pilot").select("i").distinct()
    got = ledger.looked_up(items, table(spark, d, "smoke_backtrans_bc").select("i", "line_no", "c_en", "b_backtr"), ["i"], "line_no", ["c_en", "b_backtr"])
    return got.select("i", "cached", F.col("b_backtr").alias("backtr_tr"), F.col("c_en").alias("en_direct"), F.coalesce("c_en", F.lit("")).alias("gold_en"))


def plant_next_answer(spark: SparkSession, d: str) -> DataFrame:
    t = it.next_answer(table(spark, d, "heldout_items").select("bench", "item_id", "cevap"), "bench", "item_id", "cevap")
    return t.where("planted <> cevap").select("bench", "item_id", "planted")


def option_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Choices of every exam item shuffled by its own seed, with the letter of the true one."""
    t = table(spark, d, "smoke_backtrans_bc")
    one = ledger.last_wins(t.select("i", "line_no", "truth_idx", "secenekler"), ["i"], "line_no")
    vals = split_packed(one, "secenekler").groupBy("i").agg(F.max("truth_idx").alias("truth_idx"), F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("v"))
    vals = vals.select("i", "truth_idx", F.col("v.val").alias("choices"))
    got = vals.withColumn("perm", sample.shuffled("i", F.size("choices")))
    return got.select("i", sample.permuted(F.col("choices"), F.col("perm")).alias("shuffled"), sample.new_letter(F.col("perm"), F.col("truth_idx")).alias("new_letter"))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_dedup_last_wins, task_crossjoin, resume_anti_join, failed_items_semi, recurring_failure, usage_flat, spend_by_model, cost_by_model,
        spend_totals, ledger_rollup, spend_checkpoints, run_event_summary, retryable_errors, message_text, hash_sample, mt_sample, dataset_manifest,
        normal_answers, answer_index, translation_lookup, plant_next_answer, option_permutation,
    )
}

_TASKS = "from (select distinct {k} from {t}) a, (select distinct model from pilot) m, (select unnest(['blackbox', 'choice_sub']) as probe) p"
SQL = {
    "ledger_dedup_last_wins": "select i, probe_type, model, line_no, raw from pilot qualify row_number() over (partition by i, probe_type, model order by line_no desc) = 1",
    "task_crossjoin": """select bench, model, probe, count(*) as n_tasks from heldout_items, (select distinct model from pilot), (select unnest(['blackbox', 'choice_sub']) as probe)
      where not (bench = 'ragturk_like' and probe = 'choice_sub') group by bench, model, probe""",
    "resume_anti_join": f"select i, model, probe {_TASKS.format(k='i', t='pilot')} except select i, model, probe_type from pilot",
    "failed_items_semi": f"""select line_no, ok from {SENT} where (model, prompt) in (select (model, prompt) from {SENT} where not coalesce(ok, false))""",
    "recurring_failure": f"""select line_no, coalesce(bool_or(not coalesce(ok, false)) over (partition by prompt order by line_no rows between unbounded preceding and 1 preceding), false)
      and prompt is not null as failed_before from {SENT}""",
    "usage_flat": f"""select line_no, coalesce(usage_api.prompt_tokens, 0)::bigint as prompt_tokens, coalesce(usage_api.completion_tokens, 0)::bigint as completion_tokens,
      coalesce(usage_api.total_tokens, 0)::bigint as total_tokens, coalesce(usage_api.prompt_tokens_details.cached_tokens, 0)::bigint as cached_tokens,
      coalesce(usage_api.completion_tokens_details.reasoning_tokens, 0)::bigint as reasoning_tokens from {SENT}""",
    "spend_by_model": f"""select model, count(*) as calls, count(*) filter (where ok) as ok, count(*) filter (where not coalesce(ok, false)) as fail,
      coalesce(sum(retries), 0)::bigint as retries, sum(coalesce(usage_api.prompt_tokens, 0))::bigint as prompt_tokens, sum(coalesce(usage_api.completion_tokens, 0))::bigint as completion_tokens,
      sum(coalesce(usage_api.prompt_tokens_details.cached_tokens, 0))::bigint as cached_tokens, sum(coalesce(usage_api.completion_tokens_details.reasoning_tokens, 0))::bigint as reasoning_tokens
      from {SENT} group by model""",
    "cost_by_model": "select model, count(*) as calls, count(cost_usd) as priced, round(sum(cost_usd), 6) as cost_usd, count(cost_usd) > 0 as has_rate from m1_smoke group by model",
    "spend_totals": f"select count(*) as calls, coalesce(sum(usage_api.total_tokens), 0)::bigint as tokens, coalesce(sum(retries), 0)::bigint as retries from {SENT}",
    "ledger_rollup": "select model, probe_type, count(*) as calls, count(raw) as answered from pilot group by grouping sets ((model), (probe_type), ())",
    "spend_checkpoints": f"""with r as (select row_number() over w as calls_logged, coalesce(usage_api.total_tokens, 0) as v, sum(coalesce(usage_api.total_tokens, 0)) over w as s
      from {SENT} window w as (order by line_no rows unbounded preceding)) select calls_logged, (s - v)::bigint as accumulated from r where calls_logged % {EVERY} = 0""",
    "run_event_summary": f"""with t as (select *, try_strptime(ts, '%Y-%m-%dT%H:%M:%S') as t from {SPEND})
      select run_id, count(*) as checkpoints, strftime(min(t), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(t), '%Y-%m-%d %H:%M:%S') as last_ts,
      date_diff('second', min(t), max(t)) as elapsed_s, coalesce(bool_or(abort), false) as aborted, round(max(accumulated_cost_est_usd), 6) as max_cost from t group by run_id""",
    "retryable_errors": f"select error, regexp_matches(error, '{RETRYABLE}') as retryable, count(*) as n from {SENT} where error is not null group by all",
    "message_text": f"select line_no, coalesce(nullif(trim(content), ''), right(error, 200)) as message from {SENT}",
    "mt_sample": f"""with s(item_idx, row_idx) as (values {", ".join(f"({k}, {x})" for k, x in enumerate(random.Random(42).sample(range(240), 50)))}),
      o as (select item_id, bench, row_number() over (order by item_id) - 1 as row_idx from heldout_items) select item_idx, item_id, bench from s join o using (row_idx)""",
    "hash_sample": "select item_id, bench, md5('42|' || item_id) as sample_hash from heldout_items order by sample_hash, item_id limit 50",
    "dataset_manifest": """select regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g') as source, split_name, count(*) as rows, count(distinct question) as questions,
      count(*) filter (where answer is null) as null_answers from datasets_v2 group by all""",
    "normal_answers": """with n as (select line_no, nullif(upper(trim(answer)), '') as letter from datasets_v2),
      x as (select *, case when length(letter) = 1 and ascii(letter) between 65 and 69 then ascii(letter) - 65 end as idx from n)
      select line_no, letter, idx, case when idx is not null then chr(65 + idx) else '?' end as shown from x""",
    "answer_index": """with s as (select i, truth_idx from smoke_backtrans_bc where truth_idx is not null qualify row_number() over (partition by i order by line_no desc) = 1)
      select line_no, case when truth_idx between 0 and 4 then truth_idx when regexp_full_match(upper(trim(truth_letter)), '[A-E]') then ascii(upper(trim(truth_letter))) - 65 end as idx from m1_smoke m left join s on s.i = m.i""",
    "translation_lookup": """with c as (select i, c_en, b_backtr from smoke_backtrans_bc where c_en is not null and b_backtr is not null qualify row_number() over (partition by i order by line_no) = 1)
      select p.i, c.i is not null as cached, b_backtr as backtr_tr, c_en as en_direct, coalesce(c_en, '') as gold_en from (select distinct i from pilot) p left join c on c.i = p.i""",
    "plant_next_answer": """with n as (select bench, item_id, cevap, coalesce(lead(cevap) over w, first_value(cevap) over w) as planted from heldout_items window w as (partition by bench order by item_id))
      select bench, item_id, planted from n where planted <> cevap""",
}
