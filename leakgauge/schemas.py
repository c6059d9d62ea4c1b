"""Fixed schemas as DDL; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """The schema as an object; needs a running session."""
    return T.StructType.fromDDL(ddl)


#: Multiple-choice items as published.
MC_ITEM = ("source string, subject string, question string, choices string, answer string, answer_idx string, cot string")
#: Question and answer items as published.
QA_ITEM = ("source string, question string, answer string, category string, qid string, edited_answer string, label string")
#: What the ``questions`` of an article file hold, an object or that object as text.
QUESTIONS = ("items array<struct<question string, answer string, category string>>")

USAGE = (
    "struct<prompt_tokens int, completion_tokens int, total_tokens int, "
    "prompt_tokens_details struct<cached_tokens int>, completion_tokens_details struct<reasoning_tokens int>>"
)
#: A line of the ledger: a call, or an event marker where ``event`` is set.
LEDGER = (
    "ts string, event string, phase string, benchmark string, model string, probe string, item_idx int, item_key string, "
    f"usage_api {USAGE}, cost_est_usd double, retries int, retry_log array<struct<attempt int, error string, backoff_s double>>, "
    "retry_hard string, ok boolean, error string, took_s double, raw string, overlap8 double, verbatim_hit boolean, truth_text string, "
    "parsed_letter string, answer_correct boolean, flip_follow boolean, translation string, arm string, "
    "qa_match boolean, qa_level string, qa_sim double, qa_match_lenient boolean, gold_used string"
)
