"""Scores of logged answers: recall, letters, matching."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.functions import letters, stats
from leakgauge.functions import text as tx
from leakgauge.operators import cells, ledger, matching
from leakgauge.session import table


def m1_overlap8(spark: SparkSession, d: str) -> DataFrame:
    """Share of the gold text's character 8-grams in the answer, and whether it is there whole."""
    t = table(spark, d, "m1_smoke").select("line_no", tx.collapsed(F.coalesce("truth_text", F.lit(""))).alias("t"), tx.collapsed(F.coalesce("raw", F.lit(""))).alias("o"))
    g = t.select("line_no", "t", "o", tx.char_grams(F.col("t"), 8).alias("tg"), tx.char_grams(F.col("o"), 8).alias("og"))
    return g.select("line_no", F.round(tx.coverage(F.col("tg"), F.col("og")), 6).alias("overlap8"), ((F.length("t") > 0) & F.contains("o", "t")).alias("verbatim"))


def m1_cell(spark: SparkSession, d: str) -> DataFrame:
    last = ledger.last_wins(table(spark, d, "m1_smoke"), ["i", "model", "seed"], "line_no")
    return cells.recall_cell(last, ["model"], F.col("raw").isNotNull(), F.col("verbatim_hit"), F.col("overlap8"))


def parse_letter(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return table(spark, d, "pilot").select("line_no", letters.parse_letter(F.col("raw"), mode).alias("letter"))


def letter_distribution(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pilot").select("probe_type", letters.parse_letter(F.col("raw"), "pilot").alias("letter"))
    n = t.groupBy("probe_type", "letter").agg(F.count("*").alias("n"))
    parsed = n.where("letter is not null").groupBy("probe_type").agg(F.sum("n").alias("parsed"), F.max_by("letter", F.struct(F.col("n"), -F.ascii("letter"))).alias("most_common"))
    return n.join(F.broadcast(parsed), "probe_type", "left").select("probe_type", "letter", "n", "most_common", F.when(F.col("letter").isNotNull(), F.round(F.col("n") / F.col("parsed"), 4)).alias("share"))


def qa_numbers(spark: SparkSession, d: str) -> DataFrame:
    nums = tx.numbers(F.concat_ws(" ", "soru", "cevap"))
    return table(spark, d, "heldout_items").select("item_id", F.array_join(nums, "|").alias("numbers"), F.size(nums).cast("bigint").alias("n_numbers"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.features(table(spark, d, "m1_smoke").select("line_no", "truth_text", "raw", "bolum", "verbatim_hit"), "truth_text", "raw", "bolum")


def qa_jaccard_cov(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("line_no", F.round("_m.jac", 6).alias("jaccard"), F.round("_m.cov", 6).alias("coverage"))


def qa_matcher(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    lev = _pairs(spark, d).select("line_no", matching.level(strict).alias("level"))
    return lev.withColumn("match", matching.is_match(F.col("level")))


def qa_legacy_containment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "m1_smoke").select("line_no", matching.legacy_match(F.col("truth_text"), F.col("raw")).alias("match"))


def robust_scores(spark: SparkSession, d: str) -> DataFrame:
    """All verdicts on an answer: strict match with level and similarity, lenient match, legacy containment."""
    rows = matching.features(table(spark, d, "m1_smoke").select("line_no", "truth_text", "raw", "bolum"), "truth_text", "raw", "bolum")
    rows = rows.withColumns({"level": matching.level(), "_loose": matching.level(False)})
    return rows.select(
        "line_no", matching.is_match(F.col("level")).alias("strict_match"), "level", F.round(matching.similarity(F.col("level")), 3).alias("sim"),
        matching.is_match(F.col("_loose")).alias("lenient_match"), matching.legacy_match(F.col("truth_text"), F.col("raw")).alias("legacy_match"),
    )


def qa_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Strict and lenient accuracy of each model over its answered calls, with the strict one's interval."""
    t = table(spark, d, "m1_smoke").where("raw is not null").select("model", "truth_text", "raw", "bolum")
    t = matching.features(t, "truth_text", "raw", "bolum").select("model", matching.is_match(matching.level()).alias("s"), matching.is_match(matching.level(False)).alias("l"))
    n = t.groupBy("model").agg(F.count("*").alias("n"), F.count_if("s").alias("strict"), F.count_if("l").alias("lenient"))
    lo, hi = stats.wilson(F.col("strict"), F.col("n"))
    share = lambda c: F.round(F.col(c) / F.col("n"), 4)
    return n.withColumns({"strict_acc": share("strict"), "lenient_acc": share("lenient"), "ci_lo": lo, "ci_hi": hi})


def matcher_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The strict matcher against the logged verbatim hits, by level as well."""
    t = _pairs(spark, d).select(F.coalesce("verbatim_hit", F.lit(False)).alias("label"), matching.level().alias("level"))
    t = t.withColumn("m", matching.is_match(F.col("level")))
    c = t.agg(
        F.count_if(F.col("m") & F.col("label")).alias("tp"), F.count_if(F.col("m") & ~F.col("label")).alias("fp"),
        F.count_if(~F.col("m") & ~F.col("label")).alias("tn"), F.count_if(~F.col("m") & F.col("label")).alias("fn"),
    )
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "accuracy": rate(tp + tn, tp + fp + tn + fn)})


def matcher_levels(spark: SparkSession, d: str) -> DataFrame:
    lev = _pairs(spark, d).select(matching.level().alias("level"))
    return lev.groupBy("level").agg(F.count("*").alias("total"), F.count_if(matching.is_match(F.col("level"))).alias("matches"))


def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "m1_smoke").groupBy("model").agg(F.count_if("verbatim_hit").alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return n.select("model", "k", "n", lo.alias("lo"), hi.alias("hi"))


QUERIES = {
    "m1_overlap8": m1_overlap8, "m1_cell": m1_cell, "letter_distribution": letter_distribution, "qa_numbers": qa_numbers,
    "qa_jaccard_cov": qa_jaccard_cov, "qa_matcher_strict": partial(qa_matcher, strict=True), "qa_matcher_lenient": partial(qa_matcher, strict=False),
    "qa_legacy_containment": qa_legacy_containment, "robust_scores": robust_scores, "qa_accuracy": qa_accuracy, "matcher_confusion": matcher_confusion, "matcher_levels": matcher_levels, "wilson_ci": wilson_ci,
} | {f"parse_letter_{m}": partial(parse_letter, mode=m) for m in letters.MODES}

_LOWER = "lower(replace({}, 'İ', 'i' || chr(775)))"
_WS = "[\\s\\p{Z}\\x1c-\\x1f\\x85\\x0b]+"
_COLL = "trim(regexp_replace(" + _LOWER + ", '" + _WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
_CG = "case when length({0}) >= {1} then list_distinct(list_transform(range(1, length({0}) - {1} + 2), lambda i: {0}[i:i + {1} - 1])) else [] end"
_LO, _HI = stats.wilson_sql("verbatim_hits", "n")
_KLO, _KHI = stats.wilson_sql("k", "n")
_NORM = (
    "trim(regexp_replace(regexp_replace(trim(regexp_replace("
    + _LOWER.format("regexp_replace(nfc_normalize(coalesce({}, '')), '[*#_`>]', ' ', 'g')")
    + ", '" + _WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s.,:°/%-]', ' ', 'g'), '" + _WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
)
_STOP = "[" + ", ".join(f"'{w}'" for w in matching.STOP) + "]"
_FEATURES = f"""
with n0 as (select line_no, coalesce(verbatim_hit, false) as label, {_NORM.format("truth_text")} as g, {_NORM.format("raw")} as p, {_NORM.format("bolum")} as q from m1_smoke),
n1 as (select *, replace(g, ' ', '') as gd, replace(p, ' ', '') as pd, replace(q, ' ', '') as qd,
  list_distinct(string_split(g, ' ')) as gt, list_distinct(string_split(p, ' ')) as pt, string_split(q, ' ') as qt,
  regexp_extract_all(g, '\\d+(?:[.,]\\d+)*') as gn, regexp_extract_all(p, '\\d+(?:[.,]\\d+)*') as pn,
  nullif(regexp_extract(g, '(\\d+)ler', 1), '') as decade from n0),
n2 as (select *, {_CG.format("gd", 5)} as gg, {_CG.format("pd", 5)} as pg, {_CG.format("qd", 5)} as qg,
  list_filter(string_split(g, ' '), lambda t: length(t) >= 4 and not list_contains({_STOP}, t) and not list_contains(qt, t)) as dt from n1),
n3 as (select *, list_filter(gg, lambda x: not list_contains(qg, x)) as dist from n2),
f as (select *, case when g <> '' and p <> '' then len(list_intersect(gt, pt))::double / len(list_distinct(list_concat(gt, pt))) else 0.0 end as jac,
  case when len(gg) > 0 then len(list_intersect(gg, pg))::double / len(gg) else 0.0 end as cov,
  case when len(dist) > 0 then len(list_intersect(dist, pg))::double / len(dist) else 0.0 end as dcov,
  len(dist) as n_dist, len(dt) as n_words, len(list_filter(dt, lambda t: list_contains(pt, t))) as n_kept,
  len(gn) > 0 as numeric_gold,
  len(list_filter(gn, lambda t: case when decade is not null and t = decade
    then len(list_filter(pn, lambda x: coalesce(try_cast(regexp_replace(x, '[.,].*', '') as hugeint) between try_cast(decade as hugeint) and try_cast(decade as hugeint) + 9, false))) = 0
    else not list_contains(pn, t) end)) > 0 as missing from n3)
"""
_BASE = """case when g = '' or p = '' then 'empty'
  when regexp_matches(g, '^[a-e][).:].*$') then case when regexp_matches(p, '^[a-e][).:]') or g = p then 'letter' else 'letter-mismatch' end
  when g = p then 'exact' when numeric_gold and missing then 'number-mismatch'
  when length(g) >= 8 and contains(p, g) then case when length(g)::double / length(p) >= 0.25 then 'containment' else 'containment-thin' end
  when length(p) >= 8 and contains(g, p) then case when length(p)::double / length(g) >= 0.25 then 'containment' else 'containment-thin' end"""
_STRICT = (
    _BASE
    + """ when length(g) > 120 and not numeric_gold and dcov >= 0.50 and jac >= 0.30 then 'paraphrase-distinctive'
  when (case when numeric_gold then jac >= 0.55 or cov >= 0.65 else jac >= 0.65 or cov >= 0.80 end) and (n_dist = 0 or dcov >= 0.50)
   and (case when n_words <= 4 then n_kept = n_words else n_kept::double / n_words >= 0.5 end) then 'paraphrase' else 'none' end"""
)
_LENIENT = (
    _BASE
    + """ when length(g) > 120 and not numeric_gold and (dcov >= 0.50 or jac >= 0.60) then 'paraphrase-distinctive'
  when (case when numeric_gold then jac >= 0.50 or cov >= 0.60 else jac >= 0.60 or cov >= 0.75 end) then 'paraphrase' else 'none' end"""
)
_MATCHES = "('letter', 'exact', 'containment', 'paraphrase-distinctive', 'paraphrase')"
_IS = "level in ('letter', 'exact', 'containment', 'paraphrase-distinctive', 'paraphrase')"
_LEG = "regexp_replace(regexp_replace(" + _LOWER.format("coalesce({}, '')") + ", '" + _WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'), '^[ .,;:!?\"'']+|[ .,;:!?\"'']+$', '', 'g')"
SQL = {
    "m1_overlap8": f"""with n as (select line_no, {_COLL.format("coalesce(truth_text, '')")} as t, {_COLL.format("coalesce(raw, '')")} as o from m1_smoke),
      g as (select *, {_CG.format("t", 8)} as tg, {_CG.format("o", 8)} as og from n)
      select line_no, case when len(tg) > 0 then round(len(list_intersect(tg, og))::double / len(tg), 6) else 0.0 end as overlap8,
      t <> '' and contains(o, t) as verbatim from g""",
    "m1_cell": f"""with l as (select * from m1_smoke qualify row_number() over (partition by i, model, seed order by line_no desc) = 1),
      c as (select model, count(*) as n, count(*) filter (where coalesce(verbatim_hit, false)) as verbatim_hits,
        round(avg(coalesce(overlap8, 0)), 4) as mean_overlap8, round(stddev_pop(coalesce(overlap8, 0)), 4) as overlap8_sd from l where raw is not null group by model)
      select model, n, verbatim_hits, round(verbatim_hits::double / n, 4) as verbatim_rate, {_LO} as ci_lo, {_HI} as ci_hi, mean_overlap8, overlap8_sd from c""",
    "letter_distribution": f"""with t as (select probe_type, {letters.parse_letter_sql("raw", "pilot")} as letter from pilot),
      n as (select probe_type, letter, count(*) as n from t group by all),
      p as (select probe_type, sum(n) as parsed, arg_max(letter, n * 1000 - ascii(letter)) as most_common from n where letter is not null group by probe_type)
      select n.probe_type, letter, n, most_common, case when letter is not null then round(n::double / parsed, 4) end as share from n left join p on p.probe_type = n.probe_type""",
    "qa_numbers": """with t as (select item_id, regexp_extract_all(concat_ws(' ', soru, cevap), '\\d+(?:[.,]\\d+)*') as x from heldout_items)
      select item_id, array_to_string(x, '|') as numbers, len(x) as n_numbers from t""",
    "qa_jaccard_cov": _FEATURES + "select line_no, round(jac, 6) as jaccard, round(cov, 6) as coverage from f",
    "qa_matcher_strict": _FEATURES + f", l as (select line_no, {_STRICT} as level from f) select line_no, level, {_IS} as match from l",
    "qa_matcher_lenient": _FEATURES + f", l as (select line_no, {_LENIENT} as level from f) select line_no, level, {_IS} as match from l",
    "qa_legacy_containment": f"""with n as (select line_no, {_LEG.format("truth_text")} as g, {_LEG.format("raw")} as p from m1_smoke)
      select line_no, g <> '' and p <> '' and (contains(p, g) or contains(g, p)) as match from n""",
    "robust_scores": _FEATURES
    + f""", s as (select *, {_STRICT} as level, {_LENIENT} as loose from f),
      g as (select line_no, {_LEG.format("truth_text")} as lg, {_LEG.format("raw")} as lp from m1_smoke)
      select s.line_no, level in {_MATCHES} as strict_match, level, round(case when level in ('letter', 'exact', 'containment') then 1.0
        when level in ('empty', 'letter-mismatch', 'number-mismatch', 'containment-thin') then 0.0 when level = 'paraphrase-distinctive' then dcov else greatest(jac, cov) end, 3) as sim,
        loose in {_MATCHES} as lenient_match, lg <> '' and lp <> '' and (contains(lp, lg) or contains(lg, lp)) as legacy_match from s join g on g.line_no = s.line_no""",
    "qa_accuracy": _FEATURES
    + f""", s as (select m.model, {_STRICT} as a, {_LENIENT} as b from f join m1_smoke m on m.line_no = f.line_no where m.raw is not null),
      c as (select model, count(*) as n, count(*) filter (where a in {_MATCHES}) as strict, count(*) filter (where b in {_MATCHES}) as lenient from s group by model)
      select *, round(strict::double / n, 4) as strict_acc, round(lenient::double / n, 4) as lenient_acc, {stats.wilson_sql("strict", "n")[0]} as ci_lo, {stats.wilson_sql("strict", "n")[1]} as ci_hi from c""",
    "matcher_confusion": _FEATURES
    + f""", l as (select label, {_STRICT} as level from f), m as (select label, {_IS} as m from l),
      c as (select count(*) filter (where m and label) as tp, count(*) filter (where m and not label) as fp,
        count(*) filter (where not m and not label) as tn, count(*) filter (where not m and label) as fn from m)
      select *, round(tp::double / nullif(tp + fp, 0), 4) as precision, round(tp::double / nullif(tp + fn, 0), 4) as recall,
      round((tp + tn)::double / nullif(tp + fp + tn + fn, 0), 4) as accuracy from c""",
    "matcher_levels": _FEATURES + f", l as (select {_STRICT} as level from f) select level, count(*) as total, count(*) filter (where {_IS}) as matches from l group by level",
    "wilson_ci": f"""with c as (select model, count(*) filter (where verbatim_hit) as k, count(*) as n from m1_smoke group by model)
      select model, k, n, {_KLO} as lo, {_KHI} as hi from c""",
} | {f"parse_letter_{m}": f"select line_no, {letters.parse_letter_sql('raw', m)} as letter from pilot" for m in letters.MODES}
