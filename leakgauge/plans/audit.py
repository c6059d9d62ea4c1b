"""Paired arms, exact tests, families, consensus and the older analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakgauge.functions import letters, stats
from leakgauge.functions.text import letter_of
from leakgauge.operators import cells, ledger
from leakgauge.plans.scoring import m1_cell
from leakgauge.session import table


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """``i, truth`` of every exam item whose index is known, the last line winning."""
    t = table(spark, d, "smoke_backtrans_bc").where("truth_idx is not null").select("i", "line_no", "truth_idx")
    return ledger.last_wins(t, ["i"], "line_no").select("i", letter_of(F.col("truth_idx")).alias("truth"))


#: Options of a prompt as it was sent, a line each.
_SENT_OPTIONS = r"(?m)^[A-E]\) (.*)$"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """``i, subject, model, probe_type, ok, letter, truth, right, planted`` of the last line of each task.

    ``right`` is null where no letter can be read. ``planted`` is the letter of the
    first option of the prompt that isn't the true one's text; the texts are hashed
    before the shuffle, prompts stay where they are.
    """
    t = table(spark, d, "pilot").select(
        "i", "subject", "model", "probe_type", "line_no", F.col("raw").isNotNull().alias("ok"), letters.parse_letter(F.col("raw"), "pilot").alias("letter"),
        F.transform(F.regexp_extract_all("prompt", F.lit(_SENT_OPTIONS), F.lit(1)), lambda o: F.xxhash64(o)).alias("sent"),
    )
    last = ledger.last_wins(t, ["i", "model", "probe_type"], "line_no").join(_truth(spark, d), "i")
    own = F.get("sent", F.ascii("truth") - 65)
    at = F.array_position(F.transform("sent", lambda o: o != own), F.lit(True))
    return last.withColumns({"right": F.col("letter") == F.col("truth"), "planted": F.when(at > 0, letter_of((at - 1).cast("int")))}).drop("sent", "line_no")


def flip_calls(spark: SparkSession, d: str) -> DataFrame:
    """Each substituted call: whether it gives the true letter, and whether the planted one."""
    t = _answers(spark, d).where("probe_type = 'choice_sub' and planted is not null")
    says = lambda c: F.coalesce(F.col("letter") == F.col(c), F.lit(False))
    return t.select("i", "model", "ok", "letter", F.col("truth").alias("truth_letter"), F.col("planted").alias("planted_letter"), says("truth").alias("answer_correct"), says("planted").alias("flip_follow"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """One row for each model and item: the plain call and the substituted one, by one aggregate."""
    t = _answers(spark, d)
    base, sub = F.col("probe_type") == "blackbox", (F.col("probe_type") == "choice_sub") & F.col("planted").isNotNull()
    flag = lambda which, c: F.coalesce(F.bool_or(which & F.coalesce(c, F.lit(False))), F.lit(False))
    return t.groupBy("model", "i").agg(
        flag(base, F.col("ok")).alias("base_ok"), flag(base, F.col("right")).alias("base_correct"), F.bool_or(F.when(base, F.col("right"))).alias("A"),
        flag(sub, F.col("ok")).alias("sub_ok"), flag(sub, F.col("right")).alias("sub_correct"), flag(sub, F.col("letter") == F.col("planted")).alias("follows"),
    )


def _flip_aggs() -> list:
    return cells.flip_aggs(*[F.col(c) for c in ("sub_ok", "follows", "sub_correct", "base_ok", "base_correct")])


def m2a_cell(spark: SparkSession, d: str) -> DataFrame:
    """Share of substituted calls that follow the planted letter; the plain calls against them, exact p."""
    return cells.flip_columns(_wide(spark, d).groupBy("model").agg(*_flip_aggs()))


def _bc(spark: SparkSession, d: str) -> DataFrame:
    """``i, B, C``: right answers of the back-translated and English arms."""
    t = table(spark, d, "smoke_backtrans_bc").select("i", "line_no", "b_answer", "c_answer")
    right = lambda c: letters.parse_letter(F.col(c), "backtrans") == F.col("truth")
    return ledger.last_wins(t, ["i"], "line_no").join(_truth(spark, d), "i").select("i", right("b_answer").alias("B"), right("c_answer").alias("C"))


def _arms(spark: SparkSession, d: str) -> DataFrame:
    """``model, i, A, B, C``: right answers of the plain, back-translated and English arms."""
    a = _answers(spark, d).where("probe_type = 'blackbox'").select("model", "i", F.col("right").alias("A"))
    return a.join(_bc(spark, d), "i")


def m2b_cell(spark: SparkSession, d: str) -> DataFrame:
    return cells.matched_arms(_arms(spark, d), ["model"], ["A", "B", "C"])


def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact p of black box against substituted choices for each subject."""
    wide = cells.arms_wide(_answers(spark, d).where("subject is not null"), ["subject"], ["i", "model"], "probe_type", ["blackbox", "choice_sub"], "right")
    return cells.discordant(wide, ["subject"], "blackbox", "choice_sub").select("subject", "pos", "neg", F.round("p_raw", 4).alias("p"))


TESTS = ("B_vs_A", "C_vs_A", "C_vs_B")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Flip and arm cells of each model in one row, from one pass over the answers."""
    both = _wide(spark, d).join(_bc(spark, d), "i", "left")
    got = cells.matched_columns(cells.flip_columns(both.groupBy("model").agg(*_flip_aggs(), *cells.matched_aggs(["A", "B", "C"]))), ["A", "B", "C"])
    return got.select("model", F.col("flip_follow_rate").alias("flip_rate"), F.col("p_raw").alias("flip_p"), F.col("B_acc").alias("b_acc"), F.col("C_acc").alias("c_acc"), *[f"{t}_p" for t in TESTS])


def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    each = [F.struct(F.lit("M2a").alias("probe"), F.lit("flip").alias("test"), F.col("flip_p").alias("p_raw"))]
    each += [F.struct(F.lit("M2b").alias("probe"), F.lit(t).alias("test"), F.col(f"{t}_p").alias("p_raw")) for t in TESTS]
    long = _cells(spark, d).select("model", F.inline(F.array(*each))).where("p_raw is not null")
    return cells.corrected(long, ["probe"])


def consensus_dual(spark: SparkSession, d: str) -> DataFrame:
    """Cells by model: both readings of the rule and the adjudication."""
    m1 = m1_cell(spark, d).select("model", "mean_overlap8", "verbatim_rate")
    both = _cells(spark, d).join(m1, "model", "full")
    # A family is all tests of a probe over the models; there are as many rows as models.
    every = Window.partitionBy(F.lit(1))
    both = both.withColumns({"n_a": F.count("flip_p").over(every), "n_b": sum((F.count(f"{t}_p").over(every) for t in TESTS), F.lit(0))})
    ps = [stats.bonferroni(F.col("flip_p"), F.col("n_a")), *[stats.bonferroni(F.col(f"{t}_p"), F.col("n_b")) for t in TESTS]]
    full = both.withColumn("min_p", F.array_min(F.array(*ps))).select("model", "flip_rate", "b_acc", "c_acc", "mean_overlap8", "verbatim_rate", "min_p")
    return cells.consensus(full)


def arm_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Two by two counts of the plain against each other arm."""
    t = _arms(spark, d).where("A is not null and B is not null and C is not null")
    b = t.groupBy(F.col("A").alias("a_right"), F.col("B").alias("x_right")).agg(F.count("*").alias("n")).withColumn("arm", F.lit("B"))
    c = t.groupBy(F.col("A").alias("a_right"), F.col("C").alias("x_right")).agg(F.count("*").alias("n")).withColumn("arm", F.lit("C"))
    return b.unionByName(c)


def arm_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Wide answers as one row per arm."""
    t = table(spark, d, "smoke_backtrans_bc").select("line_no", F.col("b_answer").alias("B"), F.col("c_answer").alias("C"))
    return t.unpivot("line_no", ["B", "C"], "arm", "answer")


def bb_cs_degradation(spark: SparkSession, d: str) -> DataFrame:
    """The six subjects that lose most right answers, ties by the least item."""
    wide = cells.arms_wide(_answers(spark, d).where("subject is not null"), ["subject"], ["i", "model"], "probe_type", ["blackbox", "choice_sub"], "right")
    lost = wide.where(F.col("blackbox") & ~F.coalesce("choice_sub", F.lit(False)))
    n = lost.groupBy("subject").agg(F.count("*").alias("lost"), F.min("i").alias("first_item"))
    return n.orderBy(F.desc("lost"), "first_item", "subject").limit(6)


def three_arm_first30(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the arms over the first thirty items that all have, in item order."""
    t = _arms(spark, d).groupBy("i").agg(F.max("A").alias("A"), F.max("B").alias("B"), F.max("C").alias("C"))
    first = t.orderBy("i").limit(30)
    return first.agg(*[F.count_if(c).alias(f"{c}_correct") for c in "ABC"], *[F.count(c).alias(f"{c}_parsed") for c in "ABC"])


def pilot_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Parsed, unparsed and right answers of each probe."""
    t = _answers(spark, d)
    n = t.groupBy("probe_type").agg(F.count("*").alias("total"), F.count("letter").alias("parsed"), F.count_if("right").alias("correct"))
    return n.withColumn("accuracy", F.when(F.col("parsed") > 0, F.round(F.col("correct") / F.col("parsed"), 4)))


def answer_states(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each probe that are ok, that say something, and whose letter can be read."""
    t = table(spark, d, "pilot").select("probe_type", "raw", letters.parse_letter(F.col("raw"), "pilot").alias("letter"))
    said = F.coalesce(F.length(F.regexp_replace("raw", r"\s+", "")) > 0, F.lit(False))
    return t.groupBy("probe_type").agg(F.count("*").alias("calls"), F.count("raw").alias("ok"), F.count_if(said).alias("answered"), F.count_if(said & F.col("letter").isNotNull()).alias("parsed"))


def degradation_examples(spark: SparkSession, d: str) -> DataFrame:
    """For each subject the three first items whose right answer the substitution took away."""
    t = _answers(spark, d).where("subject is not null")
    wide = cells.arms_wide(t, ["subject"], ["i", "model"], "probe_type", ["blackbox", "choice_sub"], "right")
    lost = wide.where(F.col("blackbox") & ~F.coalesce("choice_sub", F.lit(False))).groupBy("subject", "i").agg(F.count("*").alias("models"))
    n = F.row_number().over(Window.partitionBy("subject").orderBy("i"))  # a top-k that Spark folds before the shuffle
    return lost.withColumn("place", n).where("place <= 3").select("subject", "place", "i", "models")


def arm_deltas(spark: SparkSession, d: str) -> DataFrame:
    """By how much each further arm's accuracy differs from the plain one's."""
    return m2b_cell(spark, d).select("model", F.round(F.col("B_acc") - F.col("A_acc"), 4).alias("b_minus_a"), F.round(F.col("C_acc") - F.col("A_acc"), 4).alias("c_minus_a"))


def arm_flips(spark: SparkSession, d: str) -> DataFrame:
    """Items whose answer turns right or wrong from the plain arm to another."""
    t = _arms(spark, d).unpivot(["model", "i", "A"], ["B", "C"], "arm", "right").where("A <> right")
    return t.select("model", "i", "arm", F.when(F.col("A"), "lost").otherwise("gained").alias("turn"))


QUERIES = {
    f.__name__: f
    for f in (m2a_cell, flip_calls, m2b_cell, mcnemar_exact, bonferroni, consensus_dual, arm_crosstab, arm_unpivot, bb_cs_degradation, degradation_examples, arm_deltas, arm_flips, three_arm_first30, pilot_accuracy, answer_states)
}

_P, _BT = letters.parse_letter_sql("raw", "pilot"), letters.parse_letter_sql
_WITH = f"""
with truth as (select i, chr((65 + truth_idx)::int) as truth from smoke_backtrans_bc where truth_idx is not null qualify row_number() over (partition by i order by line_no desc) = 1),
last as (select * from pilot qualify row_number() over (partition by i, model, probe_type order by line_no desc) = 1),
ans as (select l.i, l.subject, l.raw, l.model, l.probe_type, {_P} as letter, {_P} = truth as "right" from last l join truth t on t.i = l.i),
bc0 as (select * from smoke_backtrans_bc qualify row_number() over (partition by i order by line_no desc) = 1),
bc as (select b.i, {_BT("b_answer", "backtrans")} = truth as B, {_BT("c_answer", "backtrans")} = truth as C from bc0 b join truth t on t.i = b.i),
arms as (select model, a.i, a."right" as A, B, C from ans a join bc on bc.i = a.i where probe_type = 'blackbox'),
sent as (select l.i, l.model, l.raw, t.truth, {_P} as letter, ascii(t.truth) - 64 as own, regexp_extract_all(prompt, '(?m)^[A-E]\\) (.*)$', 1) as opts
  from last l join truth t on t.i = l.i where probe_type = 'choice_sub'),
sub0 as (select *, list_position(list_transform(opts, lambda o: o <> opts[own]), true) as k from sent where own <= len(opts)),
sub as (select i, model, raw is not null as ok, letter, truth as truth_letter, chr((64 + k)::int) as planted_letter, coalesce(letter = truth, false) as answer_correct,
  coalesce(letter = chr((64 + k)::int), false) as flip_follow from sub0 where k > 0),
base as (select i, model, coalesce("right", false) as correct from ans where probe_type = 'blackbox' and raw is not null),
m2a0 as (select m.model, count(*) filter (where s.ok) as n_flip, count(*) filter (where s.ok and flip_follow) as flip_follows,
  count(*) filter (where s.ok and b.correct and not answer_correct) as pos, count(*) filter (where s.ok and not b.correct and answer_correct) as neg
  from (select distinct model from ans) m left join sub s on s.model = m.model left join base b on b.model = s.model and b.i = s.i group by m.model),
m2a as (select *, pos + neg as n_pairs, round({stats.mcnemar_sql("pos", "neg")}, 4) as p_raw, case when n_flip > 0 then round(flip_follows::double / n_flip, 4) end as flip_follow_rate,
  {stats.wilson_sql("flip_follows", "n_flip")[0]} as flip_lo, {stats.wilson_sql("flip_follows", "n_flip")[1]} as flip_hi from m2a0),
full3 as (select * from arms where A is not null and B is not null and C is not null),
m2b0 as (select model, count(*) as matched_n, count(*) filter (where A) as A_correct, count(*) filter (where B) as B_correct, count(*) filter (where C) as C_correct,
  count(*) filter (where A and not B) as B_vs_A_pos, count(*) filter (where not A and B) as B_vs_A_neg, count(*) filter (where A and not C) as C_vs_A_pos,
  count(*) filter (where not A and C) as C_vs_A_neg, count(*) filter (where B and not C) as C_vs_B_pos, count(*) filter (where not B and C) as C_vs_B_neg from full3 group by model),
m2b as (select *, {", ".join(f"round({a}_correct::double / matched_n, 4) as {a}_acc, {stats.wilson_sql(f'{a}_correct', 'matched_n')[0]} as {a}_lo, {stats.wilson_sql(f'{a}_correct', 'matched_n')[1]} as {a}_hi" for a in "ABC")},
  {", ".join(f"round({stats.mcnemar_sql(f'{t}_pos', f'{t}_neg')}, 4) as {t}_p" for t in ("B_vs_A", "C_vs_A", "C_vs_B"))} from m2b0),
pv as (select model, 'M2a' as probe, 'flip' as test, p_raw from m2a {" ".join(f"union all select model, 'M2b', '{t}', {t}_p from m2b" for t in ("B_vs_A", "C_vs_A", "C_vs_B"))}),
adj as (select *, count(*) over (partition by probe) as tests, round(least(1.0, p_raw * count(*) over (partition by probe)), 4) as p_bonf from pv)
"""
_M1 = """m1l as (select * from m1_smoke qualify row_number() over (partition by i, model, seed order by line_no desc) = 1),
m1 as (select model, round(avg(coalesce(overlap8, 0)), 4) as mean_overlap8, round(count(*) filter (where coalesce(verbatim_hit, false))::double / count(*), 4) as verbatim_rate from m1l where raw is not null group by model)"""
_SUBJ = """sw as (select subject, i, model, max("right") filter (where probe_type = 'blackbox') as x, max("right") filter (where probe_type = 'choice_sub') as y from ans where subject is not null group by subject, i, model)"""
SQL = {
    "m2a_cell": _WITH + "select * from m2a",
    "flip_calls": _WITH + "select * from sub",
    "m2b_cell": _WITH + "select * from m2b",
    "answer_states": f"""select probe_type, count(*) as calls, count(raw) as ok, count(*) filter (where regexp_replace(raw, '\\s+', '', 'g') <> '') as answered,
      count(*) filter (where regexp_replace(raw, '\\s+', '', 'g') <> '' and {_P} is not null) as parsed from pilot group by probe_type""",
    "degradation_examples": _WITH
    + """, sw as (select subject, i, model, max("right") filter (where probe_type = 'blackbox') as x, max("right") filter (where probe_type = 'choice_sub') as y from ans where subject is not null group by subject, i, model),
      g as (select subject, i, count(*) as models from sw where x and not coalesce(y, false) group by subject, i)
      select subject, row_number() over (partition by subject order by i) as place, i, models from g qualify place <= 3""",
    "arm_deltas": _WITH + "select model, round(B_acc - A_acc, 4) as b_minus_a, round(C_acc - A_acc, 4) as c_minus_a from m2b",
    "arm_flips": _WITH
    + """select model, i, 'B' as arm, case when A then 'lost' else 'gained' end as turn from arms where A <> B
      union all select model, i, 'C', case when A then 'lost' else 'gained' end from arms where A <> C""",
    "mcnemar_exact": _WITH
    + f""", {_SUBJ}, c as (select subject, count(*) filter (where x and not y) as pos, count(*) filter (where not x and y) as neg from sw where x is not null and y is not null group by subject)
      select subject, pos, neg, round({stats.mcnemar_sql("pos", "neg")}, 4) as p from c""",
    "bonferroni": _WITH + "select model, probe, test, p_raw, tests, p_bonf from adj",
    "consensus_dual": _WITH
    + f""", {_M1}, mp as (select model, min(p_bonf) as min_p from adj group by model),
      c as (select coalesce(a.model, b.model, m1.model) as model, flip_follow_rate as flip_rate, B_acc as b_acc, C_acc as c_acc, mean_overlap8, verbatim_rate
        from m2a a full join m2b b on a.model = b.model full join m1 on m1.model = coalesce(a.model, b.model)),
      x as (select c.*, min_p, coalesce(mean_overlap8, 0) > 0.5 and coalesce(verbatim_rate, 0) > 0.5 as ind_m1, coalesce(flip_rate, 0) > 0.5 as ind_m2a,
        coalesce(b_acc < c_acc - 0.10, false) as ind_m2b from c left join mp on mp.model = c.model),
      y as (select *, ind_m1::int + ind_m2a::int + ind_m2b::int >= 2 and coalesce(min_p, 1.0) < 0.05 as raw_flag, ind_m2a and ind_m2b and coalesce(min_p, 1.0) < 0.05 as discount_flag from x)
      select *, case when raw_flag and discount_flag then 'CONTAMINATED' when raw_flag then 'THRESHOLD-DEPENDENT (M1-sensitive)' else 'no significant contamination detected' end as adjudication from y""",
    "arm_crosstab": _WITH
    + "select A as a_right, B as x_right, count(*) as n, 'B' as arm from full3 group by A, B union all select A, C, count(*), 'C' from full3 group by A, C",
    "arm_unpivot": "select line_no, 'B' as arm, b_answer as answer from smoke_backtrans_bc union all select line_no, 'C', c_answer from smoke_backtrans_bc",
    "bb_cs_degradation": _WITH
    + f", {_SUBJ} select subject, count(*) as lost, min(i) as first_item from sw where x and not coalesce(y, false) group by subject order by lost desc, first_item, subject limit 6",
    "three_arm_first30": _WITH
    + """, f as (select i, max(A) as A, max(B) as B, max(C) as C from arms group by i order by i limit 30)
      select count(*) filter (where A) as A_correct, count(*) filter (where B) as B_correct, count(*) filter (where C) as C_correct, count(A) as A_parsed, count(B) as B_parsed, count(C) as C_parsed from f""",
    "pilot_accuracy": _WITH
    + """select probe_type, count(*) as total, count(letter) as parsed, count(*) filter (where "right") as correct,
      case when count(letter) > 0 then round(count(*) filter (where "right")::double / count(letter), 4) end as accuracy from ans group by probe_type""",
}
