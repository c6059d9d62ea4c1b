"""Benchmark items: surface texts, normal forms, planted distractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakgauge.functions.text import letter_of
from leakgauge.operators.prefix import running_total


# The wording of prompts, which logged answers refer to.
QUESTION, OPTIONS = "Soru: ", "\n\nSecenekler:\n"
RECALL_ANSWER = "\n\nBu sorunun doğru cevabını, kaynak metindeki haliyle AYNEN (birebir) yazın. Sadece cevap metnini verin:"
RECALL_CHOICE = "\n\nCevap (ONLY the letter of the correct choice, e.g. A) followed by the FULL EXACT text of that choice, reproduced verbatim as it appears above:"
WHICH, ANSWER = "\n\nHangisi doğru cevaptır?\nA) ", "\n\nCevap (tek harf A/B):"


def surface_text(question: Column, body: Column) -> Column:
    """Question, a blank, then the answer or the choices; trimmed."""
    q, b = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    return F.trim(F.concat(q, F.lit(" "), b))


def choices_body(choices: Column) -> Column:
    """Choices that aren't blank, trimmed, joined by blanks."""
    return F.array_join(F.filter(F.transform(choices, lambda c: F.trim(c)), lambda c: F.length(c) > 0), " ")


def exam_text(question: Column, choices: Column) -> Column:
    """The question with its lettered options, a line each."""
    lines = F.transform(choices, lambda c, i: F.concat(letter_of(i), F.lit(") "), c))
    return F.concat(F.lit(QUESTION), question, F.lit(OPTIONS), F.array_join(lines, "\n"))


def recall_text(question: Column, choices: Column | None = None) -> Column:
    """A prompt that asks for the answer's exact text, of the lettered options where there are some."""
    return F.concat(F.lit(QUESTION), question, F.lit(RECALL_ANSWER)) if choices is None else F.concat(exam_text(question, choices), F.lit(RECALL_CHOICE))


def normal_answer(answer: Column, n_choices: Column) -> tuple[Column, Column]:
    """Letter (trimmed, upper case) and its index; the index is null out of range."""
    letter = F.nullif(F.upper(F.trim(answer)), F.lit(""))
    idx = F.when(F.length(letter) == 1, F.ascii(letter) - 65)
    return letter, F.when((idx >= 0) & (idx < n_choices), idx)


def true_index(stored: Column, letter: Column, n_choices: Column) -> Column:
    """The stored index where it is within the choices, else the letter's among A to E, else null."""
    read = F.upper(F.trim(letter))
    return F.when((stored >= 0) & (stored < n_choices), stored).when(read.rlike("^[A-E]$"), F.ascii(read) - 65)


def index_letter(idx: Column, n_choices: Column) -> Column:
    """Letter of an index, a question mark where it is out of range."""
    return F.when((idx >= 0) & (idx < n_choices), letter_of(idx)).otherwise("?")


def next_answer(df: DataFrame, benchmark: str, order: str, answer: str, out: str = "planted") -> DataFrame:
    """``df`` with the answer of the next item, the last item taking the first one's.

    One benchmark is one window partition: it is a test set, small by nature. For
    tables without such a bound there is ``following``.
    """
    w = Window.partitionBy(benchmark).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(w) == F.count("*").over(whole)
    return df.withColumn(out, F.when(last, F.first(answer).over(whole)).otherwise(F.lead(answer).over(w)))


def following(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the value of the next row by ``order`` (a bigint, unique), the last row taking the first one's.

    Places come from a prefix sum and rows meet their neighbours in a hash join, so
    no task sees the whole order.
    """
    placed = running_total(df, order, F.lit(1), "_place")
    n = df.count()
    before = F.when(F.col("_place") == 1, F.lit(n)).otherwise(F.col("_place") - 1)
    return placed.join(placed.select(before.alias("_place"), F.col(value).alias(out)), "_place").drop("_place")


def plant(choices: Column, correct: Column, other: Column) -> tuple[Column, Column]:
    """Choices with the first wrong one replaced, and the letter it got; nulls where degenerate."""
    k = F.array_position(F.transform(choices, lambda c: c != correct), F.lit(True)) - 1
    good = (k >= 0) & (other != correct)
    return (
        F.when(good, F.transform(choices, lambda c, i: F.when(i == k, other).otherwise(c))),
        F.when(good, letter_of(k.cast("int"))),
    )


def flip_prompt(question: Column, truth: Column, edited: Column, truth_first: Column) -> Column:
    """Two-way prompt of true and edited answer; null where one is blank or both are equal."""
    t, e = F.trim(truth), F.trim(edited)
    a, b = F.when(truth_first, t).otherwise(e), F.when(truth_first, e).otherwise(t)
    text = F.concat(F.lit(QUESTION), question, F.lit(WHICH), a, F.lit("\nB) "), b, F.lit(ANSWER))
    return F.when((F.length(t) > 0) & (F.length(e) > 0) & (t != e), text)
