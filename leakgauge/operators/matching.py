"""Guarded matching of a gold answer with a prediction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakgauge.functions import text as tx
from leakgauge.session import spread

# Words that carry no content.
STOP = ("bir", "ve", "ile", "için", "daha", "sonra", "kendi", "olarak", "göre", "ancak", "ayrıca", "bu", "şu", "o", "ne", "hangi", "nasıl", "neden", "ilk", "kez", "ise", "da", "de", "mı", "mi", "mu", "mü", "ki", "ya", "en")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in "gpq"]))
def composed(g: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
    """NFC of three texts, which Spark has no function for; null counts as empty."""
    one = lambda x: "" if x is None else x if x.isascii() else unicodedata.normalize("NFC", x)
    return pd.DataFrame({"g": g.map(one), "p": p.map(one), "q": q.map(one)})


def features(df: DataFrame, gold: str, pred: str, question: str | None = None) -> DataFrame:
    """Everything the cascade reads, each computed once, in the struct ``_m``; other columns stay.

    Null texts count as empty ones.
    """
    q = F.col(question) if question else F.lit("")
    texts = spread(df).withColumn("_c", composed(F.col(gold), F.col(pred), q.cast("string")))
    texts = texts.withColumns({f"_{c}": tx.qa_normal(F.col(f"_c.{c}")) for c in "gpq"}).drop("_c")
    g, p, qn = F.col("_g"), F.col("_p"), F.col("_q")
    dense = lambda c: tx.char_grams(F.regexp_replace(c, " ", ""), 5)
    step = texts.withColumn("_gg", dense(g)).withColumn("_pg", dense(p)).withColumn("_qg", dense(qn))
    step = step.withColumn("_gt", F.split(g, " ")).withColumn("_pt", F.array_distinct(F.split(p, " "))).withColumn("_qt", F.split(qn, " "))
    step = step.withColumn("_gn", tx.numbers(g)).withColumn("_pn", tx.numbers(p)).withColumn("_dist", F.array_except("_gg", "_qg"))
    stop = F.array(*[F.lit(w) for w in STOP])
    words = F.filter("_gt", lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t) & ~F.array_contains(F.col("_qt"), t))
    step = step.withColumn("_dt", words)
    m = F.struct(
        g.alias("g"), p.alias("p"), F.col("_gn").alias("gn"), F.col("_pn").alias("pn"),
        F.when((F.length(g) > 0) & (F.length(p) > 0), tx.jaccard(F.array_distinct("_gt"), F.col("_pt"))).otherwise(F.lit(0.0)).alias("jac"),
        tx.coverage(F.col("_gg"), F.col("_pg")).alias("cov"),
        F.size("_dist").alias("n_dist"), tx.coverage(F.col("_dist"), F.col("_pg")).alias("dcov"),
        F.size("_dt").alias("n_words"), F.size(F.filter("_dt", lambda t: F.array_contains(F.col("_pt"), t))).alias("n_kept"),
        F.nullif(F.regexp_extract(g, r"(\d+)ler", 1), F.lit("")).alias("decade"),
    )
    return step.withColumn("_m", m).drop("_g", "_p", "_q", "_gg", "_pg", "_qg", "_gt", "_pt", "_qt", "_gn", "_pn", "_dist", "_dt")


def level(strict: bool = True) -> Column:
    """Level of the cascade over the struct ``_m``.

    Order: empty, letter form, equal, number guard, containment (too thin a one
    stops), paraphrase by word and gram overlap. The letters of letter forms are
    not compared. The decade rule takes the first number that ends in ``ler``.
    """
    m = lambda c: F.col(f"_m.{c}")
    g, p, jac, cov, dcov = m("g"), m("p"), m("jac"), m("cov"), m("dcov")
    numeric = F.size(m("gn")) > 0
    in_decade = F.exists(m("pn"), lambda x: F.expr("1 = 1") & F.try_to_number(F.regexp_replace(x, r"[.,].*", ""), F.lit("99999999999999999999")).between(m("decade").cast("decimal(20,0)"), m("decade").cast("decimal(20,0)") + 9))
    missing = F.exists(m("gn"), lambda t: F.when(m("decade").isNotNull() & (t == m("decade")), ~in_decade).otherwise(~F.array_contains(m("pn"), t)))
    pred_letter = p.rlike(r"^[a-e][).:]")
    base = (
        F.when((F.length(g) == 0) | (F.length(p) == 0), "empty")
        .when(g.rlike(r"^[a-e][).:].*$"), F.when(pred_letter | (g == p), "letter").otherwise("letter-mismatch"))
        .when(g == p, "exact")
        .when(numeric & missing, "number-mismatch")
        .when((F.length(g) >= 8) & F.contains(p, g), F.when(F.length(g) / F.length(p) >= 0.25, "containment").otherwise("containment-thin"))
        .when((F.length(p) >= 8) & F.contains(g, p), F.when(F.length(p) / F.length(g) >= 0.25, "containment").otherwise("containment-thin"))
    )
    long = (F.length(g) > 120) & ~numeric
    if not strict:
        enough = F.when(numeric, (jac >= 0.50) | (cov >= 0.60)).otherwise((jac >= 0.60) | (cov >= 0.75))
        return base.when(long & ((dcov >= 0.50) | (jac >= 0.60)), "paraphrase-distinctive").when(enough, "paraphrase").otherwise("none")
    enough = F.when(numeric, (jac >= 0.55) | (cov >= 0.65)).otherwise((jac >= 0.65) | (cov >= 0.80))
    kept = F.when(m("n_words") <= 4, m("n_kept") == m("n_words")).otherwise(m("n_kept") / m("n_words") >= 0.5)
    return base.when(long & (dcov >= 0.50) & (jac >= 0.30), "paraphrase-distinctive").when(enough & ((m("n_dist") == 0) | (dcov >= 0.50)) & kept, "paraphrase").otherwise("none")


MATCHES = ("letter", "exact", "containment", "paraphrase-distinctive", "paraphrase")


def is_match(level_: Column) -> Column:
    return level_.isin(*MATCHES)


def similarity(level_: Column) -> Column:
    """How alike the texts are, by the level that the cascade ends with over the struct ``_m``."""
    sure = F.when(level_.isin("letter", "exact", "containment"), 1.0).when(level_.isin("empty", "letter-mismatch", "number-mismatch", "containment-thin"), 0.0)
    return sure.when(level_ == "paraphrase-distinctive", F.col("_m.dcov")).otherwise(F.greatest("_m.jac", "_m.cov"))


def legacy_match(gold: Column, pred: Column) -> Column:
    """Equal or either contains the other after a light clean-up; false where one is empty."""
    g, p = tx.legacy_normal(F.coalesce(gold, F.lit(""))), tx.legacy_normal(F.coalesce(pred, F.lit("")))
    return (F.length(g) > 0) & (F.length(p) > 0) & (F.contains(p, g) | F.contains(g, p))
