"""Exact word n-gram overlap of benchmark items with a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.functions import text as tx
from leakgauge.operators.prefix import running_total
from leakgauge.session import spread

NGRAM = 13
#: Test keys up to this number (some 40 MB as a hash table) may be broadcast.
BROADCAST_KEYS = 1_000_000


def item_grams(items: DataFrame, key: str, text: str, n: int = NGRAM) -> DataFrame:
    """Distinct ``key, gram`` of each item."""
    t = items.select(key, tx.word_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    return t.select(key, F.explode(F.array_distinct(tx.gram_keys(F.col("_t"), n))).alias("gram"))


def corpus_hits(corpus: DataFrame, text: str, grams: DataFrame, n: int = NGRAM, keep: tuple[str, ...] = (), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Distinct ``gram`` (with the ``keep`` columns) of the corpus that are in ``grams``.

    The test side is the small one, so the corpus streams past its keys and only
    matches are shuffled. Its size is counted first; beyond the bound the same join
    runs by shuffle.
    """
    wanted = grams.select("gram").distinct()
    side = F.broadcast(wanted) if wanted.limit(broadcast_keys + 1).count() <= broadcast_keys else wanted
    rows = spread(corpus.where(F.length(text) > 0).select(*keep, text))
    # No filter on the number of words: pushed down, it would tokenise every text twice.
    tokens = rows.select(*keep, tx.word_tokens(F.col(text)).alias("_t"))
    keys = tokens.select(*keep, F.explode(F.array_distinct(tx.gram_keys(F.col("_t"), n))).alias("gram"))
    return keys.join(side, "gram", "left_semi").distinct()


def overlap_by_item(items: DataFrame, key: str, text: str, corpus: DataFrame, corpus_text: str, n: int = NGRAM) -> DataFrame:
    """``key, grams, matched, hit`` of every item; items without a gram stay, with zeros."""
    own = item_grams(items, key, text, n)
    found = corpus_hits(corpus, corpus_text, own, n).withColumn("in_corpus", F.lit(1))
    counts = own.join(found, "gram", "left").groupBy(key).agg(F.count("*").alias("grams"), F.count("in_corpus").alias("matched"))
    out = items.select(key).join(counts, key, "left").na.fill(0, ["grams", "matched"])
    return out.withColumn("hit", F.col("matched") > 0)


def corpus_meta(corpus: DataFrame, text: str, n: int = NGRAM) -> DataFrame:
    """One row: documents, characters, blank ones skipped, grams."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = ~t.rlike(r"[^\s\p{Z}]")
    rows = corpus.select(blank.alias("blank"), F.length(t).alias("chars"), F.when(~blank, tx.n_grams(tx.word_tokens(t), n)).otherwise(0).alias("grams"))
    return rows.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum(F.when(~F.col("blank"), F.col("chars"))), F.lit(0)).cast("bigint").alias("chars"),
        F.count_if("blank").alias("empty_skipped"),
        F.coalesce(F.sum("grams"), F.lit(0)).cast("bigint").alias("grams"),
    )


def capped_keys(corpus: DataFrame, key: str, text: str, cap: int, n: int = NGRAM) -> DataFrame:
    """Distinct ``gram`` keys among the first ``cap`` grams of the corpus, in key order."""
    kept = capped_grams(corpus, key, text, cap, n).where("kept > 0").select(key, "kept")
    rows = corpus.select(key, text).join(kept, key)
    keys = rows.select(F.explode(F.slice(tx.gram_keys(tx.word_tokens(F.col(text)), n), F.lit(1), F.col("kept").cast("int"))).alias("gram"))
    return keys.distinct()


def _reach(corpus: DataFrame, key: str, text: str, cap: int, n: int, first: int = 4_096) -> int | None:
    """A key below which the corpus has ``cap`` grams, or None. Ranges grow fourfold, so little is read twice."""
    low, high = corpus.agg(F.min(key), F.max(key)).first()
    span = first
    while low is not None and low + span <= high:
        grams = corpus.where(F.col(key) < low + span).agg(F.sum(tx.n_grams(tx.word_tokens(F.coalesce(F.col(text), F.lit(""))), n))).first()[0]
        if (grams or 0) >= cap:
            return low + span
        span *= 4
    return None


def capped_grams(corpus: DataFrame, key: str, text: str, cap: int, n: int = NGRAM) -> DataFrame:
    """How many grams of each document the first ``cap`` of the corpus, in key order, take.

    Only the documents up to the one that reaches the cap are read as words.
    """
    end = _reach(corpus, key, text, cap, n)
    corpus = corpus if end is None else corpus.where(F.col(key) < end)
    t = tx.word_tokens(F.coalesce(F.col(text), F.lit("")))
    counts = corpus.select(key, tx.n_grams(t, n).cast("bigint").alias("grams"))
    run = running_total(counts, key, F.col("grams"), "_upto")
    before = F.col("_upto") - F.col("grams")
    return run.where(before < cap).select(key, "grams", F.least(F.col("grams"), cap - before).cast("bigint").alias("kept"))
