"""Word 13-gram overlap of the held-out items with the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.functions import text as tx
from leakgauge.operators import overlap
from leakgauge.operators.items import surface_text
from leakgauge.session import table

#: Grams that the capped build takes; the feature's own parameter.
CAP = 50_000


def _items(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "heldout_items")
    return t.select("item_id", "bench", "qid", surface_text(F.col("soru"), F.col("cevap")).alias("text"))


def m3_overlap_by_item(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_by_item(_items(spark, d), "item_id", "text", table(spark, d, "documents"), "text")


def m3_overlap_summary(spark: SparkSession, d: str) -> DataFrame:
    by = m3_overlap_by_item(spark, d).join(_items(spark, d).select("item_id", "bench"), "item_id")
    got = by.groupBy("bench").agg(
        F.count("*").alias("n_items"), F.count_if("hit").alias("items_with_match"), F.sum("grams").alias("total_item_grams"), F.sum("matched").alias("matched_grams")
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return got.withColumns({"match_rate": rate("items_with_match", "n_items"), "grams_matched_rate": rate("matched_grams", "total_item_grams")})


def m3_dry_run_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _items(spark, d).select("bench", tx.word_tokens(F.col("text")).alias("t"))
    t = t.select("bench", F.size("t").alias("tokens"), tx.n_grams(F.col("t"), overlap.NGRAM).alias("grams"))
    return t.groupBy("bench").agg(
        F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum("grams").alias("grams"),
        F.round(F.avg("tokens"), 4).alias("mean_tokens"), F.round(F.avg("grams"), 4).alias("mean_grams"),
    )


def m3_corpus_meta(spark: SparkSession, d: str) -> DataFrame:
    return overlap.corpus_meta(table(spark, d, "documents"), "text")


def m3_gram_cap(spark: SparkSession, d: str) -> DataFrame:
    return overlap.capped_grams(table(spark, d, "documents"), "doc_id", "text", CAP)


def m3_overlap_capped(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the items with the capped build only."""
    items = _items(spark, d)
    found = overlap.capped_keys(table(spark, d, "documents"), "doc_id", "text", CAP).withColumn("in_corpus", F.lit(1))
    counts = overlap.item_grams(items, "item_id", "text").join(found, "gram", "left").groupBy("item_id").agg(F.count("*").alias("grams"), F.count("in_corpus").alias("matched"))
    return items.select("item_id").join(counts, "item_id", "left").na.fill(0, ["grams", "matched"])


def m3_overlap_by_source(spark: SparkSession, d: str) -> DataFrame:
    own = overlap.item_grams(_items(spark, d), "item_id", "text")
    hits = overlap.corpus_hits(table(spark, d, "documents"), "text", own, keep=("doc_id", "source"))
    return hits.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("gram").alias("distinct_grams"))


def item_surface_text(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", "text")


QUERIES = {
    f.__name__: f
    for f in (m3_overlap_by_item, m3_overlap_summary, m3_dry_run_stats, m3_corpus_meta, m3_gram_cap, m3_overlap_capped, m3_overlap_by_source, item_surface_text)
}

_LOWER = "lower(replace({}, 'İ', 'i' || chr(775)))"
_TOKENS = "regexp_extract_all(" + _LOWER + ", '[\\p{{L}}\\p{{N}}_]+')"
_ITEM = "trim(coalesce(trim(soru), '') || ' ' || coalesce(trim(cevap), ''))"
_GRAMS = "list_transform(range(1, len(t) - 12 + 1), lambda i: array_to_string(list_slice(t, i, i + 12), ' '))"
_WITH = f"""
with it as (select item_id, bench, {_TOKENS.format(_ITEM)} as t from heldout_items),
ig as (select distinct item_id, unnest({_GRAMS}) as gram from it where len(t) >= 13),
dt as (select doc_id, source, {_TOKENS.format("text")} as t from documents where text is not null),
dg as (select distinct doc_id, source, unnest({_GRAMS}) as gram from dt where len(t) >= 13),
hit as (select distinct gram from dg where gram in (select gram from ig)),
by_item as (
  select i.item_id, any_value(i.bench) as bench, count(g.gram) as grams, count(h.gram) as matched
  from it i left join ig g on g.item_id = i.item_id left join hit h on h.gram = g.gram group by i.item_id)
"""
SQL = {
    "m3_overlap_by_item": _WITH + "select item_id, grams, matched, matched > 0 as hit from by_item",
    "m3_overlap_summary": _WITH
    + """select bench, count(*) as n_items, count(*) filter (where matched > 0) as items_with_match,
      sum(grams)::bigint as total_item_grams, sum(matched)::bigint as matched_grams,
      round(count(*) filter (where matched > 0)::double / count(*), 6) as match_rate,
      case when sum(grams) > 0 then round(sum(matched)::double / sum(grams), 6) else 0.0 end as grams_matched_rate
      from by_item group by bench""",
    "m3_dry_run_stats": f"""with it as (select bench, len({_TOKENS.format(_ITEM)}) as n from heldout_items)
      select bench, count(*) as items, sum(n)::bigint as tokens, sum(greatest(0, n - 12))::bigint as grams,
      round(avg(n), 4) as mean_tokens, round(avg(greatest(0, n - 12)), 4) as mean_grams from it group by bench""",
    "m3_corpus_meta": f"""with d as (select coalesce(text, '') as x, not regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}]') as blank from documents)
      select count(*) as items, coalesce(sum(length(x)) filter (where not blank), 0)::bigint as chars,
      count(*) filter (where blank) as empty_skipped,
      coalesce(sum(greatest(0, len({_TOKENS.format("x")}) - 12)) filter (where not blank), 0)::bigint as grams from d""",
    "m3_gram_cap": f"""with d as (select doc_id, greatest(0, len({_TOKENS.format("coalesce(text, '')")}) - 12)::bigint as grams from documents),
      r as (select *, sum(grams) over (order by doc_id rows unbounded preceding) - grams as before from d)
      select doc_id, grams, least(grams, {CAP} - before)::bigint as kept from r where before < {CAP}""",
    "m3_overlap_capped": f"""
with it as (select item_id, {_TOKENS.format(_ITEM)} as t from heldout_items),
ig as (select distinct item_id, unnest({_GRAMS}) as gram from it where len(t) >= 13),
dt as (select doc_id, {_TOKENS.format("coalesce(text, '')")} as t from documents),
n as (select doc_id, t, sum(greatest(0, len(t) - 12)) over (order by doc_id rows unbounded preceding) - greatest(0, len(t) - 12) as before from dt),
dg as (select before, unnest({_GRAMS}) as gram, unnest(range(1, len(t) - 11)) as pos from n where len(t) >= 13 and before < {CAP}),
hit as (select distinct gram from dg where before + pos <= {CAP})
select i.item_id, count(g.gram) as grams, count(h.gram) as matched from it i left join ig g on g.item_id = i.item_id left join hit h on h.gram = g.gram group by i.item_id""",
    "m3_overlap_by_source": _WITH
    + "select source, count(distinct doc_id) as docs, count(distinct gram) as distinct_grams from dg where gram in (select gram from ig) group by source",
    "item_surface_text": f"select item_id, {_ITEM} as text from heldout_items",
}
