"""Readers: item files, article files, ledgers, encyclopedia dumps, capped corpora."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakgauge import schemas


def csv_items(spark: SparkSession, path: str | list[str], schema: str = schemas.QA_ITEM, strip: bool = True) -> DataFrame:
    """Item CSV with a header: quoted line breaks are kept, nulls become empty, blanks are trimmed.

    A file of nothing but its header gives an empty table.
    """
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', quote='"', mode="PERMISSIVE")
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if strip else F.coalesce(F.col(c), F.lit(""))
    return df.select(*[clean(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def parquet_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Splits of one benchmark as one table, by column name."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def ledger(spark: SparkSession, path: str | list[str], schema: str = schemas.LEDGER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(calls, events, unreadable)`` of a JSON-lines ledger.

    Blank lines are skipped. Lines that don't parse (a cut-off last line, say) come
    out as they are in the third table. ``line_no`` is ordered within a file: file
    lines keep their order, and later files come later by path.
    """
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("line_no", F.monotonically_increasing_id())
    lines = lines.where(F.length(F.trim("value")) > 0)
    with_bad = f"{schema}, _bad string"
    got = lines.withColumn("r", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fine = got.where(F.col("r._bad").isNull() & F.col("r").isNotNull()).select("file", "line_no", "r.*").drop("_bad")
    bad = got.where(F.col("r._bad").isNotNull() | F.col("r").isNull()).select("file", "line_no", F.col("value").alias("line"))
    return fine.where("event is null"), fine.where("event is not null"), bad


def articles(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """``article, question, answer, category`` of a folder of article JSON files.

    ``questions`` may be an object or the object as text (JSON, or a Python literal
    with single quotes). Unreadable files give no row. ``files`` (column
    ``article``) restricts the read to a sample of files; all their rows are kept.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    raw = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("article"), "value")
    if files is not None:
        raw = raw.join(files.select("article").distinct(), "article", "left_semi")
    q = raw.withColumn("q", F.get_json_object("value", "$.questions"))
    parsed = F.coalesce(F.from_json("q", schemas.QUESTIONS), F.from_json("q", schemas.QUESTIONS, {"allowSingleQuotes": "true"}))
    return q.withColumn("item", F.explode(parsed["items"])).select("article", "item.question", "item.answer", "item.category")


def sample_files(spark: SparkSession, path: str, n: int, seed: int = 42) -> DataFrame:
    """``article`` names of a seeded sample of a folder's JSON files."""
    from leakgauge.operators.sample import hash_sample

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("article"))
    return hash_sample(names, "article", n, seed).select("article")


def encyclopedia(spark: SparkSession, path: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(pages, meta)`` of a MediaWiki dump (plain, gz or bz2; bz2 is split).

    Pages of namespace 0 that have text and are no redirect; the counts of all
    pages, redirects and skipped ones are one row of ``meta``. ``most`` keeps the
    first so many pages by id, as a dump has them; ``truncated`` tells whether that
    left any out. Grams are counted and capped by ``overlap.corpus_meta`` and
    ``overlap.capped_keys``.
    """
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, ns int, id bigint, redirect struct<_title string>, revision struct<text struct<_VALUE string>>").load(path)
    text = F.coalesce(F.col("revision.text._VALUE"), F.lit(""))
    rows = pages.select("id", "title", "ns", text.alias("text"), F.col("redirect").isNotNull().alias("moved"))
    good = (F.col("ns") == 0) & (F.length("text") > 0) & ~F.col("moved") & ~F.col("text").rlike("^#(REDIRECT|YÖNLENDİR)")
    meta = rows.agg(
        F.count("*").alias("pages"), F.count_if(good).alias("kept"), F.count_if(~good & F.col("moved")).alias("redirects"), F.count_if(~good & ~F.col("moved")).alias("skipped"), F.coalesce(F.sum(F.when(good, F.length("text"))), F.lit(0)).alias("chars")
    )
    meta = meta.withColumn("truncated", F.lit(False) if most is None else F.col("kept") > most)
    kept = rows.where(good).select("id", "title", "text")
    return kept if most is None else kept.orderBy("id").limit(most), meta


def capped_corpus(df: DataFrame, text: str, cap: int) -> DataFrame:
    """The first ``cap`` rows, of which blank ones are then dropped: they count toward the cap."""
    return df.limit(cap).where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(path: str) -> list[dict[str, str]]:
    """Cells of the first sheet of a workbook, a dict by column letters for each row."""
    with zipfile.ZipFile(path) as z:
        names = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = ElementTree.fromstring(z.read(names[0]))
    out = []
    for row in sheet.iter(f"{_SHEET}row"):
        cells = {}
        for c in row.iter(f"{_SHEET}c"):
            text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else c.findtext(f"{_SHEET}v")
            if text is not None:
                cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(text)] if c.get("t") == "s" else text
        out.append(cells)
    return out


def xlsx(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first sheet of a workbook whose first row names the columns; cells as text, empty ones null.

    A workbook is small by format, so it is read as one file.
    """
    head, *rows = _sheet_rows(path)
    at = {name: column for column, name in head.items()}
    names = [f.name for f in schemas.struct(schema).fields]
    return spark.createDataFrame([tuple(r.get(at[n]) for n in names) for r in rows], schema)
