"""Sinks: appended JSON lines, CSV with a manifest, statistics, a Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows to a ledger folder; each write is one atomic set of files."""
    df.write.mode("append").json(path)


def csv_with_manifest(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write item CSV partitioned by ``by`` and return its manifest (name, rows)."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    flat = df.withColumns({c: F.to_json(c) for c in arrays}) if arrays else df
    flat.write.mode("overwrite").partitionBy(by).csv(path, header=True, escape='"')
    return df.groupBy(by).agg(F.count("*").alias("items"))


def stats_json(cells: DataFrame, key: list[str]) -> DataFrame:
    """``cell, stats``: each cell as one JSON object."""
    rest = [c for c in cells.columns if c not in key]
    return cells.select(F.concat_ws("|", *key).alias("cell"), F.to_json(F.struct(*rest)).alias("stats"))


def show_p(p: float | None) -> str:
    return "—" if p is None else "<0.001" if p < 0.001 else f"{p:.3f}"


def markdown(cells: DataFrame, title: str, most: int = 1000) -> str:
    """A table of the cells; a report has some dozen of them, more than ``most`` is an error."""
    rows = cells.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} cells isn't one")
    head = cells.columns
    cell = lambda c, v: show_p(v) if c.startswith("p_") or c.endswith("_p") else "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join(cell(c, r[c]) for c in head) + " |" for r in rows]
    return "\n".join(lines) + "\n"
