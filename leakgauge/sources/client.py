"""The place where answers come from. No network client ships with the library."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Client(Protocol):
    """Answers one prompt. Implementations bring their own limits and retries."""

    def answer(self, model: str, prompt: str) -> str: ...


def answered(tasks: DataFrame, client: Client) -> DataFrame:
    """``tasks`` (columns ``model, prompt`` and any others) with ``raw, ok, error``.

    A failing call is a row with its error, never a failing task.
    """
    names = tasks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, error = [], []
            for m, p in zip(b["model"], b["prompt"]):
                try:
                    raw.append(client.answer(m, p))
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    raw.append(None)
                    error.append(str(e)[:400])
            yield b[names].assign(raw=raw, ok=[e is None for e in error], error=error)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields)
    return tasks.mapInPandas(run, ddl + ", raw string, ok boolean, error string")
