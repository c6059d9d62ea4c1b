"""Load delimited records that may be damaged; part failures off with the reason.

Records come one per row. Their quoting is judged by one linear-time pattern
over the Arrow column. Well-quoted records of a batch are read by pyarrow's CSV
reader, all fields as strings; its invalid-row callback takes the rows with a
wrong number of columns. The fields are then cast as whole vectors and the cells
that fail are labelled. Reasons apply in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROKEN, COUNT, BAD = "broken_quote", "column_count", "bad_value"
#: A field is quoted as a whole, inner quotes doubled, or holds no quote.
_RECORD = r'(?s)^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'
_BARE_BREAK = "\x1d"  # stands for a line break outside quotes while a batch is read
_QUOTED = r'(?s)("(?:[^"]|"")*")|[\r\n]'

Check = Callable[[pa.Array], pa.Array]


def is_digits(a: pa.Array) -> pa.Array:
    return pc.match_substring_regex(a, r"^[0-9]+$")


def is_amount(a: pa.Array) -> pa.Array:
    return pc.match_substring_regex(a, r"^[0-9]+(\.[0-9]+)?$")


def is_filled(a: pa.Array) -> pa.Array:
    return pc.greater(pc.utf8_length(a), 0)


def is_free(a: pa.Array) -> pa.Array:
    return pa.array(np.ones(len(a), dtype=bool))


def is_bool(a: pa.Array) -> pa.Array:
    return pc.is_in(pc.ascii_lower(a), value_set=pa.array(["true", "false"]))


def one_of(*values: str) -> Check:
    return lambda a: pc.is_in(a, value_set=pa.array(list(values)))


def is_time(a: pa.Array) -> pa.Array:
    """Real times as yyyy-MM-ddTHH:mm:ss: the form by pattern, the day by calendar."""
    form = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
    shaped = pc.match_substring_regex(a, form)
    safe = pc.if_else(shaped, a, pa.scalar("2000-01-01T00:00:00"))
    y, m, d = (pc.cast(pc.utf8_slice_codeunits(safe, i, j), pa.int32()).to_numpy(zero_copy_only=False) for i, j in ((0, 4), (5, 7), (8, 10)))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[m] + ((m == 2) & leap)
    return pc.and_(shaped, pa.array((d <= days) & (y > 0)))


@dataclass(frozen=True)
class Layout:
    """Columns of a record in order, each with the check of its trimmed value."""

    checks: tuple[tuple[str, Check], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.checks]


PILOT = Layout((("i", is_digits), ("subject", is_filled), ("type", one_of("blackbox", "choice_sub")), ("model", is_filled), ("raw", is_free)))
SPEND = Layout((("ts", is_time), ("calls_logged", is_digits), ("accumulated_cost_est_usd", is_amount), ("cost_cap_usd", is_amount), ("abort", is_bool)))


def _trim(a: pa.Array) -> pa.Array:
    return pc.utf8_trim(a, " \t\r\n")


def _hide_breaks(s: str) -> str:
    import re

    return re.sub(_QUOTED, lambda m: m[1] or (_BARE_BREAK if m[0] == "\n" else "\x1c"), s)


def judge(records: pa.Array, layout: Layout) -> tuple[list[str | None], list[pa.Array]]:
    """Reason of each record (None: it loads) and the field vectors of all records.

    Fields of a failing record are null. A null record has no field at all and so
    the wrong column count.
    """
    n, width = len(records), len(layout.checks)
    reason = np.full(n, None, dtype=object)
    present = pc.is_valid(records).to_numpy(zero_copy_only=False)
    reason[~present] = COUNT
    well = pc.fill_null(pc.match_substring_regex(records, _RECORD), False).to_numpy(zero_copy_only=False)
    reason[present & ~well] = BROKEN
    at = np.flatnonzero(present & well)
    fields = [pa.nulls(n, pa.string()) for _ in range(width)]
    if not len(at):
        return reason.tolist(), fields
    lines = records.take(pa.array(at)).to_pylist()
    hidden = [("\n" in s or "\r" in s) for s in lines]
    lines = [_hide_breaks(s) if h else s for s, h in zip(lines, hidden)]
    # The first column is the record's place in the batch, so that rows that the
    # reader rejects can be told apart from those it keeps.
    block = "".join(f"{k},{s}\n" for k, s in enumerate(lines)).encode()
    lost: set[int] = set()

    def rejected(row: pacsv.InvalidRow) -> str:
        lost.add(int(row.text.split(",", 1)[0]))
        return "skip"

    names = ["#", *layout.names]
    got = pacsv.read_csv(
        pa.BufferReader(block),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, 2 * max(map(len, lines)) + 64, len(block) + 1)),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, double_quote=True, invalid_row_handler=rejected, ignore_empty_lines=False),
        convert_options=pacsv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    ).combine_chunks()
    kept = np.array([int(x) for x in got.column(0).to_pylist()], dtype=np.int64)
    short = np.setdiff1d(np.arange(len(at)), kept)
    reason[at[short]] = COUNT
    if len(kept):
        good = np.ones(len(kept), dtype=bool)
        columns = []
        for name, check in layout.checks:
            col = got.column(name)
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            if any(hidden):
                col = pc.replace_substring(pc.replace_substring(col, _BARE_BREAK, "\n"), "\x1c", "\r")
            good &= pc.fill_null(check(_trim(col)), False).to_numpy(zero_copy_only=False)
            columns.append(col)
        reason[at[kept[~good]]] = BAD
        place = np.full(n, -1, dtype=np.int64)
        place[at[kept[good]]] = np.flatnonzero(good)
        index = pa.array(place, mask=place < 0)
        fields = [c.take(index) for c in columns]
    return reason.tolist(), fields


#: Bytes of records that are read at a time; one that is longer is read alone.
BLOCK = 16 << 20


def slices(batch: pa.RecordBatch, at: int, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most so many bytes in column ``at``; no record is cut or left out."""
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _free(name: str, key: list[str]) -> str:
    """The name of an added column; a key column of that name keeps it."""
    return name if name not in key else f"reject_{name}"


def judge_records(df: DataFrame, text: str, layout: Layout, key: list[str]) -> DataFrame:
    """``key`` columns, ``reason`` and the layout's fields of every record of ``df``.

    ``reason`` is null and the fields are filled (untrimmed, as read) where the
    record loads; otherwise the fields are null. Null records count as having the
    wrong number of columns, empty ones too. Repeated records are judged alike,
    length is unbounded, an empty table gives an empty table. A key column named as
    an added one keeps its name; the added one is then ``reject_reason`` or
    ``field_...``. Nothing is shuffled: the operator is one narrow pass.
    """
    clash = {c: f"_f_{c}" for c in layout.names}
    schema = df.select(*[F.col(f"`{c}`") for c in key]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, len(key))):
            reason, fields = judge(b.column(len(key)), layout)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(len(key))), pa.array(reason, pa.string()), *fields],
                names=[*(f"_k_{k}" for k in range(len(key))), "reason", *clash.values()],
            )

    out = ", ".join([*(f"_k_{k} {f.dataType.simpleString()}" for k, f in enumerate(schema)), "reason string", *(f"{c} string" for c in clash.values())])
    took = df.select(*[F.col(f"`{c}`").alias(f"_k_{k}") for k, c in enumerate(key)], F.col(f"`{text}`").alias("_text")).mapInArrow(run, out)
    names = set(key)
    return took.select(*[F.col(f"_k_{k}").alias(c) for k, c in enumerate(key)], F.col("reason").alias(_free("reason", key)), *[F.col(v).alias(c if c not in names else f"field_{c}") for c, v in clash.items()])


def judge_cells(df: DataFrame, field: str, check: Check, key: list[str]) -> DataFrame:
    """``key`` columns and ``reason`` (null: it is good) of single logged values; null is bad."""
    schema = df.select(*[F.col(f"`{c}`") for c in key]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pc.fill_null(check(_trim(b.column(len(key)))), False)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(len(key))), pc.if_else(ok, pa.scalar(None, pa.string()), pa.scalar(BAD))],
                names=[*(f"_k_{k}" for k in range(len(key))), "reason"],
            )

    out = ", ".join([*(f"_k_{k} {f.dataType.simpleString()}" for k, f in enumerate(schema)), "reason string"])
    took = df.select(*[F.col(f"`{c}`").alias(f"_k_{k}") for k, c in enumerate(key)], F.col(f"`{field}`").alias("_text")).mapInArrow(run, out)
    return took.select(*[F.col(f"_k_{k}").alias(c) for k, c in enumerate(key)], F.col("reason").alias(_free("reason", key)))
