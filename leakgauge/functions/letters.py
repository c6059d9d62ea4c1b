"""The answer letter in free-form output, in four modes that differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_B = r"(?:^|[^\p{L}\p{N}_])"
_E = r"(?:[^\p{L}\p{N}_]|$)"
_S = r"[\s\p{Z}]"

#: Patterns as both engines read them; the letter is group 1.
PAREN = rf"{_B}([A-Ea-e]){_S}*\)"
CEVAP = rf"{_B}Cevap:{_S}*([A-Ea-e]){_E}"
LONE = rf"{_B}([A-Ea-e]){_E}"
BARE = rf"^{_S}*([A-Ea-e]){_S}*$"
LABEL = rf"{_B}(?:Cevap|Answer|Cevapla):?{_S}*\(?([A-Ea-e])"
PAREN_TEXT = rf"{_B}([A-Ea-e]){_S}*\){_S}*[^\s\p{{Z}}]"

MODES = {
    "core": (PAREN, CEVAP, LONE, BARE),
    "backtrans": (PAREN, BARE, CEVAP, LONE),
    "pilot": (PAREN, BARE, CEVAP),
    "scale3arm": (LABEL, PAREN_TEXT, LONE),
}


def parse_letter(raw: Column, mode: str = "core") -> Column:
    """A to E, or null. The first pattern of the mode that matches decides.

    Modes with the lone-letter fallback also take the English article for an A;
    ``pilot`` has no such fallback.
    """
    tries = [F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in MODES[mode]]
    return F.upper(F.coalesce(*tries))


def parse_letter_sql(raw: str, mode: str = "core") -> str:
    """The same as an SQL expression for the twin queries."""
    tries = ", ".join(f"nullif(regexp_extract({raw}, '{p}', 1), '')" for p in MODES[mode])
    return f"upper(coalesce({tries}))"
