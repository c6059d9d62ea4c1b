import pathlib
import re

from leakgauge.functions.cache import short_cache

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_optional_part():
    for f in (ROOT / "leakgauge").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"(?:from|import)\s+leakgauge\.llm", f.read_text(encoding="utf-8")), f


def test_every_sql_twin_has_its_query():
    from leakgauge.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 50


def test_short_cache_forgets_long_arguments():
    calls = []

    @short_cache(10, 3)
    def f(s):
        calls.append(s)
        return s.upper()

    assert [f("ab"), f("ab"), f("abcd"), f("abcd")] == ["AB", "AB", "ABCD", "ABCD"]
    assert calls == ["ab", "abcd", "abcd"]
