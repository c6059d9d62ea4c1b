from leakgauge.llm import lookalikes as lk


def fixed(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, t string, consistent string")
    return [r.consistent for r in sorted(lk.consistent(df, "t").collect(), key=lambda r: r.k)]


PLAIN = ["Güçlü ışık kullanımı", "“tırnak” – ½ ²x 24 °C 🙂 ✔", "письмо λόγος", "kisa kullanimi", "KÂTİP", "👩‍🔬 1", "", None, "a\tb\nc", "don’t"]
ODD = {
    "ku​ral": "kural", "so­nuç": "sonuç", "﻿veri": "veri", "a b c　d": "a b c d", "isteğe‑bağlı": "isteğe-bağlı",
    "ｈａｎｇｉｓｉ（Ⅱ）": "hangisi(II)", "ﬁkir": "fikir", "kurаlı": "kuralı", "gӧrünür": "görünür", "Үаlnız": "Yalnız", "i̇çin": "için",
    "göl": "göl", "kiși": "kişi", "с̧izgi": "çizgi", "В) ｋａｌｉｔｅ": "В) kalite",
}


def test_forms(spark):
    got = fixed(spark, PLAIN + list(ODD))
    assert got[: len(PLAIN)] == PLAIN
    assert got[len(PLAIN) :] == list(ODD.values())


def test_trie_prefers_frequent_words():
    t = lk.Trie()
    t.add("sınav", 9)
    t.add("sinav", 2)
    assert t.match("ѕіnаv") == "sınav" and t.match("ѕinаv") == "sinav" and t.match("sonav") is None
    assert lk.skeleton("ѕіnаv") == lk.skeleton("sınav")


def test_vocabulary_settles_spelling(spark):
    texts = ["ışık ısı"] * 3 + ["ıșık", "іѕі", "іѕі", "x" * 400_000 + " kurаl"]
    got = fixed(spark, texts)
    assert got[3:6] == ["ışık", "ısı", "ısı"] and got[6].endswith(" kural")


def test_found(spark):
    df = spark.createDataFrame([(1, "ku​ral"), (1, "ku​ral"), (2, "kural"), (3, None)], "line_no bigint, f string")
    got = lk.found([("t", "f", df)])
    assert [tuple(r) for r in got.collect()] == [("t", "f", 1)] * 2
    assert lk.found([("t", "f", df.limit(0))]).count() == 0


def trie(*words):
    t = lk.Trie()
    for k, w in enumerate(words):
        t.add(w, 100 - k)
    return t


def test_weights():
    t = trie("göl", "kural", "kar")
    assert t.match("ｋu\u200br\u00adаl") == "kural"  # widths, ignorables and look-alikes cost nothing
    assert t.match("kυ\u0301ral") == "kural"  # a foreign mark on a look-alike is within the limit
    assert t.match("gоl") is None and t.match("gоl", lk.MARK) == "göl"  # a mark that the word has costs more
    assert t.match("kаrn") is None and t.match("kаrn", 1.0) == "kar" and t.match("kuraӏ", 0.0) == "kural"
    assert t.match("kоral", 1.0) == "kural" and t.match("kоral") is None


def test_weighted_walk_equals_brute_force():
    """The cheapest cover over all alignments of token and word, on small alphabets."""
    import functools
    import random
    import unicodedata

    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcoğ") for _ in range(rnd.randint(1, 4))) for _ in range(12)]

    def least(token, word):
        a, b = unicodedata.normalize("NFD", token), unicodedata.normalize("NFD", word)

        @functools.cache
        def go(i, j):
            best = [0.0] if i == len(a) and j == len(b) else []
            mark = lambda c: bool(unicodedata.combining(c))
            if i < len(a):
                c = a[i]
                if j < len(b) and (b[j] == c or b[j] in lk.RESEMBLES.get(c, "") or lk.MARKS.get(c) == b[j]):
                    best.append(go(i + 1, j + 1))
                if c == "\u200b":
                    best.append(go(i + 1, j))
                elif mark(c):
                    on = next((x for x in reversed(a[:i]) if not mark(x) and x != "\u200b"), "")
                    best.append((lk.MARK_ON_LOOKALIKE if on in lk.RESEMBLES else lk.MARK) + go(i + 1, j))
                else:
                    best.append(lk.LETTER + go(i + 1, j))
                    if j < len(b) and not mark(b[j]):
                        best.append(lk.LETTER + go(i + 1, j + 1))
            if j < len(b):
                best.append((lk.MARK if mark(b[j]) else lk.LETTER) + go(i, j + 1))
            return min(best)

        return go(0, 0)

    t = trie(*words)
    for _ in range(300):
        token = "".join(rnd.choice("abcoğаосğ\u200b\u0301") for _ in range(rnd.randint(1, 5)))
        for limit in (0.0, lk.LIMIT, 1.0, 2.0):
            want = min(least(token, w) for w in words)
            got = t.match(token, limit)
            assert (got is None) == (want > limit + 1e-9), (token, limit)
            if got:
                assert abs(least(token, got) - want) < 1e-9


def test_vocabulary_decides_and_shards_agree(spark, monkeypatch):
    texts = [f"kelime{chr(97 + k)} ışık" for k in range(26)] * 2 + ["іşіk", "kеlіmeb"]
    for size in (20_000, 1):
        monkeypatch.setattr(lk, "SHARD_WORDS", size)
        assert fixed(spark, texts)[-2:] == ["ışık", "kelimeb"]


def test_other_columns_stay_as_they_are(spark):
    """Whatever their types: also a number that is none, nested values and nulls."""
    rows = [(1, "kurаlı", float("nan"), [1, None], {"q": None}, b"\x00\xff", 2**60), (2, "düz", None, None, None, None, None), (3, "ku\u200bral", 0.5, [], {}, b"", None)]
    df = spark.createDataFrame(rows, "k int, t string, f double, a array<int>, m map<string,int>, b binary, big bigint").selectExpr("*", "timestamp'2024-03-31 02:30:00.123456' as ts", "struct(k as u, array(t, null) as v) as st")
    got = lk.consistent(df, "t")
    assert sorted(map(str, got.drop("consistent").collect())) == sorted(map(str, df.collect()))
    assert {r.k: r.consistent for r in got.collect()} == {1: "kuralı", 2: "düz", 3: "kural"}
