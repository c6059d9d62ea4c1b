import random

import pytest
from leakgauge.llm import mojibake as mj

TR = "Öğrenciler güncel bir özet arıyor, Şimdi çünkü ışık kısmi — “evet” dedi."
BAD = [("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp857", "latin-1")]
CLEAN = [
    TR, "ATENÇÃO: A resposta NÃO FOI APROVADA.", "KÂTİP ve ÂLİM sözcükleri", "√2 ≈ 1,41 ve § 54", "├── veri\n└── rapor", "Það var 1999 þegar þáttur er ný.", "Straße, äußerst früh", "À Kagakhal, l’épreuve déjà vérifiée", "問題97の答え", "مثال 88", "👩‍🔬 🚀",
    "étude no 5", "Письмо и Книга", '{"soru": "T\\u0131vkan tah\\u0131l"}', "a b­c", "24 °C, ½ × 3² £5 ¿qué?", "kışın\xa0da\xa0ışık\xa0ve\xa0süt\xa0ile\xa0göl\xa0var", "gü\u200bz\xadel", "",
]


@pytest.mark.parametrize("src,read", BAD)
def test_restores(src, read):
    text = TR.replace("—", "-").replace("“", '"').replace("”", '"') if src == "cp857" else TR
    got, hit = mj.search(text.encode(src).decode(read, "replace"))
    assert hit
    if read in ("latin-1", "cp1251", "cp850"):
        assert got == text


def test_double_and_stretch():
    twice = TR.encode().decode("latin-1").encode().decode("latin-1")
    assert mj.search(twice) == (TR, True)
    part = "Bu cümle doğru. " + "Bu cümle bozuk.".encode().decode("latin-1") + " Yine doğru."
    assert mj.search(part) == ("Bu cümle doğru. Bu cümle bozuk. Yine doğru.", True)


@pytest.mark.parametrize("text", CLEAN)
def test_leaves_correct_text(text):
    assert mj.search(text) == (text, False)


def test_operator(spark):
    good = ["sınav kısmi ışık şiir değil"] * 6 + ["Það var ný þáttur þegar að"] * 4
    rows = [(k, t) for k, t in enumerate(good)]
    rows += [(20, "sýnav kýsmi þiir"), (21, TR.encode().decode("latin-1")), (21, TR.encode().decode("latin-1")), (22, "kay�p"), (23, None), (24, ""), (25, ("veri " * 50_000) + "yÃ¶ntem")]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id bigint, text string, restored string")
    got = mj.repaired(df, "text", ["doc_id"]).where("affected").collect()
    assert sorted(r.doc_id for r in got) == [20, 21, 21, 22, 25]
    by = {r.doc_id: r.restored for r in got}
    assert by[20] == "sınav kısmi şiir" and by[21] == TR and by[25].endswith("yöntem")
    assert mj.repaired(df.limit(0), "text", ["doc_id"]).count() == 0


def test_hot_copies_do_not_outvote(spark):
    rows = [(k, f"sınav kısmi şiir {k}") for k in range(10)] + [(100 + k, "sýnav kýsmi þiir") for k in range(2_000)]
    got = mj.repaired(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", ["doc_id"]).where("affected").collect()
    assert sorted(r.doc_id for r in got) == list(range(100, 2_100))
    assert {r.restored for r in got} == {"sınav kısmi şiir"}


@pytest.mark.parametrize("times", [3, 5, 7])
def test_depth_is_unbounded(times):
    text = "Şimdi ışık"
    for _ in range(times):
        text = text.encode().decode("latin-1")
    assert mj.search(text) == ("Şimdi ışık", True)


def test_a_stopped_search_is_reported(spark, monkeypatch):
    rnd = random.Random(100)
    junk = "".join(rnd.choice("ÃÄÅÂ€™š¼ýþþðabcýŸœ") for _ in range(100))
    df = spark.createDataFrame([(1, junk), (2, TR.encode().decode("latin-1"))], "doc_id int, text string")
    got = {r.doc_id: r.stopped for r in mj.repaired(df, "text", ["doc_id"]).collect()}
    assert got == {1: True, 2: False}


def test_weighed_words():
    assert mj._WEIGHED.findall("ışık, sýnav kar þ göl_şu açık1ş") == ["ışık", "sýnav", "þ", "şu", "açık", "ş"]
