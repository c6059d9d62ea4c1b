import json
import random

import pytest
from leakgauge.operators.packed import known_spans, parse, segment, split_packed

CASES = [
    ('["a","b, c"]', ["a", "b, c"]),
    ("['x', \"Y'nin z\"]", ["x", "Y'nin z"]),
    ("('1,5', '2')", ["1,5", "2"]),
    ("['a b' 'c'\n 'd']", ["a b", "c", "d"]),
    ('["S\\u00fct", "\\"q\\" x"]', ["Süt", '"q" x']),
    ('"[\\"a\\", \\"b\\"]"', ["a", "b"]),
    ("A) x\nB) y\r\nC) z", ["x", "y", "z"]),
    ("A: x; B: y; C: z", ["x", "y", "z"]),
    ("A) 950 B) 623 C) 943", ["950", "623", "943"]),
    ("A- k\nB- \nC- m", ["k", "", "m"]),
    ('["A) x", "B) y"]', ["x", "y"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_structured(text, want):
    kind, got = parse(text)
    assert kind in ("list", "letter") and got == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("a;b;;d;", ["a", "b", "", "d"]),
        ("x | y | z", ["x", "y", "z"]),
        ("a / b c / 67 km/saat", ["a", "b c", "67 km/saat"]),
        ('k, "s, t ve u", v', ["k", "s, t ve u", "v"]),
        ('"a""b"" c","d"', ['a"b" c', "d"]),
        ("“a, b”, “c”", ["a, b", "c"]),
        ("1|2\t3\n4;5", ["1", "2", "3", "4", "5"]),
        ("22,5; 91,1", ["22,5", "91,1"]),
        ("950, 623", ["950", "623"]),
        ("tek", ["tek"]),
    ],
)
def test_bare(text, want):
    assert segment(parse(text)[1][0]) == want


def test_dictionary_protects_delimiters(spark):
    rows = [(1, "['ders; ardından göl', 'Sınav']"), (2, "ders; ardından göl;Sınav"), (3, "Sınav; ders; ardından göl; ağ"), (4, "[ders; ardından göl, Sınav]")]
    got = split_packed(spark.createDataFrame(rows, "id int, f string"), "f")
    by = {}
    for r in got.collect():
        by.setdefault(r.id, {})[r.pos] = r.val
    assert [by[2][k] for k in sorted(by[2])] == ["ders; ardından göl", "Sınav"]
    assert [by[3][k] for k in sorted(by[3])] == ["Sınav", "ders; ardından göl", "ağ"]
    assert [by[4][k] for k in sorted(by[4])] == ["ders; ardından göl", "Sınav"]


def test_commas_outside_quotes_separate():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for k in ("80,6", "80", "6"):
        auto.add_word(k, (k, 3))
    auto.make_automaton()

    def cut(s, **how):
        return segment(s, spans={(a, b): 0.05 for a, b, _ in known_spans(s, auto)}, **how)

    assert cut('80,6,"363",213') == ["80", "6", "363", "213"]
    assert cut('80,6;"363";213') == ["80,6", "363", "213"]
    assert cut('80,6,"363",213', comma_separates=False) == ["80,6", "363", "213"]


def test_edges(spark):
    long = ";".join(f"değer {k}" for k in range(3000))
    rows = [(1, None, "t"), (2, "", "t"), (3, "  ", "t"), (4, "[]", "t"), (5, "a|b", None), (5, "a|b", None), (6, long, "t")]
    df = spark.createDataFrame(rows, "id int, f string, val string")
    got = split_packed(df.withColumnRenamed("val", "text"), "f").collect()
    assert sum(r.id == 5 for r in got) == 4 and sum(r.id == 6 for r in got) == 3000
    assert not {r.id for r in got} & {1, 2, 3, 4}
    assert split_packed(df.limit(0), "f").count() == 0
    clash = split_packed(df, "f", out_val="val").where("id = 5")
    assert clash.columns == ["id", "pos", "val"] and {r.val for r in clash.collect()} == {"a", "b"}


def test_round_trip():
    rnd = random.Random(5)
    words = ["süt", "I ve II", "3,5", "x'in y", "ışık (a)"]
    for _ in range(200):
        vals = [rnd.choice(words) for _ in range(rnd.randint(2, 6))]
        assert parse(repr(vals))[1] == vals
        assert segment("|".join(vals)) == vals


def test_segmentation_equals_brute_force():
    """The cheapest cover is found: every way to cut a small field costs as much or more."""
    import ahocorasick
    from itertools import product

    from leakgauge.operators.packed import _segment, pieces

    rnd = random.Random(11)
    atoms = ["su", "göl; ardından ay", "kuş", "x; y", "dal"]
    for _ in range(150):
        text = ";".join(rnd.choice(atoms) for _ in range(rnd.randint(2, 4)))
        known = {a for a in atoms if rnd.random() < 0.6}
        ps = pieces(text)
        auto = ahocorasick.Automaton()
        for k in known:
            auto.add_word(k, k)
        spans = set()
        for a in range(len(ps)):
            for b in range(a, len(ps)):
                if text[ps[a][0] : ps[b][1]].strip() in known:
                    spans.add((a, b))
        got, cover = _segment(text, ps, dict.fromkeys(spans, 0.05), {"ardından"}, {";"})

        def price(cuts):
            total, a = 0.0, 0
            covered = {k for x, y in spans for k in range(x, y)}
            for b in [*cuts, len(ps)]:
                if (a, b - 1) in spans:
                    total += 0.05
                else:
                    total += 1.0 + sum(0.0 if k in covered else 0.2 if text[ps[k + 1][0] :].split()[0].strip(";") == "ardından" else 4.0 for k in range(a, b - 1))
                    total += 3.0 if a and text[ps[a][0] :].split()[0].strip(";") == "ardından" else 0.0
                a = b
            return total

        best = min(price([k + 1 for k, c in enumerate(bits) if c]) for bits in product([0, 1], repeat=len(ps) - 1))
        assert abs(got - best) < 1e-6, (text, known, cover)


def values(spark, fields, **how):
    rows = list(enumerate(fields))
    by = {k: {} for k, _ in rows}
    for r in split_packed(spark.createDataFrame(rows, "id int, f string"), "f", **how).collect():
        by[r.id][r.pos] = r.val
    return [[v[k] for k in sorted(v)] for v in by.values()]


def test_any_number_of_marks_and_levels():
    many = [f"değer {k}" for k in range(1, 151)]
    assert parse(" ".join(f"{k}) {v}" for k, v in enumerate(many, 1)))[1] == many
    letters = [chr(65 + k) for k in range(26)] + ["AA", "AB", "AC", "AD"]
    assert parse("\n".join(f"{a}) {v}" for a, v in zip(letters, many)))[1] == many[:30]
    text = '["a, b", "c"]'
    for _ in range(10):
        text = json.dumps(text)
    assert parse(text) == ("list", ["a, b", "c"])


def test_more_delimiters():
    assert segment("• su • göl • ay") == ["su", "göl", "ay"]
    assert segment("su · göl · ay") == segment("su¦göl¦ay") == segment("su、göl、ay") == ["su", "göl", "ay"]


def test_without_the_dictionary_bare_fields_break(spark):
    """At least a fifth of the bare fields are cut otherwise where no list gives the dictionary."""
    rnd = random.Random(3)
    vals = ["Smith; Jones", "a/b; c", "su", "göl", "rock; paper; scissors", "ay", "kuş", "x|y"]
    lists = [repr([v, rnd.choice(vals)]) for v in vals] * 2
    picked = [[rnd.choice(vals) for _ in range(rnd.randint(2, 4))] for _ in range(40)]
    bare = ["; ".join(p) for p in picked]
    assert values(spark, lists + bare)[len(lists) :] == picked
    alone = values(spark, bare)
    assert sum(a != p for a, p in zip(alone, picked)) >= 8


def test_comma_rule_is_a_parameter(spark):
    fields = ["['Paris, Texas', 'Rome']"] * 3 + ["Rome,Paris, Texas"]
    assert values(spark, fields)[3] == ["Rome", "Paris", "Texas"]
    assert values(spark, fields, comma_separates=False)[3] == ["Rome", "Paris, Texas"]


def test_counts_decide_between_covers(spark):
    """A value known once yields to two that are known often."""
    often, once = ["['ab; c', 'ab']"] * 9, ["['ab', 'c']"] * 9
    assert values(spark, often + ["['c', 'ab']", "ab; c; d"])[-1] == ["ab; c", "d"]
    assert values(spark, once + ["['ab; c', 'q']", "ab; c; d"])[-1] == ["ab", "c", "d"]


def test_hot_shard(spark):
    """All fields begin with one word: its shard is dealt out, repeated fields are cut alike."""
    fields = ["['ders; ardından göl', 'su']"] + ["ders; ardından göl; su"] * 500
    assert all(v == ["ders; ardından göl", "su"] for v in values(spark, fields))


def test_plain_cuts_are_the_cheapest_covers():
    """Where no known value spans a delimiter the cover needs no search."""
    from leakgauge.operators.packed import _segment, pieces

    rnd = random.Random(6)
    for _ in range(300):
        text = "".join(rnd.choice(["su", "Ay, kuş", "", "3,5", "x ve y", '"a;b"']) + rnd.choice([";", "; ", "|", "\t"]) for _ in range(rnd.randint(1, 5))).rstrip()
        ps = pieces(text)
        strong = {p[2] for p in ps if p[2]} - {","}
        spans = {(k, k): 0.2 for k in range(len(ps)) if rnd.random() < 0.5}
        if strong:
            _, cover = _segment(text, ps, spans, set(), strong)
            at = [0, *(k + 1 for k, p in enumerate(ps) if p[2] in strong), len(ps)]
            assert cover == list(zip(at, at[1:])), text
