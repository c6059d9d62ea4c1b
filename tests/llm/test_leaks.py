import itertools
import random
import time

import numpy as np
import pytest
from leakgauge.llm import leaks as lk

ITEM = "Encümen üyeleri 1960 kışında limana gelen zorunlu balık yükünü törenle boşaltırken ustaları hangi yönetmelik sınavını 228 gün yasakladı ve kimler onu sonradan yazdı"
WORDS = ITEM.split()


def hit(doc, items=(ITEM,)):
    return [lk.is_passage(*lk.align(lk.text_hashes(doc), lk.text_hashes(t))) for t in items]


def test_notations():
    p = " ".join(WORDS[3:17])
    forms = [
        p, p.upper(), p.translate(str.maketrans("ıüğşöç", "iugsoc")), "**" + "** ".join(p.split()), p.replace(" ", "\n"), p.replace("boşaltırken", "boşal-\ntırken"), p.replace(" ", " ").replace("yükünü", "yü​künü"),
        p.replace("zorunlu", '<span class="x">zorunlu</span>'), p.replace("zorunlu", "[[zorunlu]]"), "".join(f"\\u{ord(c):04x}" if ord(c) > 127 else c for c in p), p.replace("ü", "&uuml;"),
        p.encode().decode("cp1252", "replace") if False else p.encode().decode("latin-1"), "\n> ".join(p.split()), p.replace("ğ", "ğ"),
    ]
    for f in forms:
        assert hit("önce başka sözler. " + f + " sonra başka sözler")[0], f


def test_edits_and_decoys():
    p = WORDS[2:18]
    assert hit(" ".join(p[:5] + ["araya"] + p[5:11] + p[12:]))[0]
    assert not hit("xx " + " ".join(WORDS[4:10]) + " yy zz")[0]
    shuffled = p[:]
    random.Random(1).shuffle(shuffled)
    assert not hit(" ".join(shuffled))[0]
    assert not hit(" ".join(w + " dolgu söz" for w in p[::2]))[0]


def test_thin_chain_hides_no_passage(spark):
    foreign = [f"yabancı{k}" for k in range(16)]
    b, c = WORDS[:12], WORDS[12:]
    long = [f"kök{k}" for k in range(9)] + b + [f"dal{k}" for k in range(9)]
    cases = [(b + foreign[:8] + c, b + c), (c + foreign[:8] + b, c + b), (long[:9] + foreign[:8] + b + foreign[8:] + long[21:], long)]
    for doc, item in cases:
        assert hit(" ".join(doc), [" ".join(item)])[0]
    short = (b[:9] + foreign[:8] + c, b[:9] + c), (b[:10] + foreign[:2] + c[:1], b[:10] + c)
    for doc, item in short:
        assert not hit(" ".join(doc), [" ".join(item)])[0]
    docs = spark.createDataFrame([(k, " ".join(d)) for k, (d, _) in enumerate(cases)], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, " ".join(t)) for k, (_, t) in enumerate(cases)], "item_id bigint, t string")
    assert {(k, k) for k in range(3)} <= {tuple(r) for r in lk.found(docs, "text", "doc_id", items, "t", "item_id").collect()}


def edited(n, at, kinds):
    """Word hashes of item and document for a passage of n places with edits at some of them."""
    item, doc = [], []
    for k in range(n):
        kind = kinds[at.index(k)] if k in at else ""
        if kind != "added":
            item.append(1_000_003 * (k + 1))
        if not kind:
            doc.append(1_000_003 * (k + 1))
        elif kind != "left out":
            doc.append(-7_919 * (k + 1))
    return np.array(item, dtype=np.int64), np.array(doc, dtype=np.int64)


@pytest.mark.parametrize("n,e", [(12, 1), (12, 2), (13, 2), (14, 3), (15, 3)])
def test_every_passage_has_two_seeds(n, e):
    """All placements and kinds of edits that leave the share of words kept; the full window alone loses some."""
    assert lk.is_passage(n - e, e)
    alone = 0
    for at in itertools.combinations(range(1, n - 1), e):
        for kinds in itertools.product(("changed", "added", "left out"), repeat=e):
            item, doc = edited(n, at, kinds)
            asked = set(lk.seeds(item, tests=True)[0].tolist())
            s, p = lk.seeds(doc)
            hit = [x in asked for x in s.tolist()]
            assert len({int(x) for x, h in zip(p, hit) if h}) >= 2, (at, kinds)
            full = len(doc) - 4
            alone += not any(hit[:full])
    assert alone or e < 2


def test_filter_misses_nothing(spark):
    rnd = np.random.default_rng(3)
    known = rnd.integers(-(1 << 62), 1 << 62, 3_000)
    other = rnd.integers(-(1 << 62), 1 << 62, 50_000)
    for bits in (1 << 20, 64):
        table = lk.filter_table(spark.createDataFrame([(int(x),) for x in known], "seed bigint"), bits)
        f = lk.Filter(table)
        assert len(f.hits(known)) == len(known) and len(table) == bits // 64
        assert len(f.hits(other)) < 50 if bits > 64 else True


def test_dense_alignment_is_the_same(monkeypatch):
    rnd = random.Random(5)
    for _ in range(120):
        n, m = rnd.randint(1, 60), rnd.randint(1, 30)
        doc, item = (np.array([rnd.randint(0, 5) for _ in range(k)], dtype=np.int64) for k in (n, m))
        monkeypatch.setattr(lk, "DENSE", 10**9)
        some = lk.align(doc, item)
        monkeypatch.setattr(lk, "DENSE", -1)
        dense = lk.align(doc, item)
        assert dense == some or lk.is_passage(*some)
    start = time.time()
    monkeypatch.setattr(lk, "DENSE", 20_000)
    assert lk.is_passage(*lk.align(np.zeros(20_000, dtype=np.int64), np.zeros(60, dtype=np.int64)))
    assert time.time() - start < 20


def test_copies_are_one_class(spark):
    """Copies of an item and of a document meet once, whatever their number."""
    docs = spark.range(3_000).selectExpr("id as doc_id", f"'önce {ITEM} sonra' as text")
    items = spark.range(2).selectExpr("id as item_id", f"'{ITEM}' as t").union(spark.range(10, 2_000).selectExpr("id", "concat('x ', id, ' y z')"))
    cand, members, owners = lk.candidate_pairs(docs, "text", "doc_id", items, "t", "item_id")
    assert cand.count() == 1 and members.count() == 3_000 and owners.count() == 2
    assert lk.found(docs, "text", "doc_id", items, "t", "item_id").count() == 6_000


def test_edited_passages_are_found(spark):
    """One word in eight changed, added or left out: all of brute force, few candidates for each."""
    rnd = random.Random(9)
    items = [(k, " ".join(f"söz{rnd.randint(0, 900)}" for _ in range(rnd.randint(16, 40)))) for k in range(60)]
    docs = []
    for d in range(300):
        ws = rnd.choice(items)[1].split()
        at = rnd.randint(0, len(ws) - 16)
        ws = ws[at : at + 16]
        for k in (rnd.randint(1, 7), rnd.randint(8, 14)):
            ws[k : k + 1] = rnd.choice([["başka"], [], [ws[k], "araya"]])
        docs.append((d, " ".join([f"dolgu{rnd.randint(0, 900)}" for _ in range(30)] + ws)))
    di, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, t string")
    want = brute(docs, items)
    assert len(want) >= 300
    assert {tuple(r) for r in lk.found(di, "text", "doc_id", ii, "t", "item_id").collect()} == want
    assert lk.candidate_pairs(di, "text", "doc_id", ii, "t", "item_id")[0].count() <= 3 * len(want)


def brute(docs, items):
    vec = {i: lk.text_hashes(t) for i, t in items if t}
    return {(d, i) for d, t in docs if t for i, v in vec.items() if lk.is_passage(*lk.align(lk.text_hashes(t), v))}


def test_operator_equals_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"söz{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(8, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "kısa")]
    docs = []
    for d in range(60):
        body = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        if d % 2:
            src = rnd.choice(items[:12])[1].split()
            at = rnd.randint(0, max(0, len(src) - 14))
            cut = src[at : at + rnd.randint(5, 25)]
            if len(cut) > 8:
                cut[rnd.randint(1, len(cut) - 2)] = "değişik"
            k = rnd.randint(0, len(body))
            body[k:k] = cut
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "uzun " * 100_000 + items[0][1])]
    di = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id bigint, text string, item_id string")
    ii = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id bigint, t string, doc_id string")
    want = brute(docs, items)
    for bits in (lk.FILTER_BITS, 64):
        got = lk.found(di, "text", "doc_id", ii, "t", "item_id", filter_bits=bits)
        assert got.columns == ["doc_id", "item_id"]
        assert {tuple(r) for r in got.collect()} == want
    assert lk.found(di.limit(0), "text", "doc_id", ii, "t", "item_id").count() == 0
    assert lk.found(di, "text", "doc_id", ii.limit(0), "t", "item_id").count() == 0
