import itertools
import json
import math
import zipfile

import duckdb
import pytest
from leakgauge.functions import letters, lists, stats
from leakgauge.functions import text as tx
from leakgauge.operators import cells, ledger, matching, overlap, prefix, sample
from leakgauge.operators import items as it
from pyspark.sql import functions as F


def exact(a, b):
    n = a + b
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n) if n else 1.0


def test_mcnemar(spark):
    pairs = [(0, 0), (5, 5), (7, 1), (1, 7), (0, 12), (30, 41), (600, 700), (1, 1)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", stats.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(exact(r.a, r.b), abs=1e-9)


def test_wilson(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in spark.createDataFrame([(0, 0), (0, 200), (154, 175), (5, 5)], "k int, n int").select(lo, hi).collect()]
    assert got[:2] == [(0.0, 0.0), (0.0, 0.0188)] and got[3][1] == 1.0
    assert got[2][0] == pytest.approx(0.8235, abs=2e-3)


def test_tokens_and_grams(spark):
    df = spark.createDataFrame([("İstanbul IŞIK",), ("½ ²x",), ("a b c d",), ("",)], "s string")
    t = df.select(tx.word_tokens(F.col("s")).alias("t"))
    assert [r.t for r in t.collect()] == [["i", "stanbul", "işik"], ["½", "²x"], ["a", "b", "c", "d"], []]
    assert [r[0] for r in t.select(F.size(tx.gram_keys(F.col("t"), 3))).collect()] == [1, 0, 2, 0]
    g = spark.createDataFrame([("abcdefgh", "xabcdefghx"), ("denetim", "denetim")], "t string, o string")
    got = g.select(tx.coverage(tx.char_grams(F.col("t"), 8), tx.char_grams(F.col("o"), 8)).alias("c")).collect()
    assert [r.c for r in got] == [1.0, 0.0]


def test_letters(spark):
    rows = [("B) foo",), ("Cevap: C",), ("",), (None,), ("This is a test",), ("d",), ("Answer (E)",), ("ça) x b",)]
    df = spark.createDataFrame(rows, "raw string")
    mode = lambda m: [r[0] for r in df.select(letters.parse_letter(F.col("raw"), m)).collect()]
    assert mode("core") == ["B", "C", None, None, "A", "D", "E", "B"]
    assert mode("pilot") == ["B", "C", None, None, None, "D", "E", None]
    assert mode("scale3arm")[6] == "E"


def test_lists(spark):
    df = spark.createDataFrame([('["a, b", "c"]',), ("['a, b', 'c']",), ("a, b",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(lists.tolerant_list("s"), lists.literal_list("s"), lists.naive_list(F.coalesce("s", F.lit("")))).collect()]
    assert got[0][0] == ["a, b", "c"] and got[1][1] == ["a, b", "c"] and got[1][2] == ["a", "b", "c"]
    assert got[2] == (["a", "b"],) * 3 and got[3] == got[4] == ([],) * 3


@pytest.mark.parametrize(
    "gold,pred,want",
    [
        ("", "x", "empty"), ("a. foo", "b. bar", "letter"), ("a. foo", "bar", "letter-mismatch"), ("10 Kasım", "9 Kasım", "number-mismatch"),
        ("1950ler", "1953", "none"), ("1950ler", "1961", "number-mismatch"), ("kısa yol", "x" * 40 + " kısa yol", "containment-thin"),
        ("uzun bir yol", "uzun bir yol vardır", "containment"), ("Aynı", "aynı", "exact"), (None, None, "empty"),
    ],
)
def test_matcher(spark, gold, pred, want):
    df = spark.createDataFrame([(gold, pred)], "g string, p string")
    assert matching.features(df, "g", "p").select(matching.level()).first()[0] == want


def test_ledger(spark):
    rows = [(1, "a", 1, True, 5), (2, "a", 1, False, None), (3, "b", 1, True, 7), (4, "a", 1, True, 9), (5, None, None, False, 1)]
    df = spark.createDataFrame(rows, "line_no bigint, model string, i int, ok boolean, tokens int")
    last = {(r.model, r.i): r.line_no for r in ledger.last_wins(df, ["model", "i"], "line_no").collect()}
    assert last == {("a", 1): 4, ("b", 1): 3, (None, None): 5}
    before = {r.line_no: r.failed_before for r in ledger.recurring(df, ["model", "i"], "line_no", ~F.col("ok")).collect()}
    assert before == {1: False, 2: False, 3: False, 4: True, 5: False}
    chk = ledger.checkpoints(df, "line_no", F.col("tokens"), 2).collect()
    assert sorted(tuple(r) for r in chk) == [(2, 5), (4, 12)]
    assert ledger.last_wins(df.limit(0), ["i"], "line_no").count() == 0


def test_running_total(spark):
    df = spark.range(0, 500, 3).withColumn("v", F.col("id") % 7)
    got = {r.id: r.s for r in prefix.running_total(df, "id", F.col("v"), "s", width=16).collect()}
    want = dict(zip(range(0, 500, 3), itertools.accumulate(k % 7 for k in range(0, 500, 3))))
    assert got == want


def test_overlap_paths_agree(spark):
    words = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:13])), (2, " ".join(words[:12])), (3, None), (4, " ".join(words[20:40]))], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[:14])), (2, None), (3, " ".join(words[21:36]))], "doc_id int, text string")
    got = {r.item_id: (r.grams, r.matched, r.hit) for r in overlap.overlap_by_item(items, "item_id", "text", docs, "text").collect()}
    assert got == {1: (1, 1, True), 2: (0, 0, False), 3: (0, 0, False), 4: (8, 3, True)}
    own = overlap.item_grams(items, "item_id", "text")
    a = {r.gram for r in overlap.corpus_hits(docs, "text", own).collect()}
    assert a == {r.gram for r in overlap.corpus_hits(docs, "text", own, broadcast_keys=0).collect()}
    kept = {r.doc_id: r.kept for r in overlap.capped_grams(docs, "doc_id", "text", 4).collect()}
    assert kept == {1: 3, 2: 0, 3: 1}


def test_items(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), ("b", 5, "z"), ("c", 1, "k")], "bench string, id int, ans string")
    got = {(r.bench, r.id): r.planted for r in it.next_answer(df, "bench", "id", "ans").collect()}
    assert got == {("b", 1): "y", ("b", 2): "z", ("b", 5): "x", ("c", 1): "k"}
    p = spark.createDataFrame([(["a", "b", "c"], "a", "q"), (["a"], "a", "q"), (["a", "b"], "a", "a")], "c array<string>, ok string, other string")
    rows = p.select(*it.plant(F.col("c"), F.col("ok"), F.col("other"))).collect()
    assert [tuple(r) for r in rows] == [(["a", "q", "c"], "B"), (None, None), (None, None)]
    assert [tuple(r) for r in sample.twister_sample(spark, 5, 9).collect()].__len__() == 5


def test_consensus(spark):
    rows = [(0.9, 0.9, 0.1, 0.5, 0.7, 0.01), (0.1, 0.1, 0.9, 0.5, 0.7, 0.01), (0.9, 0.9, 0.9, 0.9, 0.9, 0.5), (None,) * 6]
    df = spark.createDataFrame(rows, "mean_overlap8 double, verbatim_rate double, flip_rate double, b_acc double, c_acc double, min_p double")
    got = [r.adjudication[:5] for r in cells.consensus(df).collect()]
    assert got == ["THRES", "CONTA", "no si", "no si"]


def test_sources(spark, tmp_path):
    from leakgauge.sources import client, readers, sinks

    p = tmp_path / "log.jsonl"
    good = {"ts": "t", "model": "m", "ok": True, "usage_api": {"prompt_tokens": 3, "prompt_tokens_details": {"cached_tokens": 1}}}
    p.write_text(json.dumps(good) + "\n\n" + json.dumps({"event": "run_start"}) + "\n" + '{"model": "m", "ok": tr', encoding="utf-8")
    calls, events, bad = readers.ledger(spark, str(p))
    assert (calls.count(), events.count(), bad.count()) == (1, 1, 1)
    assert calls.select("usage_api.prompt_tokens_details.cached_tokens").first()[0] == 1

    c = tmp_path / "items.csv"
    c.write_text('source,question,answer,category,qid,edited_answer,label\nx," iki\nsatır ",,,,,\n', encoding="utf-8")
    row = readers.csv_items(spark, str(c)).first()
    assert row.question == "iki\nsatır" and row.answer == ""

    d = tmp_path / "art"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"questions": {"items": [{"question": "q1", "answer": "a1", "category": "k"}]}}))
    (d / "b.json").write_text(json.dumps({"questions": "{'items': [{'question': 'q2', 'answer': 'a2', 'category': 'k'}]}"}))
    (d / "c.json").write_text("{broken")
    assert sorted(r.question for r in readers.articles(spark, str(d)).collect()) == ["q1", "q2"]
    assert readers.articles(spark, str(d), readers.sample_files(spark, str(d), 1)).count() <= 1

    w = tmp_path / "w.xml"
    w.write_text(
        "<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><text xml:space='preserve'>metin</text></revision></page>"
        "<page><title>B</title><ns>0</ns><id>2</id><redirect title='A'/><revision><text xml:space='preserve'>#REDIRECT [[A]]</text></revision></page>"
        "<page><title>C</title><ns>1</ns><id>3</id><revision><text xml:space='preserve'>x</text></revision></page></mediawiki>"
    )
    pages, meta = readers.encyclopedia(spark, str(w))
    assert [r.title for r in pages.collect()] == ["A"]
    assert tuple(meta.first())[:4] == (3, 1, 1, 1) and not meta.first().truncated
    some, told = readers.encyclopedia(spark, str(w), most=0)
    assert some.count() == 0 and told.first().truncated

    class Echo:
        def answer(self, model, prompt):
            if prompt == "!":
                raise TimeoutError("timed out")
            return prompt

    got = client.answered(spark.createDataFrame([("m", "x"), ("m", "!")], "model string, prompt string"), Echo()).collect()
    assert [(r.raw, r.ok, r.error) for r in got] == [("x", True, None), (None, False, "timed out")]
    sinks.append_jsonl(calls, str(tmp_path / "out"))
    sinks.append_jsonl(calls, str(tmp_path / "out"))
    assert spark.read.schema("model string").json(str(tmp_path / "out")).count() == 2
    assert "| m |" in sinks.markdown(spark.createDataFrame([("m", 0.0001)], "model string, p_raw double"), "T") and "<0.001" in sinks.markdown(spark.createDataFrame([("m", 0.0001)], "model string, p_raw double"), "T")


def test_streaming(spark, tmp_path):
    from leakgauge.streaming import ledger_stream as ls

    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.7), (3, "b", None)], "line_no bigint, model string, cost double")
    df.write.parquet(str(tmp_path / "log"))
    log = ls.log_stream(spark, str(tmp_path / "log"), df.schema)
    q = ls.keep_last(log, ["model"], "line_no", str(tmp_path / "kept"), str(tmp_path / "chk"))
    q.awaitTermination()
    assert sorted(r.line_no for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [2, 3]
    spark.createDataFrame([(4, "b", 1.0), (5, "c", None)], "line_no bigint, model string, cost double").write.mode("append").parquet(str(tmp_path / "log"))
    for _ in range(2):  # the second run finds nothing new
        ls.keep_last(log, ["model"], "line_no", str(tmp_path / "kept"), str(tmp_path / "chk")).awaitTermination()
        assert sorted(r.line_no for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [2, 4, 5]
    spent = ls.run_to_end(ls.running_spend(log, "model", "cost", 1.0), "lg_spent", "update")
    assert {r.model: (r.calls, r.over_cap) for r in spent.collect()} == {"a": (2, True), "b": (2, False), "c": (1, False)}


SF = "/root/testdata/sf0.001"


def _norm(v):
    return None if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def test_queries_match_sql(spark):
    import glob
    import os

    from leakgauge.plans import registry

    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted([[_norm(r[c]) for c in cols] for r in df.collect()], key=str)
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols, name
        want = sorted([[_norm(r[names.index(c)]) for c in cols] for r in cur.fetchall()], key=str)
        assert got == want, name


def test_flip_cell(spark):
    """Follows of the plant among ok calls; an unreadable answer is a wrong one."""
    rows = [(True, True, False, True, True), (True, False, True, True, True), (True, False, False, True, True), (True, False, True, True, False), (False, False, False, True, True), (True, True, False, False, False)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, ok boolean, f boolean, c boolean, bo boolean, bc boolean")
    got = cells.flip_columns(df.groupBy("model").agg(*cells.flip_aggs(*[F.col(x) for x in ("ok", "f", "c", "bo", "bc")]))).first()
    assert (got.n_flip, got.flip_follows, got.flip_follow_rate, got.pos, got.neg, got.n_pairs, got.p_raw) == (5, 2, 0.4, 2, 1, 3, 1.0)
    none = cells.flip_columns(df.where("not ok").groupBy("model").agg(*cells.flip_aggs(*[F.col(x) for x in ("ok", "f", "c", "bo", "bc")]))).first()
    assert (none.n_flip, none.flip_follow_rate, none.p_raw) == (0, None, 1.0)


def test_matched_arms(spark):
    rows = [("m", True, True, False), ("m", False, True, True), ("m", None, True, True), ("k", None, None, True)]
    got = cells.matched_arms(spark.createDataFrame(rows, "model string, A boolean, B boolean, C boolean"), ["model"], ["A", "B", "C"]).collect()
    assert [(r.model, r.matched_n, r.A_acc, r.B_acc, r.C_acc, r.B_vs_A_pos, r.B_vs_A_neg) for r in got] == [("m", 2, 0.5, 1.0, 0.5, 0, 1)]


def test_following_equals_the_window(spark):
    ids = [5, 9, 200_000, 70_000, 1, 131_072]
    df = spark.createDataFrame([(k, f"v{k}") for k in ids], "id bigint, v string")
    got = {r.id: r.nxt for r in it.following(df, "id", "v", "nxt").collect()}
    order = sorted(ids)
    assert got == {a: f"v{b}" for a, b in zip(order, order[1:] + order[:1])}
    assert it.following(df.limit(0), "id", "v", "nxt").count() == 0


def test_true_index(spark):
    df = spark.createDataFrame([(2, "A"), (7, " b"), (None, "E"), (-1, "F"), (None, None), (0, None)], "s int, l string")
    assert [r[0] for r in df.select(it.true_index(F.col("s"), F.col("l"), F.lit(5))).collect()] == [2, 1, 4, None, None, 0]
    blank = spark.createDataFrame([([" a ", "", "b", None],)], "c array<string>").select(it.choices_body(F.col("c"))).first()[0]
    assert blank == "a b"


def test_lookups_and_run_events(spark):
    cache = spark.createDataFrame([(1, 5, "old", "x"), (1, 9, "new", "y"), (2, 7, None, "z")], "i int, line_no int, en string, tr string")
    got = {r.i: (r.en, r.tr, r.cached) for r in ledger.looked_up(spark.createDataFrame([(1,), (2,), (3,)], "i int"), cache, ["i"], "line_no", ["en", "tr"]).collect()}
    assert got == {1: ("old", "x", True), 2: (None, None, False), 3: (None, None, False)}
    events = spark.createDataFrame([("run_start",), ("run_start",), ("run_end",), (None,)], "event string")
    assert tuple(ledger.run_events(events).first()) == (2, 1, True)
    assert tuple(ledger.run_events(events.limit(0)).first()) == (0, 0, False)


def test_list_scalars(spark):
    df = spark.createDataFrame([("true",), ("null",), ("[1, 2.5]",), ("('a',)",), ("{'a': 1}",), ("[a, 'b, c']",), ("['', x]",), ("[]",)], "s string")
    got = [r[0] for r in df.select(lists.tolerant_list("s")).collect()]
    assert got == [["True"], ["None"], ["1", "2.5"], ["a"], ["{'a': 1}"], ["a", "b", "c"], ["", "x"], []]
    assert [r[0] for r in df.select(lists.literal_list("s")).collect()][0] == ["true"]


def test_coin_depends_on_the_position_only(spark):
    import random

    got = {r.k: r.c for r in spark.createDataFrame([(0,), (7,), (10**10,), (None,)], "k bigint").withColumn("c", sample.coin("k")).collect()}
    assert got == {k: random.Random(42 + k).random() < 0.5 for k in (0, 7, 10**10)} | {None: None}


def test_more_sources(spark, tmp_path):
    from leakgauge.sources import readers, sinks

    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(str(tmp_path / "dev"))
    spark.createDataFrame([(2, "b", 0.5)], "id int, x string, more double").write.parquet(str(tmp_path / "test"))
    both = readers.parquet_splits(spark, [str(tmp_path / "dev"), str(tmp_path / "test")])
    assert sorted((r.id, r.more) for r in both.collect()) == [(1, None), (2, 0.5)]

    df = spark.createDataFrame([("x", ["a", "b"]), ("x", ["c"]), ("y", [])], "bench string, choices array<string>")
    manifest = sinks.csv_with_manifest(df, str(tmp_path / "csv"), "bench")
    assert {r.bench: r["items"] for r in manifest.collect()} == {"x": 2, "y": 1}
    assert {json.loads(r.choices)[0] for r in spark.read.csv(str(tmp_path / "csv/bench=x"), header=True, escape='"').collect()} == {"a", "c"}

    docs = spark.createDataFrame([("a",), (" ",), (None,), ("b",)], "t string").coalesce(1)
    assert [r.t for r in readers.capped_corpus(docs, "t", 3).collect()] == ["a"]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Question</t></si><si><t>Answer</t></si><si><r><t>ne</t></r><r><t>den?</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>4.5</v></c></row>'
                   '<row><c r="B3" t="inlineStr"><is><t>yok</t></is></c></row></sheetData></worksheet>')  # fmt: skip
    book = readers.xlsx(spark, str(tmp_path / "book.xlsx"), "Answer string, Question string")
    assert [tuple(r) for r in book.collect()] == [("4.5", "neden?"), ("yok", None)]


def test_spread_looks_at_the_scan_only(spark, tmp_path):
    from leakgauge.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    small = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(small.where("id > 3")).rdd.getNumPartitions() >= cores
    spark.range(100).repartition(2 * cores).write.parquet(str(tmp_path / "many"))
    many = spread(spark.read.parquet(str(tmp_path / "many")))
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    assert spread(spark.createDataFrame([(1,)], "a int")).count() == 1


def test_capped_build_reads_no_further(spark, monkeypatch):
    docs = spark.range(50).selectExpr("id * 3 as doc_id", "concat_ws(' ', transform(sequence(0, 15), x -> concat('w', id, '_', x))) as text")
    want = {r.doc_id: r.kept for r in overlap.capped_grams(docs, "doc_id", "text", 21).collect()}
    reach = overlap._reach
    monkeypatch.setattr(overlap, "_reach", lambda *a: reach(*a, first=2))
    assert overlap._reach(docs, "doc_id", "text", 21, 13) == 32
    assert {r.doc_id: r.kept for r in overlap.capped_grams(docs, "doc_id", "text", 21).collect()} == want
    assert overlap.capped_keys(docs, "doc_id", "text", 21).count() == 21 and overlap._reach(docs.limit(0), "doc_id", "text", 1, 13) is None


def test_shuffled_order(spark):
    import random

    got = {(r.k, r.n): r.o for r in spark.createDataFrame([(0, 4), (9, 30), (9, 0), (None, 2)], "k bigint, n int").withColumn("o", sample.shuffled("k", F.col("n"))).collect()}
    for (k, n), order in got.items():
        want = None
        if k is not None:
            want = list(range(n))
            random.Random(42 + k).shuffle(want)
        assert order == want
