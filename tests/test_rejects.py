import csv
import io
import random

import pyarrow as pa
from leakgauge.operators import rejects as r

GOOD = '12,Ders,blackbox,m-1,"A) x, ""y"""'
CASES = [
    (GOOD, None), (' 7 ,"Ders",choice_sub,m,', None), ('1,D,blackbox,m,"iki\nsatır"', None), ("1,D,blackbox,m,a\nb", None),
    ('1,D,blackbox,m,a "b" c', "broken_quote"), ('1,D,blackbox,m,"açık', "broken_quote"), ('1,"D"x,blackbox,m,r', "broken_quote"), ('1, "D",blackbox,m,r', "broken_quote"),
    ("1,D,blackbox,m", "column_count"), ("1,D,blackbox,m,r,", "column_count"), ("", "column_count"), (None, "column_count"), ("# resumed", "column_count"),
    ("x1,D,blackbox,m,r", "bad_value"), ("1, ,blackbox,m,r", "bad_value"), ("1,D,Blackbox,m,r", "bad_value"), ("１,D,blackbox,m,r", "bad_value"), ("﻿1,D,blackbox,m,r", "bad_value"),
]
SPEND = [
    ("2026-08-01T00:00:00,5,0.1,2,False", None), ("2026-02-29T00:00:00,5,0.1,2,false", "bad_value"), ("2024-02-29T23:59:59,5,0.1,2.0,TRUE", None),
    ("2026-13-01T00:00:00,5,0.1,2,false", "bad_value"), ("2026-01-01T24:00:00,5,0.1,2,false", "bad_value"), ("2026-01-01,5,0.1,2,false", "bad_value"),
    ("2026-01-01T00:00:00,5,.1,2,false", "bad_value"), ("2026-01-01T00:00:00,5,1.,2,false", "bad_value"), ("2026-01-01T00:00:00,5,0.1,inf,false", "bad_value"), ("2026-01-01T00:00:00,5,0.1,2,yes", "bad_value"),
]


def test_reasons():
    for cases, layout in ((CASES, r.PILOT), (SPEND, r.SPEND)):
        got, fields = r.judge(pa.array([t for t, _ in cases], pa.string()), layout)
        assert got == [w for _, w in cases]
        for k, (t, w) in enumerate(cases):
            if w is None:
                assert [f[k].as_py() for f in fields] == next(csv.reader(io.StringIO(t))) or "\n" in t
            else:
                assert all(f[k].as_py() is None for f in fields)


def test_against_csv_module():
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        vals = ["".join(rnd.choice('a,"\nç ') for _ in range(rnd.randint(0, 8))) for _ in range(rnd.choice([4, 5, 5, 6]))]
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(vals)
        rows.append((out.getvalue(), vals))
    free = r.Layout(tuple((f"c{k}", r.is_free) for k in range(5)))
    got, fields = r.judge(pa.array([t for t, _ in rows], pa.string()), free)
    for k, (_, vals) in enumerate(rows):
        assert got[k] == (None if len(vals) == 5 else "column_count")
        if len(vals) == 5:
            assert [f[k].as_py() for f in fields] == vals


def test_operator(spark):
    rows = [(k, t, "z") for k, (t, _) in enumerate(CASES)] + [(99, "1,D,blackbox,m," + "u" * 3_000_000, "z")]
    df = spark.createDataFrame(rows, "line_no int, line_text string, subject string")
    got = {x.line_no: x for x in r.judge_records(df, "line_text", r.PILOT, ["line_no", "subject"]).collect()}
    assert [got[k].reason for k in range(len(CASES))] == [w for _, w in CASES]
    assert got[99].reason is None and len(got[99].raw) == 3_000_000 and got[99].subject == "z" and got[99].field_subject == "D"
    assert r.judge_records(df.limit(0), "line_text", r.PILOT, ["line_no"]).count() == 0
    cells = spark.createDataFrame([(1, "5"), (2, None), (3, " 7 "), (4, "1e3"), (5, "")], "k int, v string")
    assert {x.k for x in r.judge_cells(cells, "v", r.is_digits, ["k"]).where("reason is not null").collect()} == {2, 4, 5}
    clash = r.judge_cells(cells.withColumnRenamed("k", "reason"), "v", r.is_digits, ["reason"])
    assert clash.columns == ["reason", "reject_reason"] and clash.where("reject_reason is not null").count() == 3


def test_slices_bound_the_bytes():
    import pyarrow as pa
    from leakgauge.operators.rejects import slices

    texts = ["a" * 10, None, "b" * 500, "c", "d" * 90, "", "e" * 11]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["k", "t"])
    parts = list(slices(batch, 1, 100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(sum(len(x or "") for x in p.column(1).to_pylist()) <= 100 or len([x for x in p.column(1).to_pylist() if x]) == 1 for p in parts)
    assert [p.num_rows for p in slices(batch, 1, 10**6)] == [7] and not list(slices(batch.slice(7), 1, 5))
