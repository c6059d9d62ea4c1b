import random

import pyarrow as pa
import pytest
from leakgauge.llm import tokens as tk

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def reference(texts):
    e = tk.encoder(tk.default_vocabulary())
    return [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_exact_on_hostile_text():
    rnd = random.Random(4)
    abc = "aAbçşé '\n\t 　👩‍🔬.,;:!?\"<|endoftext|>'sD'll\r012½²\u0085я問題’\x1c ᠎"
    texts = ["".join(rnd.choice(abc) for _ in range(rnd.randint(0, 50))) for _ in range(4000)] + [None, "", "<|endoftext|>", " " * 999, "a" * 50_000]
    assert tk.encoder(tk.default_vocabulary()).encode(pa.array(texts, pa.string())).to_pylist() == reference(texts)


def test_cuts_are_outside_tokens():
    inside = tk.joined_pairs([b"ab", b"bcd"])
    assert inside[97, 98] and inside[98, 99] and not inside[97, 99] and not inside[98, 98]


def test_operator(spark):
    texts = ["Bir sınav.", None, "", "Bir sınav.", "x" * 200_000]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tk.token_ids(df, "text", ["doc_id"]).collect()}
    assert [got[k] for k in range(len(texts))] == reference(texts) and got[1] == got[2] == []
    assert tk.token_ids(df.limit(0), "text", ["doc_id"]).count() == 0
    both = tk.token_ids(df, "text", ["ids"], out="n").columns
    assert both == ["ids", "n"]
