"""Fill-in-middle against a definition in regular expressions."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from motley.llm import infill

SIGNS = ["a", "B", "P", "S", "M", "<", ">", " ", "é", "🙂", "\n", "1", "<P>", "<S", "ſ", "İ", "z", "K"]


def cut(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    said = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(said[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_outputs_and_what_is_restored(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(SIGNS[: 12 if i % 3 else None], k=rng.randrange(40)))) for i in range(1500)]
    rows += [(None, "abc d"), (None, None), (5, None), (7, ""), (8, "x" * 70_000 + "é, " * 5000), (9, "<" * 300), (9, "<" * 300), (10, "don't <P >")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, form string, n int").repartition(3)
    key = repr
    got = sorted((tuple(r) for r in infill.transformed(df).collect()), key=key)
    assert got == sorted((cut(*r) for r in rows), key=key)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*c[:5], sha(c[5]), sha(t or "")) for c, (_, t) in zip(map(lambda r: cut(*r), rows), rows, strict=True)]
    assert sorted((tuple(r) for r in infill.digests(df).collect()), key=key) == sorted(want, key=key)
    assert infill.digests(df.limit(0)).count() == 0


def test_all_texts_are_cut_or_none(spark):
    df = spark.createDataFrame([(i, "one two three") for i in range(50)], "doc_id long, text string")
    assert {r["form"] for r in infill.transformed(df, cut_percent=0).collect()} == {"plain"}
    assert {r["form"] for r in infill.transformed(df, cut_percent=100, suffix_first_percent=100).collect()} == {"spm"}
    out = infill.transformed(df, cut_percent=100)
    assert out.where(infill.restored(F.col("output"), F.col("form")) != "one two three").count() == 0


def test_events_are_where_the_class_changes():
    begins, sentinel = infill.events("ab, c<P>é d")
    assert begins.tolist() == [0, 2, 4, 5, 6, 7, 10, 11] and sentinel
    assert infill.events("")[0].tolist() == [0] and not infill.events("<P")[1]
    ranks = infill.Ranks("ab, c")
    assert ranks.n == 4 and [ranks.place(x) for x in range(5)] == [0, 2, 3, 4, 5]


def test_many_events_are_taken_in_turns(monkeypatch):
    text = "".join(random.Random(1).choices(SIGNS[:9], k=4000))
    whole = infill.events(text)[0]
    monkeypatch.setattr(infill, "EVENTS", 7)
    assert np.array_equal(infill.events(text)[0], whole)
