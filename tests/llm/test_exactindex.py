"""Exact duplicates against groups in Python; pages and directories by their invariants."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from motley.llm import exactindex
from motley.llm.exactindex import KEY_BITS, Index, Limits


def said(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def grouped(rows):
    found = defaultdict(list)
    for doc_id, text in rows:
        found[said(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        own = found[said(text)]
        out.append((doc_id, min((x for x in own if x is not None), default=None), len(own), hashlib.sha256(said(text).encode()).hexdigest()))
    return sorted(out, key=repr), len(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(["a", " ", "  ", "\t", "\n ", "é", "b", "\x0b", "\xa0"], k=rng.randrange(7)))) for i in range(1500)]
    rows += [(i + 5000, "a text\tof a third of all rows") for i in range(1000)] + [(6000, "x " * 40_000), (6001, "x " * 40_000 + " "), (6002, "x " * 40_000 + ".")]
    rows += [(None, "some"), (5, None), (7, ""), (None, "null alone"), (None, "a text of a  third of all rows"), (9, "twice"), (9, "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 40])
@pytest.mark.parametrize("limits", [Limits(), Limits(200, 4)])
def test_groups(spark, rows, parts, limits):
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, n int, hash string").repartition(parts)
    got = exactindex.groups(df, limits).collect()
    want, different = grouped(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == different
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exactindex.groups(df.limit(0), limits).count() == 0


def test_pages_hold_their_prefix_and_no_more_than_they_may(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    heap, index = exactindex.build(df, Limits(10_000_000, 8))
    pages = index.where("n is not null").groupBy("page_prefix", "page_depth").agg(F.count_distinct("hash").alias("n"), F.collect_set("hash").alias("hashes"), F.max("directory_depth").alias("d"))
    found = pages.collect()
    assert len(found) > 50
    for r in found:
        assert r["n"] <= 8 and r["page_depth"] <= r["d"]
        assert all(h + (1 << KEY_BITS - 1) >> KEY_BITS - r["page_depth"] == r["page_prefix"] for h in r["hashes"])
    assert index.count() == heap.where("hash is not null").count()


def test_texts_of_one_hash_stand_in_a_chain():
    index = Index(1000, 1)
    least = (False, 1, 1)
    done = [x for key, body in ((5, b"a"), (5, b"b"), (5, b"a"), (6, b"c")) for x in index.put(key, 10 * key + body[0], body, 1, least)] + [*index.rest()]
    chains = {key: [(s.body, s.n) for s in chain] for _, page in done for key, chain in page.chains.items()}
    assert chains == {5: [(b"a", 2), (b"b", 1)], 6: [(b"c", 1)]}
    depths = {page.depth for _, page in done if page.chains}
    assert depths == {KEY_BITS - 1}  # 101 and 110 differ in the last bit but one
    assert sum(2.0 ** -page.depth for _, page in done) == 1.0  # the pages cover all keys


def test_other_documents_are_looked_up(spark, rows):
    heap, index = exactindex.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    asked = spark.createDataFrame([(1, "a text of\n a third of all rows"), (2, "unheard of"), (None, None), (3, "x " * 40_000 + " .")], "doc_id long, text string")
    got = {r["doc_id"]: r["head"] for r in exactindex.matched(asked, heap, index).collect()}
    assert got[1] is not None and got[2] is None and got[None] is not None and got[3] is not None
    bodies = {r["entry"]: r["body"] for r in heap.where("hash is not null").collect()}
    assert bytes(bodies[got[1]]) == b"a text of a third of all rows"
