"""Each stage of the pipeline on a small corpus with planted cases, and the whole of it."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402

PASSAGE = " ".join(f"shared{i}" for i in range(60))


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        rows.append((i, prose(80, i) + (" vermin vermin" if bad else ""), "en", f"s{i % 3}", 0, "x", 1))
        labels.append((i, int(bad)))
    rows += [(300, rows[1][1], "en", "s0", 0, "x", 1), (301, rows[2][1].replace(" ", " new ", 1), "en", "s0", 0, "x", 1)]
    rows += [(302, prose(50, 900) + " " + PASSAGE, "en", "s0", 0, "x", 1), (303, PASSAGE + " " + prose(50, 901), "en", "s0", 0, "x", 1)]
    rows += [(304, prose(40, 902) + " password=0123456789abcdefgh " + prose(9, 903), "en", "s0", 0, "x", 1), (305, None, None, None, None, None, None), (305, None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, _spans string, sid int"
    spark.createDataFrame(rows, names).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeats", "secrets", "packing"]
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and sorted(r[0] for r in clean.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect() if not (r[0] < 200 and r[0] % 5 == 0))
    once = stages["near_duplicates"](spark, clean, sf_dir)
    ids = sorted(r[0] for r in once.select("doc_id").collect())
    assert once.columns == docs.columns and 300 not in ids and 301 not in ids and ids.count(305) == 1 and {1, 2, 302, 303, 304} <= set(ids)
    cut = stages["repeats"](spark, once, sf_dir)
    texts = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == docs.columns and "shared5" in texts[302]["text"] and "shared5 " not in texts[303]["text"] and texts[303]["n_chars"] == len(texts[303]["text"])
    hidden = stages["secrets"](spark, cut, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert hidden.columns == docs.columns and "[SECRET]" in texts[304] and not re.search("password", texts[304]) and texts[1] == prose(80, 1)
    packed = stages["packing"](spark, hidden, sf_dir)
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
