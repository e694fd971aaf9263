"""Alignment of two tokenizers against the libraries and a loop over tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from motley.llm import alignment
from motley.llm.common import table, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
PARTS = ["the ", "river", " ran", "  ", "é", "🙂", "\n", "1", "<|endoftext|>", "日本", "▁", "<unk>", "\t", "don't ", "x" * 10, "\0", "<0x41>", " ", "</s>"]


def tokens_of(text, byte_level, pieces, sign):
    """Ids and bytes of both sides."""
    a = byte_level.encode(" " + text, add_special_tokens=False)
    b = pieces.encode(text)
    left = [bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode() for t in a.tokens]
    right = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(pieces.id_to_piece, b), strict=True)]
    return a.ids, left, b, right


def brute(rows):
    byte_level, pieces, sign = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_values()
    byte_level.encode_special_tokens = True
    found, count = [], Counter()
    for doc_id, text in rows:
        groups, a, b = [], [], []
        if text:
            a, left, b, right = tokens_of(text, byte_level, pieces, sign)
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
                place_b = {e: i for i, e in enumerate(ends_b, 1)}
                cuts = [(i, place_b[e]) for i, e in enumerate(ends_a, 1) if e in place_b]
                groups = [(a[p:q], b[r:s]) for (p, r), (q, s) in zip([(0, 0), *cuts], cuts, strict=False)]
            else:
                a, b = [], []
        count.update((g[-1], h[-1]) for g, h in groups)
        found.append((doc_id, a, b, groups))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, a, b, groups in found:
        links = [(g[-1], h[-1]) for g, h in groups]
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(12)))) for i in range(800)]
    return [*rows, (None, "abc d"), (5, None), (7, ""), (8, "the river " * 30_000), (9, "y" * 3000), (9, "y" * 3000)]


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 300])
def test_digests(spark, rows, block):
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, n int, a string").repartition(3)
    assert sorted((tuple(r) for r in alignment.digests(df, A, B, block).collect()), key=repr) == brute(rows)
    assert alignment.digests(df.limit(0), A, B, block).count() == 0


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in alignment.digests(docs, A, B).collect()), key=repr) == want


def test_pair_counts(spark):
    df = spark.createDataFrame([(1, "the the the"), (2, "the")], "doc_id long, text string").repartition(2)
    got = alignment.pair_counts(alignment.aligned(df, A, B)).collect()
    assert [(r["count"], r["best"]) for r in got] == [(4, True)]
    groups = {r["doc_id"]: r["groups"] for r in alignment.aligned(df, A, B).collect()}
    assert groups[1] == ";".join([groups[2]] * 3)


def test_common_ends():
    a, b = alignment.common_ends(np.array([2, 3, 7, 9]), np.array([1, 3, 9]))
    assert a.tolist() == [1, 3] and b.tolist() == [1, 2]
