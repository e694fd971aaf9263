"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over the terms (words and word beginnings) that labelled examples show to go with a label.
The examples with such terms stand in an inverted index whose postings are cut into ranges of examples (blocks), with
the greatest weight of each term in each block. For a text, blocks are visited by the sum of their maxima and left out
once that falls below the k-th cosine, so the k nearest are exact. Their votes, weighted by closeness, are calibrated by a
rising curve: how often examples with such votes of the others have the label. Examples with the very text asked about do
not vote, and equal texts have equal scores; a training row's label does take part in the choice of terms and in the curve.

Terms that go with no label are left out, and with them the examples that have no others: a long text has hundreds of such terms, and
its nearest examples by all words are those of its subject or language, whatever the label (README has the figures). A text without
any of the terms that are left has a constant score, the rate of such examples, and no evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.common import least_hashed, released, stored, text_slices, texts_of

#: The most labelled rows that a model is fitted on: those whose doc_id has the smallest hashes.
EXAMPLES = 10_000
#: A term needs so much chi-square (one degree of freedom) and so many examples.
CHI_SQUARE, SUPPORT = 30.0, 5
#: The least share of a term's examples that have the label it goes with; long texts bring much that is only common.
PURITY = 0.8
BEGINNINGS = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
#: The weight of the base rate beside the votes, which are at most 1 each.
PRIOR_WEIGHT = 0.5
FOLDS = 5
#: Steps of the votes by which the curve is made.
STEPS = 32
WORDS = re.compile(r"[^\W_]+")


class Example(NamedTuple):
    doc_id: int
    toxic: int
    weights: dict[int, float]
    text: int = 0  # hash of its text


class Model(NamedTuple):
    terms: dict[str, int]
    idf: np.ndarray
    doc_ids: np.ndarray
    toxic: np.ndarray
    examples: np.ndarray  # postings, term by term: examples in order
    weights: np.ndarray  # and their weights
    starts: np.ndarray  # terms x (blocks + 1): where a term's postings of a block begin
    maxima: np.ndarray  # terms x blocks
    base: float  # of all examples
    silent: float  # of examples without any term
    heads: frozenset = frozenset()  # the first letters of all terms
    same: dict[int, list[int]] = {}  # examples by the hash of their text
    votes: np.ndarray = np.array([0.0, 1.0])  # the calibrated chance of the label at these shares of votes
    chances: np.ndarray = np.array([0.0, 1.0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def heads_of(terms: dict[str, int]) -> frozenset:
    return frozenset(t[: BEGINNINGS[0]] for t in terms)


def counts_of(text: str, terms: dict[str, int] | None = None, heads: frozenset = frozenset()) -> Counter:
    """Term counts of a text; of the given terms only, by number. Words that begin as no term does are passed over."""
    found: Counter = Counter()
    for word, n in Counter(WORDS.findall(text.lower())).items():
        if heads and word[: BEGINNINGS[0]] not in heads:
            continue
        for term in (word, *(f"{word[:k]}~" for k in BEGINNINGS if len(word) > k)):
            if terms is None:
                found[term] += n
            elif (t := terms.get(term)) is not None:
                found[t] += n
    return found


def weights_of(counts: Counter, idf: np.ndarray) -> dict[int, float]:
    """Unit vector of log-scaled counts times IDF."""
    raw = {t: (1 + math.log(n)) * float(idf[t]) for t, n in sorted(counts.items())}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items()} if norm else {}


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def labelled(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """doc_id, text, toxic of at most `most` labelled doc_ids outside of the held-out fold, written once; of a repeated doc_id the least text."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = least_hashed(known, most, "doc_id")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # at most `most` small rows
    return stored(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "examples")


def associated(examples: DataFrame) -> tuple[list[str], int, int]:
    """The terms that go with a label, of examples with doc_id, text, toxic; examples, toxic examples."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                own = counts_of(text).keys()
                seen.update(own)
                seen[""] += 1
                if label:
                    toxic.update(own)
                    toxic[""] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64()), "bad": pa.array([toxic[t] for t in seen], pa.int64())})

    found = examples.mapInArrow(count, "term string, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = found.where("term = ''").select("n", "bad").first() or (0, 0)
    n, bad = total[0], total[1]
    if not bad or bad == n:
        return [], n, bad
    # chi-square of the table term x label
    a, b = F.col("bad"), F.col("n") - F.col("bad")
    c, d = F.lit(bad) - F.col("bad"), F.lit(n - bad) - (F.col("n") - F.col("bad"))
    chi = F.lit(float(n)) * F.pow(a * d - b * c, 2) / (F.col("n").cast("double") * F.lit(float(bad)) * F.lit(float(n - bad)) * (F.lit(float(n)) - F.col("n")))
    share = F.col("bad") / F.col("n")
    pure = F.when(share > bad / n, share).otherwise(1 - share) >= PURITY
    kept = found.where((F.col("term") != "") & (F.col("n") >= SUPPORT) & (F.col("n") < n) & pure).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE)
    return [r["term"] for r in kept.orderBy(F.desc("chi"), "term").select("term").collect()], n, bad  # of EXAMPLES texts at most


def document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs; documents."""

    heads = heads_of(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for text in texts_of(part.column("text")):
                    total[list(counts_of(text, terms, heads))] += 1
                    total[-1] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(len(total))), "n": pa.array(total)})

    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    out = np.zeros(len(terms) + 1, np.int64)
    for r in found:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def indexed(examples: list[Example], terms: dict[str, int], idf: np.ndarray, base: float, silent: float, block: int = BLOCK) -> Model:
    """The block-max index of the examples that have terms, by doc_id."""
    examples = sorted((e for e in examples if e.weights), key=lambda e: e.doc_id)
    blocks = max(1, -(-len(examples) // block))
    lists: list[list[tuple[int, float]]] = [[] for _ in terms]
    for i, e in enumerate(examples):
        for t, w in e.weights.items():
            lists[t].append((i, w))
    number = np.array([i for x in lists for i, _ in x], np.int64)
    weight = np.array([w for x in lists for _, w in x], float)
    sizes = np.array([len(x) for x in lists], np.int64)
    cell = np.repeat(np.arange(len(terms)), sizes) * blocks + number // block
    starts = np.searchsorted(cell, np.arange(len(terms))[:, None] * blocks + np.arange(blocks + 1))
    maxima = np.zeros(len(terms) * blocks)
    np.maximum.at(maxima, cell, weight)
    maxima = maxima.reshape(len(terms), blocks)
    same: dict[int, list[int]] = {}
    for i, e in enumerate(examples):
        same.setdefault(e.text, []).append(i)
    return Model(terms, idf, np.array([e.doc_id for e in examples], np.int64), np.array([e.toxic for e in examples], np.int64), number, weight, starts, maxima, base, silent, heads_of(terms), same)


def rising(bins: list[tuple[float, int, int]], base: float) -> tuple[np.ndarray, np.ndarray]:
    """(share of votes, chance of the label) of bins (mean share, examples, toxic examples): the nearest rising curve, by joining
    neighbours that fall. A bin counts one example more, of the base rate."""
    joined: list[list[float]] = []  # weight, sum of labels, from, to
    for x, n, bad in sorted(bins):
        joined.append([n + 1, bad + base, x, x])
        while len(joined) > 1 and joined[-2][1] / joined[-2][0] >= joined[-1][1] / joined[-1][0]:
            w, s, _, to = joined.pop()
            joined[-1][0] += w
            joined[-1][1] += s
            joined[-1][3] = to
    points = [(x, s / w) for w, s, a, b in joined for x in ((a, b) if b > a else (a,))]
    return np.array([x for x, _ in points]), np.array([y for _, y in points])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows outside of the held-out fold; document frequencies from all of `docs`, which is read twice."""
    examples = labelled(docs, labels)
    found, n, bad = associated(examples)
    terms = {t: i for i, t in enumerate(found)}
    frequency, total = document_frequencies(docs, terms) if terms else (np.zeros(0, np.int64), 0)
    idf = np.log((1 + total) / (1 + frequency)) + 1e-9

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [counts_of(x, terms) for x in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int64()), pa.array([list(c.keys()) for c in counts], pa.list_(pa.int64())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())), pa.array([text_hash(x) for x in texts_of(batch.column("text"))], pa.int64())], ["doc_id", "toxic", "terms", "counts", "hash"])

    rows = examples.select("doc_id", "text", "toxic").mapInArrow(count, "doc_id long, toxic long, terms array<long>, counts array<long>, hash long").where(F.size("terms") > 0).orderBy("doc_id", "terms", "counts").collect() if terms else []
    known = [Example(r["doc_id"], r["toxic"], weights_of(Counter(dict(zip(r["terms"], r["counts"], strict=True))), idf), r["hash"]) for r in rows]  # EXAMPLES at most
    base = bad / n if n else 0.0
    told = sum(e.toxic for e in known)
    silent = (bad - told + base) / (n - len(known) + 1) if n else 0.0
    model = indexed(known, terms, idf, base, silent)
    step = F.floor(F.col("score") * STEPS)
    votes = scored(examples, model).where(F.size("evidence") > 0).groupBy(step).agg(F.avg("score").alias("x"), F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")) if known else None
    bins = [(r["x"], r["n"], r["bad"]) for r in votes.collect()] if known else []  # a row a step
    if not bins:
        return model
    shares, chances = rising(bins, base)
    return model._replace(votes=shares, chances=chances)


def nearest(model: Model, query: dict[int, float], k: int = NEIGHBOURS, block: int = BLOCK, out: frozenset = frozenset()) -> list[tuple[int, float]]:
    """(example, cosine) of the k nearest with a term in common, but for those in `out`; ties to the smaller doc_id."""
    terms, weights = list(query), np.array(list(query.values()))
    bounds = weights @ model.maxima[terms]
    starts = model.starts[terms]
    best: list[tuple[float, int]] = []
    for b in np.argsort(-bounds, kind="stable"):
        if bounds[b] <= 0 or len(best) == k and bounds[b] < -best[-1][0] - 1e-12:
            break
        first, sizes = starts[:, b], starts[:, b + 1] - starts[:, b]
        at = np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)  # the block's postings, term by term
        scores = np.bincount(model.examples[at] - b * block, model.weights[at] * np.repeat(weights, sizes), block)
        least = -best[-1][0] - 1e-9 if len(best) == k else 0.0
        met = [i for i in np.flatnonzero(scores > max(least, 0.0)).tolist() if b * block + i not in out]
        best = sorted(best + [(-round(float(scores[i]), 12), int(b * block + i)) for i in met])[:k]
    return [(i, -s) for s, i in best]


def score_of(model: Model, counts: Counter, k: int = NEIGHBOURS, out: frozenset = frozenset()) -> tuple[float, list[tuple[int, float, int]]]:
    """A text's score and its evidence: doc_id, cosine and label of its nearest examples, but for those in `out`."""
    query = weights_of(counts, model.idf)
    found = nearest(model, query, k, out=out) if query else []
    if not found:
        return model.silent, []
    votes = np.array([s * s for _, s in found])
    labels = model.toxic[[i for i, _ in found]]
    share = (float(votes @ labels) + PRIOR_WEIGHT * model.base) / (float(votes.sum()) + PRIOR_WEIGHT)
    score = float(np.interp(share, model.votes, model.chances))
    return min(1.0, max(0.0, score)), [(int(model.doc_ids[i]), s, int(model.toxic[i])) for i, s in found]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` (doc_id, text, any others) with score, predicted (1 from 0.5 on) and evidence."""
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for text in texts_of(part.column("text")):
                    counts = counts_of(text, model.terms, model.heads)
                    own = frozenset(model.same.get(text_hash(text), ()) if counts else ())
                    key = (own, *sorted(counts.items()))
                    if key not in known:
                        if len(known) > 5_000:
                            known.clear()
                        known[key] = score_of(model, counts, out=own)
                    rows.append(known[key])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s for s, _ in rows], pa.float64()), pa.array([int(s >= 0.5) for s, _ in rows], pa.int32()), pa.array([[{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in e] for _, e in rows], evidence)], [*names, "score", "predicted", "evidence"])

    return docs.mapInArrow(released(run), f"{kinds}, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row of `docs` (doc_id, text).

    Learns from `labels` (doc_id, toxic) whose crc32 of the doc_id modulo 5 is not 0; nulls there are no labels, a doc_id
    with both labels is toxic. A null or empty text, and any without a known term, gets the rate of such examples. Without
    labels all scores are 0. Only doc_id and text of `docs` are read.
    """
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
