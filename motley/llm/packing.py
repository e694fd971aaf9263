"""Best-fit packing of tokenised documents into sequences, by the linear grouping scheme.

Lengths are whole numbers from 1 to the sequence length, so their counts are a table of bounded size
whatever the corpus. The driver plans on these counts alone; executors then look up each piece's place.

1. Large lengths (over a part of the sequence) are ranked downwards and cut into groups of equal
   cardinality; each is rounded up to its group's greatest.
2. Configurations of these few sizes are chosen: each takes the greatest size left and the fullest set of
   other sizes beside it (a subset-sum over the sizes), as often as the sizes last.
3. The actual pieces take the places of the rounded ones, and what is really left in each sequence is counted.
4. Small pieces go, longest first, to the sequences where least is left over.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motley.llm.common import partitions, released, stored, text_slices
from motley.llm.wordcache import CACHE_WORDS, word_encoder

SEQUENCE = 2048
END_ID = 0
#: Pieces over this part of a sequence count as large.
LARGE_PART = 1 / 16
#: Groups of equal cardinality among the large.
GROUPS = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences but for the first, which may be shorter."""
    first = (n - 1) % most + 1
    return [(0, first), *((s, most) for s in range(first, n, most))]


def pieces(docs: DataFrame, tokenizer: str, most: int = SEQUENCE, end_id: int = END_ID, words: int = CACHE_WORDS) -> DataFrame:
    """A row per piece of each document's ids (the tokenizer's, then the end id). A null or empty text is the end id alone."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, words)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, bounds = encoder.encode(part.column("text"), end_id)
                held, rows = memoryview(ids.astype("<u4", copy=False)).cast("B"), defaultdict(list)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for i, (start, length) in enumerate(cut_lengths(b - a, most)):
                        at = 4 * (a + start)
                        for k, v in zip(("doc_id", "piece", "start", "length", "ids_crc32"), (doc, i, start, length, zlib.crc32(held[at : at + 4 * length])), strict=True):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rows["doc_id"], pa.int64()), "piece": pa.array(rows["piece"], pa.int32()), **{k: pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")}})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(encode), PIECES)


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded length, pieces) of each group of equal cardinality, longest first."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out, seen = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = each - seen % each
            if seen % each == 0:
                out.append([length, 0])
            took = min(room, left)
            out[-1][1] += took
            seen, left = seen + took, left - took
    return [tuple(x) for x in out]


def configurations(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times used, [(size index, pieces of it in the sequence)]) until the sizes are used up."""
    left = [n for _, n in sizes]
    out = []
    for head in range(len(sizes)):
        while left[head]:
            room = most - sizes[head][0]
            steps, reach, mask = [], 1, (1 << (room + 1)) - 1
            for j in range(head, len(sizes)):
                s = sizes[j][0]
                have = min(left[j] - (j == head), room // s)
                for _ in range(have):
                    grown = (reach | reach << s) & mask
                    if grown == reach:
                        break
                    steps.append((j, reach))
                    reach = grown
                if reach >> room & 1:
                    break
            at, used = reach.bit_length() - 1, defaultdict(int, {head: 1})
            for j, before in reversed(steps):
                if not before >> at & 1:
                    used[j] += 1
                    at -= sizes[j][0]
            times = min(left[j] // k for j, k in used.items())
            for j, k in used.items():
                left[j] -= k * times
            out.append((times, sorted(used.items())))
    return out


def small_places(residuals: dict[int, int], smalls: dict[int, int], most: int, opened: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, per sequence, residual class, first sequence of the class) of best-fit places,
    longest length first; class 0 holds new sequences, numbered from `opened`."""
    runs = defaultdict(list)  # what is left now -> [(class, first, sequences)]
    for r, n in residuals.items():
        if r:
            runs[r].append((r, 0, n))
    lefts = sorted(runs)
    out = []

    def put(now: int, run: tuple[int, int, int]) -> None:
        if now and run[2]:
            if not runs[now]:
                insort(lefts, now)
            runs[now].append(run)

    for length in sorted(smalls, reverse=True):
        rank, n = 0, smalls[length]
        while n:
            at = bisect_left(lefts, length)
            if at == len(lefts):
                k = -(-n // (most // length))
                put(most, (0, opened, k))
                opened += k
                continue
            now = lefts[at]
            kind, first, have = runs[now].pop()
            if not runs[now]:
                del lefts[at]
            each = min(now // length, -(-n // have))
            full = min(n // each, have)
            if not full:
                each, full = n, 1
            out.append((length, rank, full * each, each, kind, first))
            rank, n = rank + full * each, n - full * each
            put(now - each * length, (kind, first, full))
            put(now, (kind, first + full, have - full))
    return out


def ranked(df: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """A rank from 0 within each key, dealt over buckets so that no key lands in one task. Keys and buckets are few."""
    n = partitions(df.sparkSession)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(n)))
    counts = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*by))
    return df.withColumn("_own", own).join(counts, [key, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_bucket", "_own", "_before")


def looked_up(pieces: DataFrame, places: list[tuple], names: str) -> DataFrame:
    """pieces (length, rank, ...) with the columns `names` of the place whose ranks hold theirs. `places`: (length, first rank, end, ...), in
    each length without overlap.

    Ranks of a length are cut into as many buckets as it has places, so a piece meets few of them, however many pieces have its
    length. Places are fewer than configurations have sizes, some 16,000; buckets at most double them.
    """
    spark, by_length = pieces.sparkSession, defaultdict(list)
    for place in places:
        by_length[place[0]].append(place)
    widths = {length: -(-max(p[2] for p in own) // len(own)) for length, own in by_length.items()}
    rows = [(p[0], b, *p[1:]) for p in places for b in range(p[1] // widths[p[0]], (p[2] - 1) // widths[p[0]] + 1)]
    known = F.broadcast(spark.createDataFrame(list(widths.items()), "length long, _width long"))
    table = F.broadcast(spark.createDataFrame(rows, f"length long, _bucket long, _a long, _b long, {names}"))
    met = pieces.join(known, "length").withColumn("_bucket", F.expr("rank div _width")).join(table, ["length", "_bucket"])
    return met.where("rank >= _a and rank < _b").drop("_bucket", "_width")


def pack(pieces: DataFrame, most: int = SEQUENCE, large_part: float = LARGE_PART, groups: int = GROUPS) -> DataFrame:
    """pieces with sequence_id and offset: no sequence over `most`, offsets gapless from 0.

    `pieces` needs doc_id, piece and length (1 to most); repeated rows are pieces of their own.
    """
    pieces = stored(pieces, "unranked")  # else the texts are encoded twice
    keyed = stored(ranked(pieces, "length", [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns], "rank"), "pieces")
    counts = {r["length"]: r["n"] for r in keyed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `most` rows
    whole = counts.pop(most, 0)
    cut = max(1, int(most * large_part))
    larges, smalls = {k: n for k, n in counts.items() if k > cut}, {k: n for k, n in counts.items() if k <= cut}
    sizes = group_sizes(larges, groups)
    plan = configurations(sizes, most)

    # The places of each group's pieces, then of each length's: (length, first rank, end, first sequence, per sequence, slot).
    spans, sequence, taken = defaultdict(list), whole, [0] * len(sizes)
    for times, used in plan:
        for slot, (j, k) in enumerate(used):
            spans[j].append((taken[j], taken[j] + k * times, sequence, k, slot))
            taken[j] += k * times
        sequence += times
    places, ends = [], np.cumsum([n for _, n in sizes])
    longest, first = sorted(larges, reverse=True), 0
    starts = {}
    for length in longest:
        starts[length], first = first, first + larges[length]
    order = iter(longest)
    length = next(order, None)
    for j, (_, n) in enumerate(sizes):
        base = int(ends[j]) - n
        for a, b, seq, k, slot in sorted(spans[j]):
            at, stop = base + a, base + b
            while at < stop:
                while at >= starts[length] + larges[length]:
                    length = next(order)
                upto = min(stop, starts[length] + larges[length])
                # of the ranks [at, upto): rank r lies in sequence seq + (r - base - a) // k
                places.append((length, at - starts[length], upto - starts[length], seq, at - base - a, k, slot))
                at = upto
    large = looked_up(keyed.where((F.col("length") > cut) & (F.col("length") < most)), places, "_seq long, _skip long, _each long, _slot int")
    large = large.withColumn("sequence_id", F.expr("_seq + (rank - _a + _skip) div _each")).drop("_a", "_b", "_seq", "_skip", "_each")
    full = keyed.where(F.col("length") == most).withColumns({"sequence_id": F.col("rank"), "_slot": F.lit(0)})

    # What is really left in each sequence, then the small pieces.
    room = large.groupBy("sequence_id").agg((F.lit(most) - F.sum("length")).alias("left"))
    room = stored(ranked(room, "left", ["sequence_id"], "nth"), "room")
    residuals = {r["left"]: r["n"] for r in room.groupBy("left").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `most` rows
    found = small_places(residuals, smalls, most, sequence)
    small = looked_up(keyed.where(F.col("length") <= cut), [(ln, a, a + n, k, r, s) for ln, a, n, k, r, s in found], "_each long, left long, _first long")
    small = small.withColumn("nth", F.expr("_first + (rank - _a) div _each")).drop("_a", "_b", "_each", "_first")
    new = small.where("left = 0").withColumn("sequence_id", F.col("nth"))
    old = small.where("left > 0").join(room, ["left", "nth"])
    small = old.unionByName(new).drop("nth", "left").withColumn("_slot", F.lit(most))

    placed = large.unionByName(full).unionByName(small)
    before = Window.partitionBy("sequence_id").orderBy("_slot", F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_slot", "rank")


def pack_documents(docs: DataFrame, tokenizer: str, most: int = SEQUENCE, words: int = CACHE_WORDS) -> DataFrame:
    """Every document of `docs` (doc_id, text) packed; other columns play no part. An empty table gives no rows. A worker keeps the ids
    of `words` words in memory, twice."""
    return pack(pieces(docs, tokenizer, most, words=words), most)
