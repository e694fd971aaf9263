"""Document fingerprints: improbable features in chained Bloom filters.

Every window of 32 bytes has an entropy. How rare each entropy is among all windows of the corpus ranks the
windows; in each run of 32 neighbouring windows the rarest one (the first of equals) earns a point, and windows
with enough points are features. A document's features enter, in order, a chain of Bloom filters; two digests
are alike as far as their filters share more bits than chance would have it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import in_order, mixed, text_slices, texts_of

WINDOW = 32
NEIGHBOURS = 32
#: Points that make a window a feature.
POINTS = 8
FILTER_BITS = 2048
HASHES = 5
#: Features of one filter; then the next one is begun.
FILTER_FEATURES = 128
#: Windows of less entropy (in bits, of at most 5) say nothing about a text: runs of one sign, rules, blanks.
LEAST_ENTROPY = 1.5
#: Own windows of a piece of a long text, zeros between pieces, bytes worked on at once (below 2^18).
STRIDE = 1 << 17
GAP = WINDOW + NEIGHBOURS
BUFFER = 240_000
SCALE = 64  # entropies are whole numbers of 1/64 of c * log2(c) sums

_C = np.arange(1, WINDOW + 2)
#: What the c-th equal byte of a window adds to its sum of c * log2(c).
GAIN = np.rint(SCALE * _C * np.log2(_C)).astype(np.int32)
GAIN = np.concatenate(([0], np.diff(GAIN, prepend=0)))
#: The sum is WINDOW * (log2(WINDOW) - entropy).
HIGHEST = int(SCALE * WINDOW * (np.log2(WINDOW) - LEAST_ENTROPY))
NEVER = (1 << 14) - 1
CLASSES = int(SCALE * WINDOW * np.log2(WINDOW)) + 2


def window_sums(data: np.ndarray) -> np.ndarray:
    """The sum of c * log2(c) over the byte counts of each window, in 1/SCALE."""
    n = len(data) - WINDOW + 1
    ahead, behind = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    out = np.empty(n, np.int32)
    counts = np.bincount(data[:WINDOW], minlength=256)
    out[0] = sum(int(GAIN[1 : c + 1].sum()) for c in counts if c)
    np.cumsum(GAIN[behind[WINDOW:]] - GAIN[ahead[: n - 1]], out=out[1:])
    out[1:] += out[0]
    return out


def buffers(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """The texts of at least a window, one after another with gaps, in buffers of bounded size: bytes, and for each piece of a
    text its number and where its own windows, and all its windows, begin and end in the buffer. A long text is cut in pieces with the neighbours of
    their own windows on both sides."""
    held, size, spans = [], 0, []
    for number, blob in enumerate(blobs):
        windows = len(blob) - WINDOW + 1
        for first in range(0, max(0, windows), STRIDE):
            low, high = max(0, first - NEIGHBOURS + 1), min(windows, first + STRIDE + NEIGHBOURS - 1)
            part = blob[low : high + WINDOW - 1]
            if held and size + len(part) + GAP > BUFFER:
                yield (np.frombuffer(b"".join(held), np.uint8), *np.array(spans).T)
                held, size, spans = [], 0, []
            spans.append((number, size + first - low, size + min(windows, first + STRIDE) - low, size, size + high - low))
            held += [part, bytes(GAP)]
            size += len(part) + GAP
    if held:
        yield (np.frombuffer(b"".join(held), np.uint8), *np.array(spans).T)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    mark = np.zeros(n + 1, np.int8)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark[:-1], dtype=np.int8).view(bool)


def entropy_counts(docs: DataFrame) -> dict[int, int]:
    """Windows of each entropy class over all texts of `docs`. The classes are fewer than 10,241 whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for data, _, starts, ends, *_ in buffers([x.encode("utf-8", "surrogatepass") for x in texts_of(part.column("text"))]):
                    sums = window_sums(data)
                    total += np.bincount(sums[covered(len(sums), starts, ends)], minlength=CLASSES)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"class": pa.array(kept.astype(np.int32)), "n": pa.array(total[kept])})

    found = docs.select("text").mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"))
    return {r["class"]: r["n"] for r in found.collect()}


def rarity(counts: dict[int, int]) -> np.ndarray:
    """Rank of each entropy class: 0 for the rarest, NEVER for those of too little entropy. Of equally rare classes the one of
    more entropy comes first."""
    order = sorted(range(HIGHEST + 1), key=lambda c: (counts.get(c, 0), c))
    ranks = np.full(CLASSES, NEVER, np.uint32)
    ranks[order] = np.arange(len(order))
    return ranks


def points(ranks: np.ndarray) -> np.ndarray:
    """How many runs of neighbours each window is the first rarest of. Runs reach over the ends."""
    ends = np.full(NEIGHBOURS - 1, NEVER, np.uint32)
    keyed, done = np.concatenate((ends, ranks, ends)) << np.uint32(18), 1
    keyed |= np.arange(len(keyed), dtype=np.uint32)
    while done < NEIGHBOURS:
        keyed = np.minimum(keyed[:-done], keyed[done:])
        done *= 2
    return np.bincount(keyed & np.uint32((1 << 18) - 1), minlength=len(ranks) + 2 * len(ends))[len(ends) : len(ends) + len(ranks)]


def features(blobs: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and 64-bit hashes of the features of texts, in order. A text too short or too plain for any has itself as
    its only feature, an empty one has none."""
    numbers, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for data, number, starts, ends, lows, highs in buffers(blobs):
        own = ranks[window_sums(data)]
        own[~covered(len(own), lows, highs)] = NEVER
        at = np.flatnonzero((points(own) >= POINTS) & (own != NEVER) & covered(len(own), starts, ends))
        words, out = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].copy().view("<u8"), np.zeros(len(at), np.uint64)
        for i in range(words.shape[1]):
            out = mixed(out * np.uint64(31) + words[:, i] + np.uint64(i + 1))
        numbers.append(number[np.searchsorted(starts, at, side="right") - 1])
        hashes.append(out)
    number, found = np.concatenate(numbers), np.concatenate(hashes)
    none = np.setdiff1d(np.flatnonzero([len(x) > 0 for x in blobs]), number)
    if len(none):
        own = np.array([int.from_bytes(hashlib.sha256(blobs[i]).digest()[:8], "little") for i in none], np.uint64)
        number, found = np.concatenate((number, none)), np.concatenate((found, own))
        order = np.argsort(number, kind="stable")
        number, found = number[order], found[order]
    return number, found


def digests(texts: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of Bloom filters (n x bytes)."""
    number, found = features([x.encode("utf-8", "surrogatepass") for x in texts], ranks)
    counts = np.bincount(number, minlength=len(texts))
    ordinal = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    chains = -(-counts // FILTER_FEATURES)
    ends = np.cumsum(chains)
    which = (ends - chains)[number] + ordinal // FILTER_FEATURES
    bits = np.zeros((int(chains.sum()), FILTER_BITS), np.uint8)
    for h in range(HASHES):
        bits[which, (found >> np.uint64(11 * h)).astype(np.int64) % FILTER_BITS] = 1
    return np.split(np.packbits(bits, axis=1), ends[:-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain, the most of its bits beyond chance that one filter of the other
    chain shares; the mean, weighted by bits. Two empty chains are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    bits_a, bits_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    total = 0.0
    for own, n in zip(a, bits_a, strict=True):
        shared = np.bitwise_count(b & own).sum(axis=1, dtype=np.int64)
        chance, best = n * bits_b / FILTER_BITS, np.minimum(n, bits_b)
        total += n * float(np.max(np.clip((shared - chance) / np.maximum(best - chance, 1e-9), 0, 1)))
    return total / float(bits_a.sum())


def written(chain: np.ndarray) -> str:
    """The chain in base 64; empty for an empty text."""
    return base64.b64encode(chain.tobytes()).decode()


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of `docs` (doc_id, text), of its edited text, and how alike they are to it and to the next.

    A null text is empty. The next document is that of the next doc_id (nulls come last, rows of one doc_id by text);
    after the last comes the first; a single document is its own next. Other columns play no part.
    """
    ranks = rarity(entropy_counts(docs))
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in kinds.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = texts_of(part.column("text"))
                rows = [*zip(*(part.column(c).to_pylist() for c in ("slot", "guest", "doc_id")), texts, digests(texts, ranks), strict=True)]
                pairs = []
                for row in rows:
                    if before and before[0] == row[0]:
                        pairs.append((before, row[4], edited(before[3], row[3])))
                    before = None if row[1] else row
                out = []
                for (row, after, new), changed in zip(pairs, digests([x for _, _, x in pairs], ranks) if pairs else [], strict=True):
                    own = row[4]
                    out.append((row[2], len(row[3]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, after)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)

    ordered = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text", guests=True)
    return ordered.select("slot", "guest", "doc_id", "text").mapInArrow(compare, kinds)
