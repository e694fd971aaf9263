"""Two tokenizers' tokens of the same bytes: where they end together, and how often two ids do so in the corpus.

Inside a task the cumulative ends of both token sequences are merged; ends that both have cut a text into groups, and the two tokens
that end there are a link. Links are counted within blocks of texts first: what is shuffled is a row for each different pair of a
block. Spark sums the pairs, joins the sums and the greatest sum of each id of the second side back to the blocks' pairs, and each
block's texts meet the counts of their own block only.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import SLICE_BYTES, stored
from motley.llm.sentencepieces import SPACE
from motley.llm.wordcache import WordEncoder

#: Bytes of text of a block, unless one text has more.
BLOCK_BYTES = SLICE_BYTES
#: Printed bytes of a byte-level vocabulary that stand for themselves: the ranges of visible signs. (fixed values)
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
WITHIN, TURN, END = range(3)  # what follows a token in a text's written groups
SEPARATORS = {WITHIN: b",", TURN: b"|", END: b";"}


def byte_values() -> dict[str, int]:
    """The byte of each printed sign of a byte-level vocabulary: visible ones are themselves, the others follow from U+0100 on."""
    hidden = [b for b in range(256) if b not in set(VISIBLE)]
    return {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """The bytes and written ids of one vocabulary."""

    def __init__(self, token_bytes: list[bytes]):
        self.values = pa.array(token_bytes, pa.large_binary())
        self.sizes = np.array([len(x) for x in token_bytes], np.int64)
        self.n = len(token_bytes)

    def joined(self, ids: np.ndarray) -> memoryview:
        """The tokens' bytes, one after another."""
        found = self.values.take(pa.array(ids.astype(np.int64)))
        return memoryview(found.buffers()[2] or b"").cast("B")[: int(self.sizes[ids].sum())]


class Pair:
    """Both tokenizers: a byte-level one, given the text after a space, and one of pieces, which adds that space itself."""

    def __init__(self, byte_level: str, pieces: str):
        self.a = WordEncoder(byte_level)
        self.a.library.encode_special_tokens, self.a.special = True, []  # strings of special tokens are plain text
        self.b = library = sentencepiece.SentencePieceProcessor(model_file=pieces)
        values, vocabulary = byte_values(), self.a.library.get_vocab()
        a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        b = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(library.id_to_piece, range(library.get_piece_size())))]
        self.side_a, self.side_b = Side(a), Side(b)
        most = max(len(a), len(b))
        self.written = pa.array([b"%d%s" % (i, SEPARATORS[k]) for k in SEPARATORS for i in range(most)], pa.large_binary())
        self.most = most

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides over all texts, and where each text's begin. Empty texts, and texts that the bytes of either side's
        tokens do not give back, have none."""
        spaced = [f" {x}" if x else "" for x in texts]
        a, at_a = self.a.encode(pa.array(spaced, pa.large_string()))
        own = [np.array(x, np.uint32) for x in self.b.encode(texts, num_threads=1)]
        at_b = np.concatenate(([0], np.cumsum([len(x) for x in own], dtype=np.int64)))
        b = np.concatenate(own) if own else np.zeros(0, np.uint32)
        raw = [x.encode() for x in spaced]
        whole = b"".join(raw)
        if self.side_a.joined(a) == whole and self.side_b.joined(b) == whole:
            return a, at_a, b, at_b
        sound = [self.side_a.joined(a[at_a[i] : at_a[i + 1]]) == x and self.side_b.joined(b[at_b[i] : at_b[i + 1]]) == x for i, x in enumerate(raw)]
        kept = [(np.repeat(sound, np.diff(at)), np.concatenate(([0], np.cumsum(np.where(sound, np.diff(at), 0))))) for at in (at_a, at_b)]
        return a[kept[0][0]], kept[0][1], b[kept[1][0]], kept[1][1]


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two ascending sequences have equal values: places in the one and in the other. Their stable sort is one merge of two
    sorted runs, in which equal ends are neighbours."""
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")
    merged = both[order]
    at = np.flatnonzero(merged[1:] == merged[:-1])
    return order[at], order[at + 1] - len(a)


@functools.lru_cache(1)
def pair_of(byte_level: str, pieces: str) -> Pair:
    """One pair a worker process."""
    return Pair(byte_level, pieces)


class Aligned:
    """The groups and links of some texts, token ids of the texts one after another."""

    def __init__(self, pair: Pair, texts: list[str]):
        self.pair = pair
        self.a, self.at_a, self.b, self.at_b = pair.encoded(texts)
        ends_a, ends_b = np.cumsum(pair.side_a.sizes[self.a]), np.cumsum(pair.side_b.sizes[self.b])
        self.last_a, self.last_b = common_ends(ends_a, ends_b)
        self.groups = np.searchsorted(self.last_a, self.at_a)  # where each text's groups begin; a text's last ends are always common

    def written(self) -> list[bytes]:
        """Each text's groups: a1,a2|b1;a3|b2,b3."""
        most = self.pair.most
        group_a = np.searchsorted(self.last_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.last_b, np.arange(len(self.b)))
        size_a, size_b = (np.diff(x, prepend=-1) for x in (self.last_a, self.last_b))
        before_b, until_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        follows_a, follows_b = (np.full(len(x), WITHIN, np.int64) for x in (self.a, self.b))
        follows_a[self.last_a], follows_b[self.last_b] = TURN, END
        said = np.empty(len(self.a) + len(self.b), np.int64)
        said[np.arange(len(self.a)) + before_b[group_a]] = self.a + most * follows_a
        said[np.arange(len(self.b)) + until_a[group_b]] = self.b + most * follows_b
        found = self.pair.written.take(pa.array(said))
        bounds = np.concatenate(([0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False))))
        raw = memoryview(found.buffers()[2] or b"")
        cuts = bounds[self.at_a + self.at_b].tolist()
        return [bytes(raw[x : y - 1]) if y > x else b"" for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs (a * ids of b + b) and their counts, and of each link its pair's number, texts one after another."""
        pairs = self.a[self.last_a].astype(np.int64) * self.pair.side_b.n + self.b[self.last_b]
        found, number, count = np.unique(pairs, return_inverse=True, return_counts=True)
        return found, count, number


def aligned(docs: DataFrame, byte_level: str, pieces: str, block_bytes: int = BLOCK_BYTES, written: bool = True) -> DataFrame:
    """Rows of `docs` (doc_id, text) in blocks: block, doc_id, n_a, n_b, n_groups, groups (as text: a1,a2|b1;a3|b2,b3; null unless
    written is asked for), groups_sha256 (empty without tokens), linked and times (the block's numbers of the text's pairs, and how often each), and on a block's first
    row a, b and n: its pairs by number.

    Null and empty texts, and texts that the tokens of a side do not give back byte for byte, have no tokens. Repeated rows stay,
    other columns play no part. A task holds a block and one Arrow batch; a text beyond a block's size is a block of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = pair_of(byte_level, pieces)
        for batch in batches:
            texts = [x or "" for x in batch["text"]]
            sizes = np.cumsum([4 * len(x) for x in texts])  # at most so many bytes
            turns = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // (4 * block_bytes))) + 1) if texts else []
            for rows in turns:
                own = Aligned(pair, [texts[i] for i in rows])
                found, count, number = own.links()
                cuts = own.groups[1:-1]
                each = [np.unique(x, return_counts=True) for x in np.split(number, cuts)]
                said, first = own.written(), len(rows) - 1
                none: list = [None] * first
                yield pd.DataFrame({
                    "block": np.full(len(rows), batch["row"].iloc[rows[0]]),
                    "doc_id": batch["doc_id"].iloc[rows].to_numpy(),
                    "n_a": np.diff(own.at_a),
                    "n_b": np.diff(own.at_b),
                    "n_groups": np.diff(own.groups),
                    "groups": [x.decode() if written else None for x in said],
                    "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in said],
                    "linked": [x.astype(np.int32) for x, _ in each],
                    "times": [x.astype(np.int32) for _, x in each],
                    "a": [(found // pair.side_b.n).astype(np.int32), *none],
                    "b": [(found % pair.side_b.n).astype(np.int32), *none],
                    "n": [count, *none],
                })
                del own, said, each, number
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    kinds = "block long, doc_id string, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, linked array<int>, times array<int>, a array<int>, b array<int>, n array<long>"
    return rows.mapInPandas(run, kinds).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, count (links of all texts that hold the pair linked), best (whether no other pair of the same b has more)."""
    pairs = blocks.where("a is not null").select(F.inline(F.arrays_zip("a", "b", "n")))
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))  # most: a row per id of b's vocabulary


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """block, doc_id, n_links, n_best, count_sum and the other plain columns of stored blocks, by the counts of their pairs."""
    pairs = blocks.where("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("number", "pair")).select("block", "number", "pair.a", "pair.b")
    found = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("of"), "number", "count", "best")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def work(texts: pa.Table, known: pa.Table) -> pa.Table:
        number = known["number"].to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = known["count"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
        linked, times = (texts[c].combine_chunks() for c in ("linked", "times"))
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(linked).to_numpy(zero_copy_only=False))
        linked, times = linked.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        total = lambda x: pa.array(summed(owner, x, len(texts)))
        return pa.table([*(texts[c] for c in plain), total(times), total(best[linked] * times), total(count[linked] * times)], names=[*plain, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in plain)
    texts = blocks.select("block", "linked", "times", *plain)
    return texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(work, f"{kinds}, n_links long, n_best long, count_sum long")


def summed(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by owner; owners come in order."""
    before = np.concatenate(([0], np.cumsum(values)))
    at = np.searchsorted(owner, np.arange(n + 1))
    return before[at[1:]] - before[at[:-1]]


def digests(docs: DataFrame, byte_level: str, pieces: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs` (doc_id: long)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = stored(aligned(rows, byte_level, pieces, block_bytes, written=False).drop("groups"), "blocks")
    return scored(blocks, pair_counts(blocks)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
