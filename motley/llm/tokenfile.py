"""Token ids on disk: a wavelet matrix per shard.

A dataset is a Parquet table written by Spark with a row per shard. A shard's ids stand as bit-planes (16 for ids
up to 65,535, as many as its greatest id needs beyond),
most significant first; below each plane its zeros come before its ones, in order. Each plane has a count
of ones before every block of 512 bits, so access, counting and occurrence lookup look at a few bytes of each
plane (of a shard that is in memory: a Parquet cell is read whole). A shard also has its documents' ids and lengths in order.
`occurrences` counts and finds an id in all shards by rank and select; reading back whole documents goes plane by plane.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.llm.common import in_order, released, shared_dir, text_slices
from motley.llm.wordcache import word_encoder

PLANES = 16
BLOCK = 512
#: A shard ends with the document that reaches so many ids.
SHARD_IDS = 1 << 18
SHARDS = "slot int, shard int, n_ids long, doc_ids binary, missing binary, lengths binary, zeros binary, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Rank and select over a sequence of unsigned values of up to 32 bits."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.height = n, zeros, len(zeros)
        self.planes = [np.frombuffer(x, np.uint8) for x in planes]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        height = max(PLANES, int(values.max(initial=0)).bit_length())
        kind = np.uint16 if height <= 16 else np.uint32
        now, planes, zeros, ranks = np.ascontiguousarray(values, kind), [], [], []
        for k in range(height - 1, -1, -1):
            ones = (now & kind(1 << k)) != 0
            bits = np.packbits(ones)
            low, high = now[~ones], now[ones]
            sums = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(sums)[:-1])).astype("<u4").tobytes() if len(sums) else b"")
            planes.append(bits.tobytes())
            zeros.append(len(low))
            now = np.concatenate((low, high))
        return cls(len(values), zeros, planes, ranks)

    def _bit(self, plane: int, i: int) -> int:
        return self.planes[plane][i >> 3] >> (7 - (i & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones before i."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, bits = i // BLOCK, self.planes[plane]
        whole = bits[block * (BLOCK // 8) : i >> 3]
        rest = int(bits[i >> 3]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self.ranks[plane][block]) + int(np.bitwise_count(whole).sum()) + rest.bit_count()

    def _place(self, plane: int, i: int, bit: int) -> int:
        ones = self._ones(plane, i)
        return self.zeros[plane] + ones if bit else i - ones

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.height):
            bit = self._bit(p, i)
            value, i = value << 1 | int(bit), self._place(p, i, bit)
        return value

    def rank(self, value: int, i: int) -> int:
        """How often the value stands before i."""
        a = 0
        if value >> self.height:
            return 0
        for p in range(self.height):
            bit = value >> (self.height - 1 - p) & 1
            a, i = self._place(p, a, bit), self._place(p, i, bit)
        return i - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Where the value stands for the k-th time (from 0); -1 if it does not."""
        if not 0 <= k < self.count(value):
            return -1
        a = 0
        for p in range(self.height):
            a = self._place(p, a, value >> (self.height - 1 - p) & 1)
        i = a + k
        for p in range(self.height - 1, -1, -1):
            bit = value >> (self.height - 1 - p) & 1
            want = i - self.zeros[p] if bit else i
            low, high = 0, self.n - 1
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(p, mid + 1)
                low, high = (low, mid) if (ones if bit else mid + 1 - ones) > want else (mid + 1, high)
            i = low
        return i

    def values(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.height <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.height):
            p = self.height - 1 - k
            ones = np.unpackbits(self.planes[p], count=self.n).view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~ones)] = now[: self.zeros[p]]
            above[np.flatnonzero(ones)] = now[self.zeros[p] :] | kind(1 << k)
            now = above
        return now


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of `docs` (doc_id, text) by ascending doc_id, the end id after each document; nulls in doc_id come last.

    Repeated rows are documents of their own, in the order of their texts. A null text is empty. A document is never
    cut, so a shard is longer than `shard_ids` by less than one document.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        slot, number, held, docs, lengths = None, 0, [], [], []

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(held)
            m = WaveletMatrix.build(ids)
            missing = np.array([x is None for x in docs])
            row = {"slot": slot, "shard": number, "n_ids": m.n, "doc_ids": np.array([x or 0 for x in docs], "<i8").tobytes(), "missing": np.packbits(missing).tobytes(), "lengths": np.array(lengths, "<i8").tobytes(), "zeros": np.array(m.zeros, "<i8").tobytes(), "planes": [x.tobytes() for x in m.planes], "ranks": [x.tobytes() for x in m.ranks]}
            return pa.RecordBatch.from_pylist([row], pa.schema([("slot", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "missing", "lengths", "zeros")), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))]))

        n = 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                found, bounds = encoder.encode(part.column("text"), end_id)
                for s, doc, a, b in zip(part.column("slot").to_pylist(), part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if docs and (s != slot or n >= shard_ids):
                        yield shard()
                        number, n, held, docs, lengths = (number + 1 if s == slot else 0), 0, [], [], []
                    slot = s
                    held.append(found[a:b])
                    docs.append(doc)
                    lengths.append(b - a)
                    n += lengths[-1]
        if docs:
            yield shard()

    ordered = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    ordered.select("slot", "doc_id", "text").mapInArrow(released(shards), SHARDS).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids as unsigned 32-bit integers."""
    files = spark.read.schema(SHARDS).parquet(path)
    totals = files.groupBy("slot", "shard").agg(F.sum("n_ids").alias("n")).orderBy("slot", "shard").select("slot", "shard", "n")
    per_slot = totals.groupBy("slot").agg(F.sum("n").alias("n")).orderBy("slot").collect()  # one row a range of doc_id
    bases, base = [], 0
    for r in per_slot:
        bases.append((r["slot"], base))
        base += r["n"]
    within = F.expr("coalesce(sum(n_ids) over (partition by slot order by shard rows between unbounded preceding and 1 preceding), 0)")
    offsets = files.select("slot", "shard", "n_ids").withColumn("_in", within).drop("n_ids")
    offsets = offsets.join(F.broadcast(spark.createDataFrame(bases, "slot int, _base long")), "slot").select("slot", "shard", (F.col("_in") + F.col("_base")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = WaveletMatrix(row["n_ids"], np.frombuffer(row["zeros"], "<i8").tolist(), row["planes"], row["ranks"]).values().astype("<u4")
                lengths, docs = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["doc_ids"], "<i8")
                missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(docs)).astype(bool)
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                shard = pa.array(np.full(len(docs), row["shard"], np.int32))
                yield pa.RecordBatch.from_pydict({"slot": pa.array(np.full(len(docs), row["slot"], np.int32)), "shard": shard, "doc_id": pa.array(docs, mask=missing), "_start": pa.array(starts), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    found = files.mapInArrow(decode, "slot int, shard int, doc_id long, _start long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["slot", "shard"]).select("doc_id", (F.col("base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, value: int, most: int = 100) -> DataFrame:
    """slot, shard, n, places: how often an id stands in each shard (rank), and where it does first, `most` places at most (select)."""
    files = spark.read.schema(SHARDS).parquet(path)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                m = WaveletMatrix(row["n_ids"], np.frombuffer(row["zeros"], "<i8").tolist(), row["planes"], row["ranks"])
                n = m.count(value)
                yield pa.RecordBatch.from_pydict({"slot": pa.array([row["slot"]], pa.int32()), "shard": pa.array([row["shard"]], pa.int32()), "n": pa.array([n], pa.int64()), "places": pa.array([[m.select(value, k) for k in range(min(n, most))]], pa.list_(pa.int64()))})

    return files.mapInArrow(find, "slot int, shard int, n long, places array<long>")


def round_trip(docs: DataFrame, tokenizer: str, name: str = "tokens") -> DataFrame:
    """Writes the ids under the shared folder and reads them back. An empty table gives no rows."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/motley-{uuid.uuid4().hex}/{name}"
    write_tokens(docs, tokenizer, path)
    return read_tokens(spark, path)
