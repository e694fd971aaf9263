"""Exact duplicates by an extendible-hash index on shared files.

The heap file holds each different text of a batch once, under the number of its first row, and for every row the number of its text.
Key ranges of the 64-bit hash belong to owner tasks. An owner gets its entries in the order of their keys and puts them in pages of
bounded size: an overfull page is split by the next bit of the hash, and once a page is deeper than the directory the directory
doubles. In that order every page before the present key is complete and is written, so an owner holds a page or two. Entries of one hash stand in
a chain and are told apart by their bytes. The index, pages and entries, is a table of the shared folder like the heap file.

Copies are merged in each batch before anything is shuffled. A hash with more than its share of the entries is merged by several tasks
first, by the task that its entries come from.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import SLICE_BYTES, partitions, released, stored, texts_of

#: Blanks that a normalised text has as one space; a single space is one already. (fixed values)
BLANKS = re.compile(rb"[\t-\r][\x20\t-\r]*|\x20[\x20\t-\r]+")
SEED = 7
KEY_BITS = 64
#: Bytes of text and entries that a page holds before it is split.
PAGE_BYTES, PAGE_ENTRIES = 8 << 20, 1 << 14
#: Tasks that a hash of many entries is dealt to, for each of its shares.
SALTS_A_SHARE = 2


def normalised(text: str) -> bytes:
    """The text in UTF-8, each run of blanks as one space."""
    return BLANKS.sub(b" ", text.encode("utf-8", "surrogatepass"))


def heap_file(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """row, doc_id, entry, text_sha256 of every row of `docs` (doc_id: long, text); on an entry's first row also hash, n, first_doc,
    first_row and body: how many rows of the batch have the text, which of them is kept, and the normalised text.

    The row kept is that of the least doc_id, nulls last, then of the least row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            for i, text in enumerate(texts_of(batch.column("text"))):
                groups.setdefault(normalised(text), []).append(i)
            rows, ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            out, held = [], 0
            for body, own in groups.items():
                sha = hashlib.sha256(body).hexdigest()
                least = min(own, key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
                key = xxhash.xxh64_intdigest(body, seed) - (1 << KEY_BITS - 1)  # in the order of the bits, as a signed number
                out.append((rows[own[0]], ids[own[0]], rows[own[0]], sha, key, len(own), ids[least], rows[least], body))
                out += [(rows[i], ids[i], rows[own[0]], sha, None, None, None, None, None) for i in own[1:]]
                held += len(body)
                if held > SLICE_BYTES:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], [*kinds])

    whole = pa.int64()
    kinds = {"row": whole, "doc_id": whole, "entry": whole, "text_sha256": pa.string(), "hash": whole, "n": whole, "first_doc": whole, "first_row": whole, "body": pa.large_binary()}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(run), "row long, doc_id long, entry long, text_sha256 string, hash long, n long, first_doc long, first_row long, body binary")


class Slot:
    """A text of a page: its bytes, and what is known of its rows."""

    def __init__(self, entry: int, body: bytes):
        self.entry, self.body, self.n, self.least, self.members = entry, body, 0, None, []

    def add(self, entry: int, n: int, least: tuple[bool, int, int]) -> None:
        self.members.append(entry)
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class Page:
    """The keys whose first `depth` bits are `prefix`: of each hash the chain of its different texts."""

    def __init__(self, depth: int, prefix: int):
        self.depth, self.prefix, self.size = depth, prefix, 0
        self.chains: dict[int, list[Slot]] = {}

    def slot(self, key: int, entry: int, body: bytes) -> Slot:
        chain = self.chains.setdefault(key, [])
        for slot in chain:
            if slot.body == body:
                return slot
        self.size += len(body)
        chain.append(Slot(entry, body))
        return chain[-1]

    def overfull(self, most_bytes: int, most_entries: int) -> bool:
        return (self.size > most_bytes or len(self.chains) > most_entries) and len(self.chains) > 1

    def halves(self) -> tuple[Page, Page]:
        """The page split by the next bit."""
        low, high = Page(self.depth + 1, 2 * self.prefix), Page(self.depth + 1, 2 * self.prefix + 1)
        for key, chain in self.chains.items():
            half = high if key >> KEY_BITS - 1 - self.depth & 1 else low
            half.chains[key] = chain
            half.size += sum(len(x.body) for x in chain)
        return low, high


class Index:
    """An owner's pages and the depth of its directory, for keys that come in ascending order: pages before the present key are done."""

    def __init__(self, most_bytes: int = PAGE_BYTES, most_entries: int = PAGE_ENTRIES):
        self.most_bytes, self.most_entries, self.depth = most_bytes, most_entries, 0
        self.open: list[Page] = [Page(0, 0)]  # the last one first

    def put(self, key: int, entry: int, body: bytes, n: int, least: tuple[bool, int, int]) -> Iterator[tuple[int, Page]]:
        """Adds an entry; gives the pages that it completes, with the depth of the directory by then."""
        while key >> KEY_BITS - self.open[-1].depth != self.open[-1].prefix:
            yield self.depth, self.open.pop()
        page = self.open[-1]
        page.slot(key, entry, body).add(entry, n, least)
        while page.overfull(self.most_bytes, self.most_entries):
            low, high = page.halves()
            self.depth = max(self.depth, low.depth)  # a page deeper than the directory doubles it
            self.open[-1:] = [high, low]
            while key >> KEY_BITS - self.open[-1].depth != self.open[-1].prefix:
                yield self.depth, self.open.pop()
            page = self.open[-1]

    def rest(self) -> Iterator[tuple[int, Page]]:
        while self.open:
            yield self.depth, self.open.pop()


class Limits(NamedTuple):
    page_bytes: int = PAGE_BYTES
    page_entries: int = PAGE_ENTRIES


def indexed(entries: DataFrame, limits: Limits = Limits(), bodies: bool = False) -> DataFrame:
    """page_prefix, page_depth, directory_depth, hash, chain, head, entry, and on a head n, first_doc, first_row: a row per entry of
    `entries` (salt, hash, entry, n, first_doc, first_row, body).

    Entries of equal bytes (and equal salt) have one head, the entry that came first. chain: the place of its text among those of
    its hash. With bodies, a head also has its body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, salt, out, held = None, None, [], 0
        for batch in batches:
            at, columns = batch.column("body"), [batch.column(c).to_pylist() for c in ("salt", "hash", "entry", "n", "first_doc", "first_row")]
            for i, (own, key, entry, n, doc, row) in enumerate(zip(*columns, strict=True)):
                if own != salt or index is None:
                    for found in index.rest() if index else ():
                        out += written(*found)
                    index, salt = Index(*limits), own
                for found in index.put(key + (1 << KEY_BITS - 1), entry, at[i].as_py(), n, (doc is None, doc or 0, row)):
                    out += written(*found)
                    held += found[1].size
                if out and (held > SLICE_BYTES or len(out) > PAGE_ENTRIES):
                    yield made(out)
                    out, held = [], 0
        for found in index.rest() if index else ():
            out += written(*found)
        if out:
            yield made(out)

    def written(depth: int, page: Page) -> Iterator[tuple]:
        for key, chain in page.chains.items():
            for place, slot in enumerate(chain):
                null, doc, row = slot.least
                head = (slot.n, None if null else doc, row, slot.body if bodies else None)
                for entry in slot.members:
                    yield page.prefix - (1 << KEY_BITS - 1) if page.depth == KEY_BITS else page.prefix, page.depth, depth, key - (1 << KEY_BITS - 1), place, slot.entry, entry, *(head if entry == slot.entry else (None,) * 4)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], [*kinds])

    whole, small = pa.int64(), pa.int32()
    kinds = {"page_prefix": whole, "page_depth": small, "directory_depth": small, "hash": whole, "chain": small, "head": whole, "entry": whole, "n": whole, "first_doc": whole, "first_row": whole, "body": pa.large_binary()}
    tasks = partitions(entries.sparkSession)
    cell = F.shiftright("hash", 40) + (1 << 23)  # key ranges: the first 24 bits, dealt evenly in order
    owner = F.pmod(F.floor(cell * tasks / (1 << 24)).cast("int") + F.pmod(F.hash("salt"), F.lit(tasks)), F.lit(tasks)).cast("int")
    dealt = entries.select("salt", "hash", "entry", "n", "first_doc", "first_row", "body", owner.alias("owner")).repartitionById(tasks, "owner").sortWithinPartitions("salt", "hash", "entry")
    return dealt.mapInArrow(released(run), "page_prefix long, page_depth int, directory_depth int, hash long, chain int, head long, entry long, n long, first_doc long, first_row long, body binary")


def build(docs: DataFrame, limits: Limits = Limits(), seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The stored heap file of `docs` and its stored index: (heap, index). The index has a row per entry of the heap."""
    heap = stored(heap_file(docs, seed), "heap")
    fields = ["hash", "entry", "n", "first_doc", "first_row", "body"]
    entries = heap.where("hash is not null").select(F.lit(0).alias("salt"), *fields)
    counts = entries.groupBy("hash").agg(F.count(F.lit(1)).alias("times"))
    total, most = counts.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
    share = max(16, total // (4 * partitions(docs.sparkSession)))
    if most <= share:
        return heap, stored(indexed(entries, limits), "index")
    hot = [r["hash"] for r in counts.where(F.col("times") > share).select("hash").collect()]  # under four times the tasks
    is_hot, salts = F.col("hash").isin(hot), SALTS_A_SHARE * -(-most // share)
    salted = entries.where(is_hot).withColumn("salt", F.pmod(F.xxhash64("entry"), F.lit(salts)).cast("int"))
    first = stored(indexed(salted, limits, bodies=True), "merged")
    heads = first.where("n is not null").select(F.lit(0).alias("salt"), "hash", F.col("head").alias("entry"), "n", "first_doc", "first_row", "body")
    index = stored(indexed(entries.where(~is_hot).unionByName(heads), limits), "index")
    merged = first.where("n is null").select("head", F.col("entry").alias("_entry"))
    under = index.drop("n", "first_doc", "first_row").join(merged.withColumnRenamed("head", "_head"), F.col("entry") == F.col("_head"))
    below = under.withColumn("entry", F.col("_entry")).drop("_entry", "_head")
    return heap, index.unionByName(below, allowMissingColumns=True)


def groups(docs: DataFrame, limits: Limits = Limits(), seed: int = SEED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs` (doc_id: long, text), over texts that are equal once each run
    of blanks is one space.

    A null text is empty. Of equal texts the row of the least doc_id is kept, null ones last; of rows of one doc_id one is. Other columns
    play no part; an empty table has no rows.
    """
    heap, index = build(docs, limits, seed)
    heads = index.where("n is not null").select("head", "n", "first_doc", "first_row")
    of = index.select("entry", "head").join(heads, "head").select("entry", "n", "first_doc", "first_row")
    rows = heap.select("row", "doc_id", "entry", "text_sha256").join(of, "entry")
    return rows.select("doc_id", F.col("first_doc").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first_row")).alias("kept"), "text_sha256")


def matched(docs: DataFrame, heap: DataFrame, index: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id and head of every row of other `docs`: the entry of a built index that has its text byte for byte, null where none has."""
    asked = heap_file(docs, seed)
    entries = asked.where("hash is not null").select(F.col("entry").alias("_entry"), "hash", "body")
    known = index.where("n is not null").select("hash", "head").join(heap.where("hash is not null").select(F.col("entry").alias("head"), F.col("body").alias("_body")), "head")
    found = entries.join(known, "hash").where(F.col("body") == F.col("_body")).select("_entry", "head")
    return asked.select("doc_id", F.col("entry").alias("_entry")).join(found, "_entry", "left").select("doc_id", "head")
