"""Removal of repeated byte strings over a whole corpus, by prefix-free parsing.

A rolling hash of 32 bytes sets triggers: the trigger of a 100-byte string is the least hash in it (the first of equals), so
equal strings have equal triggers at equal places. The string starts that share a trigger follow each other; with the
bytes they reach they are a phrase, and a document is the sequence of its phrases. Phrases are dealt by trigger:
- the dictionary keeps each phrase once, by its first place; the others of its kind repeat in all their strings;
- a trigger of one phrase only repeats in none;
- of a trigger of several phrases (the ends of repeated passages) the bytes are sent, and put in corpus order:
  1. every phrase is cut at its trigger. The distinct left parts, the trigger their end, are the dictionary; its suffix
     array comes of prefix doubling. A suffix that ends in its trigger is no proper beginning of another one.
  2. what follows the trigger is a suffix of the parse. Those are sorted, with the length each has in common with the next.
  3. a string start is a suffix of a left part and what follows the trigger: sorted by the rank of the one, then of the
     other, all starts stand in the order of their letters. Neighbours with equal suffix and enough in common after
     the trigger are equal strings; all but the first of them in the corpus repeat.

An order of all letters is made of one trigger's phrases, or some triggers' at once, never of the whole corpus: equal strings have
equal triggers, so no neighbours are missed. A trigger of more phrases than a task should hold (a line that a third of the
documents have) has its strings sent by their hashes instead, merged where they are made.

Phrases are compared by 64-bit hashes. Two different ones are taken as equal with a chance of about 2^-56 for a pair.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import in_order, mixed, partitions, released, stored, text_slices

LENGTH = 100
TRIGGER = 32
#: Bytes hashed at once; longer documents are taken in pieces that overlap by a string.
PIECE = 1 << 19
#: Phrases a task gathers before it merges equal ones and sends them on.
GATHERED = 1 << 19
#: The most phrases of one trigger that are put in order at once, and the bytes of several triggers' phrases.
TOGETHER, TOGETHER_BYTES = 1 << 11, 2 << 20
ROOT = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8

PHRASES = "trigger long, phrase long, sid long, place long"
SPANS = "kind int, sid long, first long, last long, lead long"


@functools.lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of ROOT and of its inverse modulo 2^64 for each place in a piece, and a random number for each byte value."""
    n = PIECE + 2 * LENGTH
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = ROOT, pow(ROOT, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    up, _, values = powers()
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((prefix[ends] - prefix[starts]) * powers()[1][starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def phrases_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """trigger, phrase, first start, last start, trigger's place from the first start: of all phrases of texts
    data[starts:ends], each of at least `length` bytes."""
    grams = length - TRIGGER + 1
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - TRIGGER + 1)
    hashes = span_hashes(prefix, at, at + TRIGGER)
    bits = np.uint64((1 << 22) - 1)
    least = sliding_min(hashes & ~bits | at.astype(np.uint64), grams) & bits
    valid = np.zeros(len(least) + 1, np.int8)
    valid[starts] += 1
    np.subtract.at(valid, ends - length + 1, 1)
    first = np.flatnonzero(np.cumsum(valid[:-1]))
    where = least[first].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    low, high = first[new], first[np.concatenate((new[1:] - 1, [len(first) - 1]))]
    trigger = hashes[where[new]]
    shape = (where[new] - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)
    return trigger, mixed(span_hashes(prefix, low, high + length) ^ mixed(shape)), low, high, where[new] - low


def pieces_of(sids: list[int], blobs: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of at most PIECE bytes: bytes, starts, ends, document ids and the place of each start in its document."""
    held, size, step = [], 0, PIECE - length + 1
    for sid, blob in zip(sids, blobs, strict=True):
        if len(blob) < length:
            continue
        for base in range(0, max(1, len(blob) - length + 1), step):
            part = blob[base : base + PIECE]
            if size + len(part) > PIECE:
                yield _joined(held)
                held, size = [], 0
            held.append((sid, base, part))
            size += len(part)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
    ends = np.cumsum([len(x) for _, _, x in held])
    starts = ends - [len(x) for _, _, x in held]
    return data, starts, ends, np.array([s for s, _, _ in held], np.int64), np.array([b for _, b, _ in held], np.int64)


def blobs_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Gathered:
    """Phrases of a task, merged where they are equal, so that what a task sends for one phrase is one row.

    The rest of the equal phrases repeat an earlier one for sure; they leave as spans.
    """

    def __init__(self, length: int):
        self.length, self.parts, self.n = length, [], 0

    def add(self, trigger, phrase, sid, low, high, lead) -> None:
        self.parts.append((trigger, phrase, sid, low, high, lead))
        self.n += len(sid)

    def merged(self) -> pa.RecordBatch:
        trigger, phrase, sid, low, high, lead = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.lexsort((low, sid))
        order = order[np.argsort((trigger + phrase * np.uint64(3))[order], kind="stable")]
        same = (trigger[order][1:] == trigger[order][:-1]) & (phrase[order][1:] == phrase[order][:-1])
        again = order[1:][same]
        once = order[np.concatenate(([True], ~same))]
        a, b = merge_spans(sid[again], low[again], high[again] + self.length)
        place = low[once] << 16 | lead[once] << 8 | (high - low)[once]
        none = np.zeros(len(a[0]), bool)
        return pa.RecordBatch.from_pydict({
            "trigger": pa.array(np.concatenate((trigger[once].view(np.int64), np.zeros(len(none), np.int64))), mask=np.concatenate((np.zeros(len(once), bool), ~none))),
            "phrase": np.concatenate((phrase[once].view(np.int64), b)),
            "sid": np.concatenate((sid[once], a[0])),
            "place": np.concatenate((place, a[1])),
        })


def merge_spans(sid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((document, start), end) of the union of spans that overlap or touch."""
    if not len(sid):
        return (sid, start), end
    order = np.lexsort((start, sid))
    sid, start, end = sid[order], start[order], end[order]
    ends = end.copy()  # the furthest end so far in the document: starts of a document restart it
    group = np.concatenate(([0], np.cumsum(sid[1:] != sid[:-1])))
    ends = np.maximum.accumulate(end - end.min() + group * (int(end.max()) - int(end.min()) + 1)) - group * (int(end.max()) - int(end.min()) + 1) + end.min()
    new = np.concatenate(([True], (sid[1:] != sid[:-1]) | (start[1:] > ends[:-1])))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(sid) - 1]))
    return (sid[new], start[new]), ends[last]


def parse(docs: DataFrame, length: int) -> DataFrame:
    """The phrases of `docs` (sid, text); rows without a trigger are spans already known to repeat (place to phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gathered(length)
        for batch in batches:
            for part in text_slices(batch, "text", PIECE):
                for data, starts, ends, sids, bases in pieces_of(part.column("sid").to_pylist(), blobs_of(part.column("text")), length):
                    trigger, phrase, low, high, lead = phrases_of(data, starts, ends, length)
                    doc = np.searchsorted(starts, low, side="right") - 1
                    shift = bases[doc] - starts[doc]
                    got.add(trigger, phrase, sids[doc], low + shift, high + shift, lead)
                    if got.n >= GATHERED:
                        yield got.merged()
        if got.n:
            yield got.merged()

    return docs.select("sid", "text").mapInArrow(released(run), PHRASES)


def strings(docs: DataFrame, length: int) -> DataFrame:
    """The single strings of the phrases of kind 2 in `docs` (sid, text, spans: kind, first and last start, lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gathered(length)
        for batch in batches:
            spans = batch.column("spans")
            for i, (sid, blob) in enumerate(zip(batch.column("sid").to_pylist(), blobs_of(batch.column("text")), strict=True)):
                own = spans[i].values
                chosen = own.field("kind").to_numpy() == 2
                first, last = own.field("first").to_numpy()[chosen], own.field("last").to_numpy()[chosen]
                counts = last - first + 1
                at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
                for base in range(0, len(blob), PIECE):
                    here = at[(at >= base) & (at < base + PIECE)]
                    if len(here):
                        prefix = prefix_hashes(np.frombuffer(blob[base : base + PIECE + length], np.uint8))
                        one, half = here - base, here - base + length // 2
                        a, b = span_hashes(prefix, one, half), span_hashes(prefix, half, one + length)
                        got.add(mixed(a ^ mixed(b + np.uint64(1))), a + b * np.uint64(7), np.full(len(here), sid, np.int64), here, here, np.zeros(len(here), np.int64))
                        if got.n >= GATHERED:
                            yield got.merged()
        if got.n:
            yield got.merged()

    return docs.select("sid", "text", "spans").mapInArrow(released(run), PHRASES)


def phrase_bytes(docs: DataFrame, length: int) -> DataFrame:
    """trigger, sid, first, lead, bytes (to the end of the last string) of the phrases of kind 1 in `docs` (sid, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for i, (sid, blob) in enumerate(zip(batch.column("sid").to_pylist(), blobs_of(batch.column("text")), strict=True)):
                own = spans[i].values
                chosen = own.field("kind").to_numpy() == 1
                first, last, lead = (own.field(c).to_numpy()[chosen].tolist() for c in ("first", "last", "lead"))
                if first:
                    keys = [xxhash.xxh64_intdigest(blob[a + k : a + k + TRIGGER]) for a, k in zip(first, lead, strict=True)]
                    bodies = [blob[a : b + length] for a, b in zip(first, last, strict=True)]
                    yield pa.RecordBatch.from_pydict({"trigger": np.array(keys, np.uint64).view(np.int64), "sid": np.full(len(first), sid, np.int64), "first": np.array(first, np.int64), "lead": np.array(lead, np.int64), "bytes": pa.array(bodies, pa.binary())})

    return docs.select("sid", "text", "spans").mapInArrow(run, "trigger long, sid long, first long, lead long, bytes binary")


def suffix_ranks(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each text begins, rank of the suffix at each place): of suffixes of the texts, as far as `length` bytes tell them
    apart; equal ones share a rank. Ranks of 8 bytes are doubled until they reach."""
    sizes = np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join(x + bytes(8) for x in texts), np.uint8)
    base = np.cumsum(sizes + 8) - sizes - 8
    at = np.arange(len(data))
    left = np.repeat(base + sizes, sizes + 8) - at  # bytes up to the text's end
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(7, np.uint8))), 8)
    rank = np.unique(np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64), return_inverse=True)[1].astype(np.int64)
    reach = 8
    while reach < length:
        after = np.where(left > reach, rank[np.minimum(at + reach, len(data) - 1)] + 1, 0)
        rank = np.unique(rank << 32 | after, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return base, rank


def ordered_repeats(sid: np.ndarray, first: np.ndarray, lead: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, start, end of merged spans: all but the first of equal strings in these phrases, by their order in the corpus."""
    m, after = len(bodies), length - TRIGGER  # bytes that a string has besides its trigger
    sizes = np.array([len(x) for x in bodies])
    count = sizes - length + 1
    # the dictionary: distinct left parts and the ranks of their suffixes
    number: dict[bytes, int] = {}
    part = np.array([number.setdefault(x[: k + TRIGGER], len(number)) for x, k in zip(bodies, lead.tolist(), strict=True)])
    base, rank = suffix_ranks(list(number), length)
    # the parse: what follows the trigger, sorted, and how much neighbours have in common
    width = -(-after // 8) * 8
    follows = np.frombuffer(b"".join(x[k + TRIGGER :].ljust(width, b"\0") for x, k in zip(bodies, lead.tolist(), strict=True)), np.uint8).reshape(m, width)
    by = np.lexsort(follows.view(">u8").astype(np.uint64).T[::-1])
    place = np.empty(m, np.int64)
    place[by] = np.arange(m)
    same = follows[by[1:]] == follows[by[:-1]]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1)) if m > 1 else np.zeros(0, np.int64)
    kind = np.zeros((after + 1, m), np.int32)  # by the bytes that must agree after the trigger: neighbours that do
    for need in range(1, after + 1):
        np.cumsum(common < need, out=kind[need, 1:])
    # all string starts, in corpus order
    phrase = np.repeat(np.arange(m), count)
    at = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    before = rank[base[part[phrase]] + at]
    order = np.argsort(before << 32 | place[phrase], kind="stable")
    phrase, at, before = phrase[order], at[order], before[order]
    alike = kind[after - (lead[phrase] - at), place[phrase]]
    new = np.concatenate(([True], (before[1:] != before[:-1]) | (alike[1:] != alike[:-1])))
    turn = np.empty(m, np.int64)
    turn[np.lexsort((first + lead, sid))] = np.arange(m)
    earliest = np.minimum.reduceat(turn[phrase], np.flatnonzero(new))
    again = turn[phrase] != earliest[np.cumsum(new) - 1]
    start = (first[phrase] + at)[again]
    (doc, start), end = merge_spans(sid[phrase][again], start, start + length)
    return doc, start, end


def ordered(phrases: DataFrame, length: int) -> DataFrame:
    """Spans of kind 0 of `phrases` (of phrase_bytes): whole triggers at a time are put in corpus order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def found() -> pa.RecordBatch:
            sid, first, lead, bodies = zip(*held, strict=True)
            doc, start, end = ordered_repeats(*(np.array(x, np.int64) for x in (sid, first, lead)), list(bodies), length)
            return pa.RecordBatch.from_pydict({"kind": np.zeros(len(doc), np.int32), "sid": doc, "first": start, "last": end, "lead": np.zeros(len(doc), np.int64)})

        for batch in batches:
            for trigger, *row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "sid", "first", "lead", "bytes")), strict=True):
                if trigger != last and size > TOGETHER_BYTES:
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
                last = trigger
        if held:
            yield found()

    n = partitions(phrases.sparkSession)
    return phrases.repartition(n, "trigger").sortWithinPartitions("trigger").mapInArrow(released(run), SPANS)


def repeats(phrases: DataFrame, length: int, together: int = TOGETHER) -> DataFrame:
    """Kind 0: spans of bytes that repeat earlier ones. Kind 1: first and last start of phrases that share a trigger with another
    one, each phrase by its first place; kind 2: those of a trigger of more than `together` phrases. Works through the sorted
    phrases in a stream; holds the phrases of one trigger, `together` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = phrase = None  # of the row before
        held: list[tuple[np.ndarray, ...]] = []  # different phrases of the trigger that is not done
        n, over = 0, False
        out: list[tuple] = []

        def add(rows: tuple[np.ndarray, ...]) -> None:
            nonlocal held, n, over
            held.append(rows)
            n += len(rows[0])
            over = over or n > together
            if over:
                out.extend((2, *x) for x in held)
                held = []

        def close() -> None:
            nonlocal held, n, over
            if n > 1:
                out.extend((1, *x) for x in held)
            held, n, over = [], 0, False

        def batch_of() -> pa.RecordBatch:
            none = np.zeros(0, np.int64)
            kinds, *columns = zip(*[(np.full(len(x[1]), x[0], np.int32), *x[1:]) for x in [*out, (0, none, none, none, none)]], strict=True)
            out.clear()
            return pa.RecordBatch.from_pydict(dict(zip(("kind", "sid", "first", "last", "lead"), map(np.concatenate, (kinds, *columns)), strict=True)))

        for batch in batches:
            if not batch.num_rows:
                continue
            sent = batch.column("trigger").is_null().to_numpy(zero_copy_only=False)
            ready = [batch.column(c).to_numpy()[sent] for c in ("sid", "place", "phrase")]
            out.append((0, *ready, np.zeros(len(ready[0]), np.int64)))
            rows = batch.filter(pa.array(~sent))
            if rows.num_rows:
                t, p, sid, place = (rows.column(c).to_numpy() for c in ("trigger", "phrase", "sid", "place"))
                low, high, lead = place >> 16, (place >> 16) + (place & 255), place >> 8 & 255
                new_key = np.concatenate(([key is None or t[0] != key], t[1:] != t[:-1]))
                new = new_key | np.concatenate(([phrase is None or p[0] != phrase], p[1:] != p[:-1]))
                out.append((0, sid[~new], low[~new], high[~new] + length, lead[~new]))
                once = np.flatnonzero(new)
                group = np.cumsum(new_key)[once]  # 0 goes on from the batch before
                pick = lambda at: (sid[at], low[at], high[at], lead[at])  # noqa: E731, B023
                if (goes_on := once[group == 0]).size:
                    add(pick(goes_on))
                end = int(np.count_nonzero(new_key))
                if end:
                    close()
                    counts = np.bincount(group, minlength=end + 1)[group]
                    whole = (group > 0) & (group < end)
                    out.append((1, *pick(once[whole & (counts > 1) & (counts <= together)])))
                    out.append((2, *pick(once[whole & (counts > together)])))
                    add(pick(once[group == end]))
                key, phrase = t[-1], p[-1]
            yield batch_of()
        close()
        yield batch_of()

    n = partitions(phrases.sparkSession)
    dealt = phrases.repartition(n, F.coalesce("trigger", F.xxhash64("sid", "place")))
    return dealt.sortWithinPartitions("trigger", "phrase", "sid", "place").mapInArrow(released(run), SPANS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with sid: a long, distinct, ascending with doc_id. The doc_id itself where it is distinct and never null;
    else by doc_id (nulls last), then text."""
    n, some, distinct = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == some == distinct:
        return docs.withColumn("sid", F.col("doc_id").cast("long"))
    return stored(in_order(docs, "doc_id", "text").drop("slot").withColumn("sid", F.monotonically_increasing_id()), "numbered")


def repeated_spans(docs: DataFrame, length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """sid, spans (array of first, last; end exclusive; not merged): the bytes of `docs` (sid, text) in strings of `length`
    bytes that start earlier too. Rows without any do not appear."""
    if not TRIGGER < length < 256:
        raise ValueError(f"a length between {TRIGGER} and 256 is needed")
    found = stored(repeats(parse(docs, length), length, together), "phrases")
    own = F.collect_list(F.struct("kind", "first", "last", "lead")).alias("spans")
    texts = docs.join(found.where("kind > 0").groupBy("sid").agg(own), "sid")  # a document's spans are fewer than its bytes
    rest = ordered(phrase_bytes(texts, length), length).unionByName(repeats(strings(texts, length), length).where("kind = 0"))
    rest = stored(rest, "strings")
    return found.where("kind = 0").unionByName(rest).groupBy("sid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def whole_characters(blob: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the bytes at its ends that belong to characters which it cuts."""
    while start < end and blob[start] & 0xC0 == 0x80:
        start += 1
    if end < len(blob) and blob[end] & 0xC0 == 0x80:
        while end > start and blob[end] & 0xC0 == 0x80:
            end -= 1
    return start, end


def without_repeats(docs: DataFrame, length: int = LENGTH, together: int = TOGETHER, whole: bool = False) -> DataFrame:
    """Every row of `docs` (doc_id, text, any others) with kept (binary: the bytes left), n_bytes, n_removed, n_spans.

    A byte goes if it lies in a string of `length` bytes that also starts earlier in the input: in a smaller doc_id, or
    earlier in the same document. Strings never cross documents. A null text is empty; of rows with one doc_id, the one
    with the smaller text comes first; null doc_ids come last. Texts shorter than `length` stay whole. With `whole`, what is left of a
    character that a removed span cut goes from `kept` too (the counts do not tell), so it is text as before.
    """
    docs = numbered(docs)
    names = [c for c in docs.columns if c != "sid"]
    joined = docs.join(repeated_spans(docs.select("sid", "text"), length, together).withColumnRenamed("spans", "_spans"), "sid", "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows = batch.column("_spans"), []
            for i, blob in enumerate(blobs_of(batch.column("text"))):
                own = spans[i].values
                if own is None or not len(own):
                    rows.append((blob, len(blob), 0, 0))
                    continue
                first, last = own.field("first").to_numpy(), own.field("last").to_numpy()
                (_, a), b = merge_spans(np.zeros(len(first), np.int64), first, last)
                left = list(zip([0, *b.tolist()], [*a.tolist(), len(blob)], strict=True))
                removed = len(blob) - sum(y - x for x, y in left)
                kept = b"".join(blob[x:y] for x, y in (map(lambda span: whole_characters(blob, *span), left) if whole else left))  # noqa: B023
                rows.append((kept, len(blob), removed, len(a)))
            kept, *counts = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in counts)], [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.select(*names, "_spans").mapInArrow(released(cut), f"{kinds}, kept binary, n_bytes long, n_removed long, n_spans long")


def digests(docs: DataFrame, length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    found = without_repeats(docs.select("doc_id", "text"), length, together)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
