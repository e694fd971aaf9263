"""Fill-in-middle: texts cut in prefix, middle and suffix at token ranks, and put together in another order.

Tokens are runs of ASCII letters and single other characters. One automaton goes over the text and reports two kinds of events:
characters where the class changes (a letter after another character, or the reverse) and sentinels. Between two changes a gap is of
one class, so its tokens are known without looking: one of a gap of letters, as many as it is long of any other. Ranks of tokens
are looked up among the gaps. Characters beyond ASCII, a class of one kind, go to the automaton as one sign each.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.common import released, text_slices, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of a hundred texts, those that are cut; of these, the share whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Events taken from the automaton at once.
EVENTS = 1 << 18
LETTER, OTHER = ord("a"), ord(" ")
CHANGE, SENTINEL = 0, 1


@functools.lru_cache(1)
def scanner() -> tuple[ahocorasick.Automaton, bytes]:
    """The automaton, and what it is to be given for each ASCII byte: signs of sentinels as they are, else one sign a class."""
    marks = {*PREFIX, *SUFFIX, *MIDDLE}
    letters = [chr(LETTER), *sorted(c for c in marks if c.isalpha())]
    others = [chr(OTHER), *sorted(c for c in marks if not c.isalpha())]
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for a in letters:
        for b in others:
            found.add_word(a + b, CHANGE)
            found.add_word(b + a, CHANGE)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(mark, SENTINEL)
    found.make_automaton()
    return found, bytes(c if chr(c) in marks else LETTER if chr(c).isascii() and chr(c).isalpha() else OTHER for c in range(256))


def events(text: str) -> tuple[np.ndarray, bool]:
    """Where gaps of one class begin, and the text's length; and whether a sentinel is in it."""
    automaton, signs = scanner()
    flat = chain.from_iterable(automaton.iter(text.encode("ascii", "replace").translate(signs).decode("ascii")))
    begins, sentinel = [np.zeros(min(1, len(text)), np.int64)], False
    while len(part := np.fromiter(islice(flat, 2 * EVENTS), np.int64)):
        at, kind = part[::2], part[1::2]
        sentinel |= bool((kind == SENTINEL).any())
        begins.append(at[kind == CHANGE])
    return np.concatenate([*begins, [len(text)]]), sentinel


class Ranks:
    """Token counts of a text by its gaps."""

    def __init__(self, text: str):
        self.begins, self.sentinel = events(text)
        size = np.diff(self.begins)
        first = 0 if text[:1].isascii() and text[:1].isalpha() else 1  # classes take turns
        size[first::2] = 1
        self.before = np.concatenate(([0], np.cumsum(size)))
        self.n = int(self.before[-1])

    def place(self, rank: int) -> int:
        """Where the token of a rank begins; the text's length for the rank after the last."""
        gap = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.begins[gap]) + rank - int(self.before[gap])


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, ...]:
    """Four whole numbers below 2^32 of a document; a null doc_id counts as no digits."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4))


def transformed(docs: DataFrame, seed: str = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output of every row of `docs` (doc_id, text).

    form psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle; plain: the text as it is, with null prefix_chars and
    middle_chars. Plain are empty and null texts, texts with a sentinel and those beyond `cut_percent`. Repeated rows stay, and those
    of one doc_id are drawn alike for texts of one length; other columns play no part. A task holds some texts of one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text")), strict=True):
                    ranks, (h1, h2, h3, h4) = Ranks(text), draws(doc_id, seed)
                    if not text or ranks.sentinel or h3 % 100 >= cut_percent:
                        out.append((doc_id, ranks.n, "plain", None, None, text))
                        continue
                    a, b = (ranks.place(x) for x in sorted((h1 % (ranks.n + 1), h2 % (ranks.n + 1))))
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    first = h4 % 100 < suffix_first_percent
                    put = (SUFFIX, suffix, PREFIX, prefix) if first else (PREFIX, prefix, SUFFIX, suffix)
                    out.append((doc_id, ranks.n, "spm" if first else "psm", a, b - a, "".join((*put, MIDDLE, middle))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. No text that was cut holds a sentinel, so the first of each is the one put in."""

    def between(first: str, then: str | None) -> Column:
        begin = F.instr(output, first) + len(first)
        return F.substring(output, begin, F.length(output) if then is None else F.instr(output, then) - begin)

    middle = between(MIDDLE, None)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text restored from it."""
    out = transformed(docs)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
