"""Token ids of whole texts by the tokenizers library, each distinct word encoded once a worker.

A byte-level BPE splits a text before it merges, and always splits before a single space or line feed that
stands between two characters that are no white space. Texts are cut there and nowhere else, so the ids of the
words, joined, are the ids of the text. For the same reason many new words are learnt as one text: each id that
begins with a space or a line feed begins a word. Texts with the string of a special token go to the library whole.

Words are known by a 64-bit hash of their bytes, worked out for all words of a piece at once, and looked up in order of their hashes.
Two of the million words that a worker keeps have the same hash with a chance of about 10^-7.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
from tokenizers import Tokenizer  # noqa: E402

from motley.llm.common import mixed  # noqa: E402

#: Words kept by a worker; with more it begins anew.
CACHE_WORDS = 1_500_000
#: Longer words (in characters) are encoded but not kept; so are words of more bytes.
KEPT_CHARS = 64
KEPT_BYTES = KEPT_CHARS
#: Bytes of text hashed in one go, so that what is made of them stays in a core's cache.
PIECE = 1 << 19
#: New words learnt as one text.
LEARNT_TOGETHER = 2000
#: What a space and a line feed are in the vocabulary. (fixed values)
SPACE, LINE_FEED = "Ġ", "Ċ"


def stands_apart(word: str) -> bool:
    """Whether its only white space is one space or line feed in front."""
    return word[:1] in (" ", "\n") and [word[1:]] == word.split()


class WordMemory:
    """What a worker knows of words, in two generations of bounded size: when the younger is full, the older is dropped.

    learn gives the values of words not known; a word is learnt again after it was dropped, which costs time only.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], words: int):
        self.learn, self.words = learn, words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def joined(self, texts: list[list[str]], end: bytes = b"") -> list[bytes]:
        """Of each text, the values of its words and the end, joined."""
        if len(self.young) > self.words:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        unseen = set(filterfalse(young.__contains__, chain.from_iterable(texts)))
        young.update({x: old.pop(x) for x in unseen & old.keys()} if old else {})
        new = list(filterfalse(young.__contains__, unseen))
        young.update(zip(new, self.learn(new), strict=True))
        get = young.__getitem__
        out = [b"".join([*map(get, x), end]) for x in texts]
        for word in [x for x in new if len(x) > KEPT_CHARS]:
            del young[word]
        return out


def turns(texts: list[str], cut: Callable[[str], list[str]], chars: int) -> Iterator[list[list[str]]]:
    """The words of the texts, a few texts at a time."""
    out, held = [], 0
    for text in texts:
        out.append(cut(text))
        held += len(text)
        if held > chars:
            yield out
            out, held = [], 0
    yield out


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin in texts data[bounds[i]:bounds[i + 1]]: at a text's begin, and before a single space or line feed between two
    characters that are visible ASCII signs or two-byte characters from U+00A1 on."""
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    a, b, c, d = data[np.maximum(at - 2, 0)], data[at - 1], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    before = (b > 0x20) & (b < 0x7F) | (b >= 0x80) & (b < 0xC0) & (a >= 0xC2) & (a < 0xE0) & ~((a == 0xC2) & (b <= 0xA0))
    after = (c > 0x20) & (c < 0x7F) | (c >= 0xC3) & (c < 0xE0) | (c == 0xC2) & (d > 0xA0)
    begins = np.zeros(len(data) + 1, bool)
    begins[at[before & after]] = True
    begins[bounds[1:-1] - 1] &= np.diff(bounds)[:-1] == 1  # a text's last byte begins no word unless it is the text
    begins[bounds] = True
    return np.flatnonzero(begins[:-1])


class Grown:
    """A numpy array that is added to at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.zeros(max(len(more), self.n), self.held.dtype)))
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


class Places:
    """The number of each known hash: two sorted arrays, a large one and one of what came since."""

    def __init__(self):
        self.large = self.late = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of ascending hashes, -1 where unknown."""
        out = np.full(len(hashes), -1)
        for keys, numbers in (self.large, self.late):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, numbers[at], out)
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        self.late = self._merged(self.late, (hashes, numbers))
        if len(self.late[0]) > max(1 << 15, len(self.large[0]) // 8):
            self.large, self.late = self._merged(self.large, self.late), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, numbers = (np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.argsort(keys, kind="stable")
        return keys[order], numbers[order]


#: A random number for each byte value, and powers of an odd number for its place in a word.
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(KEPT_BYTES, 0x9E3779B97F4A7C15, np.uint64))


class WordEncoder:
    def __init__(self, path: str, words: int = CACHE_WORDS):
        self.library, self.words = Tokenizer.from_file(path), words
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] in (SPACE, LINE_FEED)]] = True
        self._forget()

    def _forget(self) -> None:
        self.places, self.start, self.length, self.ids = Places(), Grown(np.int64), Grown(np.int64), Grown(np.uint32)

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words stored by their ids, one after another: their numbers."""
        first = self.start.n
        self.start.add(self.ids.n + np.cumsum(length) - length)
        self.length.add(length)
        self.ids.add(ids)
        return np.arange(first, self.start.n)

    def _kept(self, words: list[str]) -> np.ndarray:
        """The words learnt and stored: their numbers."""
        apart = [i for i, x in enumerate(words) if x[:1] in (" ", "\n")]
        some = [words[i] for i in apart]
        if "".join(some).split() != [x[1:] for x in some]:
            apart = [i for i in apart if stands_apart(words[i])]
            some = [words[i] for i in apart]
        out, rest = np.full(len(words), -1), np.ones(len(words), bool)
        rest[apart] = False
        for i in range(0, len(some), LEARNT_TOGETHER):
            part = some[i : i + LEARNT_TOGETHER]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(part):
                out[apart[i : i + len(part)]] = self._store(ids, np.diff(starts, append=len(ids)))
            else:
                rest[apart[i : i + len(part)]] = True
        if rest.any():
            at = np.flatnonzero(rest)
            found = self._alone([words[i] for i in at.tolist()])
            out[at] = self._store(np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64))
        return out

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word of a piece, from data[starts] to data[ends]; the words follow each other."""
        size = ends - starts
        short = size <= KEPT_BYTES
        every = bool(short.all())
        out = np.empty(len(starts), np.int64)
        base = int(starts[0])
        text = data[base : ends[-1]]
        within = np.arange(len(text), dtype=np.int32) - np.repeat((starts - base).astype(np.int32), size)
        if not every:
            np.minimum(within, KEPT_BYTES - 1, out=within)
        with np.errstate(over="ignore"):
            hashes = mixed(np.add.reduceat(VALUES[text] * POWERS[within], starts - base) + size.astype(np.uint64))
        hashes = hashes if every else hashes[short]
        order = np.argsort(hashes)
        ascending = hashes[order]
        new = np.ones(len(order), bool)
        np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
        known = ascending[new]
        numbers = self.places.get(known)
        unseen = np.flatnonzero(numbers < 0)
        if len(unseen) or not every:
            raw = text.tobytes()
            raw = raw.decode() if raw.isascii() else raw

            def said(at: np.ndarray) -> list[str]:
                cut = list(map(raw.__getitem__, map(slice, (starts[at] - base).tolist(), (ends[at] - base).tolist())))
                return cut if isinstance(raw, str) else [x.decode() for x in cut]

        if len(unseen):
            at = order[new][unseen]
            numbers[unseen] = self._kept(said(at if every else np.flatnonzero(short)[at]))
            self.places.add(known[unseen], numbers[unseen])
        which = np.empty(len(order), np.int64)
        which[order] = numbers[np.cumsum(new) - 1]
        if every:
            return which
        out[short] = which
        out[~short] = self._kept(said(np.flatnonzero(~short)))  # without a place: not found again
        return out

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, and their number), each text's end id last if there is one. Nulls are empty texts."""
        if self.start.n > self.words or self.ids.n > 8 * self.words:
            self._forget()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n, ends = len(column), 0 if end_id is None else 1
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        counts, numbers, owner = np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole: dict[int, np.ndarray] = {}
        if len(data):
            special = np.zeros(n, bool)
            for x in self.special:
                special |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
            starts = word_starts(data, bounds)
            stops = np.append(starts[1:], len(data))
            owner = np.searchsorted(bounds, starts, side="right") - 1
            if special.any():
                whole = {int(i): np.frombuffer(x, "<u4") for i, x in zip(np.flatnonzero(special), self._alone([column[int(i)].as_py() for i in np.flatnonzero(special)]), strict=True)}
            cuts = np.searchsorted(starts, np.arange(PIECE, len(data), PIECE))
            groups = np.unique(np.concatenate(([0], cuts, [len(starts)])))
            numbers = np.concatenate([self._numbers(data, starts[a:b], stops[a:b]) for a, b in zip(groups[:-1], groups[1:], strict=True)])
            if whole:
                kept = ~special[owner]
                numbers, owner = numbers[kept], owner[kept]
        size = self.length.values[numbers]
        counts += np.bincount(owner, weights=size, minlength=n).astype(np.int64)
        for i, x in whole.items():
            counts[i] = len(x)
        ids_bounds = np.concatenate(([0], np.cumsum(counts + ends)))
        out = np.empty(int(ids_bounds[-1]), np.uint32)
        before = np.cumsum(size) - size
        got = self.ids.values[np.arange(int(size.sum())) + np.repeat(self.start.values[numbers] - before, size)]
        texts, index = np.unique(owner, return_index=True)
        for i, a, b in zip(ids_bounds[texts].tolist(), before[index].tolist(), np.append(before[index][1:], len(got)).tolist(), strict=True):
            out[i : i + b - a] = got[a:b]
        for i, x in whole.items():
            out[ids_bounds[i] : ids_bounds[i] + len(x)] = x
        if ends:
            out[ids_bounds[1:] - 1] = end_id
        return out, ids_bounds


@functools.lru_cache(1)
def word_encoder(path: str, words: int = CACHE_WORDS) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path, words)
