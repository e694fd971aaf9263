"""SentencePiece encoding with merge-type vocabularies, and decoding.

A text's symbols are its characters at first. An agenda holds the adjacent pairs that together are a piece, the best
score first and of equal scores the leftmost; the top pair is merged and its new neighbours enter, until none is left.
Symbols that are no piece become bytes. A text is cut where no piece of the vocabulary can reach across, so a word is
worked out once a worker; each such word is checked against the sentencepiece library as it is learnt, a batch at a time, and has
the library's ids should they differ.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from motley.llm.common import text_slices, texts_of
from motley.llm.wordcache import WordMemory, turns

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words kept by a worker in each of two generations.
CACHE_WORDS = 500_000
#: Marks that end words.
MARKS = frozenset(",.;:!?")
TURN_CHARS = 400_000


class MergeEncoder:
    def __init__(self, path: str, check: bool = True):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m, self.check = self.library, check
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.cost = {p: -m.get_score(i) for p, i in self.ids.items()}
        self.bytes = {b: m.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.unknown, self.end = m.unk_id(), m.eos_id()
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if m.encode("a b", out_type=str)[0][:1] != SPACE or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a vocabulary with a dummy prefix and no piece beyond a word is needed")
        self.decimal = [str(i).encode() for i in range(n)]
        self.memory = WordMemory(self._learn, CACHE_WORDS)

    def merged(self, text: str) -> list[int]:
        """The ids of a text without blanks to add or replace, by the agenda."""
        n, cost = len(text), self.cost
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the symbol that starts here; 0: none does
        agenda = [(c, i, i + 1, i + 2) for i in range(n - 1) if (c := cost.get(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, mid, stop = heapq.heappop(agenda)
            if end[i] != mid or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (c := cost.get(text[i : end[stop]])) is not None:
                    heapq.heappush(agenda, (c, i, stop, end[stop]))
            if (j := before[i]) >= 0 and (c := cost.get(text[j:stop])) is not None:
                heapq.heappush(agenda, (c, j, i, stop))
        out, i = [], 0
        while i < n:
            piece = text[i : end[i]]
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.bytes[0] != self.unknown:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            i = end[i]
        return out

    def word(self, word: str) -> list[int]:
        if word[-1] in MARKS and len(word) > 1 and word[-2:] not in self.joins:  # no piece reaches across
            stem = word[:-1]
            known = self.memory.young.get(stem) or self.memory.old.get(stem)
            return [*(array.array("I", known) if known else self.merged(stem)), *self.merged(word[-1])]
        return self.merged(word)

    def words_of(self, text: str) -> list[str]:
        if "  " in text or SPACE in text or "\0" in text or text[:1] == " " or text[-1:] == " ":
            return WORD.findall(SPACE + text.replace(" ", SPACE))
        return f" {text}".replace(" ", f"\0{SPACE}").split("\0")[1:] if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, the end id last."""
        end = array.array("I", [self.end]).tobytes()
        return [np.frombuffer(x, "<u4") for turn in turns(texts, self.words_of, TURN_CHARS) for x in self.memory.joined(turn, end)]

    def _learn(self, words: list[str]) -> list[bytes]:
        own = [self.word(x) for x in words]
        if self.check:
            theirs = self.library.encode([x[1:].replace(SPACE, " ") for x in words], num_threads=1) if words else []
            # where they differ the library's count; it adds no blank to an empty text
            own = [a if a == b or word == SPACE else b for word, a, b in zip(words, own, theirs, strict=True)]
        return [array.array("I", x).tobytes() for x in own]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


@functools.lru_cache(2)
def merge_encoder(path: str) -> MergeEncoder:
    """One encoder a worker process."""
    return MergeEncoder(path)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by blanks), decoded_sha256 of every row of `docs` (doc_id, text).

    A null text is empty: the end id alone. Repeated rows stay; other columns play no part.
    """
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(model)
        decimal = encoder.decimal.__getitem__
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [x.tolist() for x in encoder.encode(texts_of(part.column("text")))]
                said = [hashlib.sha256(b" ".join(map(decimal, x))).hexdigest() for x in ids]
                back = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in encoder.decode(ids)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {kinds}")
