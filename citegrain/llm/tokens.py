"""Token ids of whole texts with the public tokenizers, in bounded memory.

A text is cut where no token can cross, each distinct piece is encoded once by the tokenizers library, and
the ids of pieces are kept as bytes (little-endian, 32 bits) in a cache of at most about 2 * CACHE_BYTES (twice
that for byte vocabularies), one per Python worker.  The ids are those of encoding the whole text at once; tests compare them.  The strings of
special tokens are ordinary text, as the vocabularies' description has it.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

CACHE_BYTES = 56 << 20
ENTRY_BYTES = 200
MARKS = ".,!?;:"
LOWER_AND_BLANK = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", b"abcdefghijklmnopqrstuvwxyz ")
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[list(MARKS.encode())] = True
_ENCODERS: dict = {}


class Encoder:
    """`words`: the tokenizer drops white space, so texts are cut at blanks and line ends; else a token may
    begin with one blank, so they are cut before single blanks and around single line ends."""

    _odd = re.compile(r"^\s|\s\Z|\s[^\S \n]|[^\S \n]\s|[ \n]{2}")

    def __init__(self, path: str, words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, pieces: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        for piece, e in zip(pieces, encoded):
            self._keep(piece, array("I", e.ids).tobytes())

    def most(self) -> int:
        return CACHE_BYTES if self.words else 2 * CACHE_BYTES

    def _keep(self, piece: str, ids: bytes) -> None:
        self.young[piece] = ids
        self.held += ENTRY_BYTES + len(piece) + len(ids)

    def _learn(self, missing: set[str]) -> None:
        """Encode the pieces that are in neither cache; one mark after a letter is a token of its own."""
        young, old = self.young, self.old
        new, ended = [], []
        for piece in missing:
            if piece in old:
                self._keep(piece, old[piece])
            elif len(piece) > 1 and piece[-1] in MARKS and piece[-2].isalpha():
                ended.append(piece)
            else:
                new.append(piece)
        stems = {p[:-1] for p in ended}.union(p[-1] for p in ended).difference(young, new)
        for stem in [s for s in stems if s in old]:
            self._keep(stem, old[stem])
            stems.discard(stem)
        self._encode([*new, *stems])
        for piece in ended:
            self._keep(piece, young[piece[:-1]] + young[piece[-1]])

    def _joined(self, pieces: list[str]) -> bytes:
        missing = set(pieces).difference(self.young)
        if missing and self.held > self.most():  # turned over between texts only: a text needs all its pieces at once
            self.old, self.young, self.held = self.young, {}, 0
            missing = set(pieces)
        if missing:
            self._learn(missing)
        return b"".join(map(self.young.__getitem__, pieces))

    def _table(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, in their order."""
        young, old = self.young, self.old
        if self.held > self.most():
            self.old, self.young, self.held = young, {}, 0
            young, old = self.young, self.old
        new = []
        for piece in pieces:
            if piece not in young:
                if piece in old:
                    self._keep(piece, old[piece])
                else:
                    new.append(piece)
        if new:
            self._encode(new)
        return [young[p] for p in pieces]

    def _odd_texts(self, data: np.ndarray, texts: list[str], ends: np.ndarray) -> np.ndarray:
        """Which of the texts are cut at runs of white space; the expression is tried where a byte leaves doubt."""
        blank = (data == 10) | (data == 32)
        apart = blank.copy()
        apart[1:] &= blank[:-1]
        starts = np.concatenate(([0], ends[:-1] + 1))
        odd = np.logical_or.reduceat(apart, starts)
        doubt = np.logical_or.reduceat((data >= 127) | (data < 32) & ~blank, starts)
        for i in np.flatnonzero(doubt & ~odd).tolist():
            odd[i] = bool(self._odd.search(texts[i]))
        return odd

    def many(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts, each followed by `end`, as one array, and how many each text has with it.

        Only for `words` false.  Pieces are cut, also between a letter and a mark, and told apart for all texts at
        once; texts with runs of white space are encoded one by one, and an empty line stands in their place.
        """
        plain = [t.encode() for t in texts]
        ends = np.cumsum([len(p) + 1 for p in plain]) - 1
        data = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
        odd = self._odd_texts(data, texts, ends)
        if odd.any():
            plain = [b"" if o else p for p, o in zip(plain, odd)]
            ends = np.cumsum([len(p) + 1 for p in plain]) - 1
            data = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
        line_end = data == 10
        cut = line_end | (data == 32)
        cut[1:] |= line_end[:-1] | (LETTER[data[:-1]] & MARK[data[1:]])
        cut[0] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        found = found.dictionary_encode()
        table = self._table(found.dictionary.to_pylist())
        # the line end behind each text stands for its end, and for the whole of an odd text
        behind = np.searchsorted(starts, ends)
        which = found.indices.to_numpy().astype(np.int64)
        which[behind] = len(table) + np.arange(len(texts))
        table += [self.ids(t) + end if o else end for t, o in zip(texts, odd)]
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        ids = np.frombuffer(b"".join(table), "<u4")
        begin, sizes = (np.cumsum(size) - size)[which], size[which]
        to = np.cumsum(sizes)
        return ids[np.repeat(begin - (to - sizes), sizes) + np.arange(to[-1])], np.diff(to[behind], prepend=0)

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.words:
            # the tokenizer lower-cases; doing so for A-Z before makes fewer pieces
            plain = text.encode("utf-8", "surrogatepass").translate(LOWER_AND_BLANK).decode("utf-8", "surrogatepass")
            return self._joined(plain.split(" "))
        if self._odd.search(text):
            # runs of white space: cut only before a blank between two other characters
            return self._joined(re.split(r"(?<=\S)(?= \S)", text))
        return self._joined(re.findall(r"\n| ?[^ \n]+", text))


def encoder(path: str, words: bool) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    key = (path, words)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, words)
    return _ENCODERS[key]
