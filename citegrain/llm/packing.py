"""Packing whole documents into token sequences by harmonic classes.

The capacity C is cut by reciprocals: class k takes pieces of C // k tokens, k to a sequence, for k up to
`classes`.  A document gives full sequences first; what is left gives one piece of the largest class that
fits, then the next, and so on.  Each partition fills its classes' sequences on its own.  Rests shorter than
the last class, and the pieces of sequences still open at the end, are strung together and cut at C; the very
last sequence is cut into powers of two, which need no padding.  No row is shuffled.

Defined results: a null or empty text has the end id alone; an empty table gives an empty result; rows that
repeat an id are packed one by one; the input's other columns are not read.  `sequence_id` has the partition
in its upper bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from citegrain.llm.tokens import encoder

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, padding bigint, tokens binary"
)
FLUSH_BYTES = 8 << 20


class Harmonic:
    """Open sequences of one worker.  A piece is (doc_id, start, tokens as bytes, doc_tokens)."""

    def __init__(self, capacity: int, classes: int):
        self.capacity = capacity
        self.sizes = [capacity // k for k in range(1, classes + 1)]
        self.open: list[list] = [[] for _ in self.sizes]
        self.rest: list = []
        self.rest_length = 0
        self.sequences = 0

    def _closed(self, pieces: list) -> Iterator[tuple]:
        at = 0
        filled = sum(len(p[2]) for p in pieces) // 4
        padding = 0 if filled & (filled - 1) == 0 else self.capacity - filled
        for doc_id, start, tokens, total in pieces:
            yield doc_id, start, len(tokens) // 4, zlib.crc32(tokens), total, self.sequences, at, padding, tokens
            at += len(tokens) // 4
        self.sequences += 1

    def _string(self, piece: tuple) -> Iterator[tuple]:
        doc_id, start, tokens, total = piece
        while tokens:
            head = tokens[: 4 * (self.capacity - self.rest_length)]
            self.rest.append((doc_id, start, head, total))
            self.rest_length += len(head) // 4
            start, tokens = start + len(head) // 4, tokens[len(head):]
            if self.rest_length == self.capacity:
                yield from self._closed(self.rest)
                self.rest, self.rest_length = [], 0

    def add(self, doc_id: int | None, tokens: bytes) -> Iterator[tuple]:
        total, at = len(tokens) // 4, 0
        k = 0
        while at < total:
            while k < len(self.sizes) and self.sizes[k] > total - at:
                k += 1
            if k == len(self.sizes):
                yield from self._string((doc_id, at, tokens[4 * at:], total))
                return
            size = self.sizes[k]
            self.open[k].append((doc_id, at, tokens[4 * at: 4 * (at + size)], total))
            at += size
            if len(self.open[k]) == k + 1:
                yield from self._closed(self.open[k])
                self.open[k] = []

    def finish(self) -> Iterator[tuple]:
        for pieces in self.open:
            for piece in pieces:
                yield from self._string(piece)
        while self.rest:
            power = 1 << (self.rest_length.bit_length() - 1)
            now, later, room = [], [], power
            for doc_id, start, tokens, total in self.rest:
                head, tail = tokens[: 4 * room], tokens[4 * room:]
                if head:
                    now.append((doc_id, start, head, total))
                if tail:
                    later.append((doc_id, start + len(head) // 4, tail, total))
                room -= len(head) // 4
            yield from self._closed(now)
            self.rest, self.rest_length = later, self.rest_length - power


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, classes: int = 16,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece, with its sequence, its place there, its tokens (32-bit) and the sequence's padding."""
    names = [n.split()[0] for n in SCHEMA.split(", ")]
    end = end_id.to_bytes(4, "little")

    def run(batches):
        packer = Harmonic(capacity, classes)
        base = TaskContext.get().partitionId() << 36
        encode = encoder(vocabulary, words=True)
        held: list[tuple] = []
        weight = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            columns[5] = [base + s for s in columns[5]]
            arrays = [pa.array(c, pa.binary() if n == "tokens" else pa.int64()) for n, c in zip(names, columns)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time becomes a string
                key, whole = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for piece in packer.add(key, encode.ids(whole or "") + end):
                    held.append(piece)
                    weight += 200 + len(piece[-1])
                    if weight >= FLUSH_BYTES:
                        yield batch_of(held)
                        held, weight = [], 0
        held.extend(packer.finish())
        if held:
            yield batch_of(held)

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA)
