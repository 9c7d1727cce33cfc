"""Hashes of the terms of whole texts, and stated item sets in blocks of bounded size.

A term is a maximal run of digits, letters A-Z (lower-cased) and bytes above 127 of the text's UTF-8 form.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from citegrain.llm.census import LOWER, cut, prefix_hashes, span_hashes
from citegrain.llm.texts import slices

LAST_ID = (1 << 63) - 1
SLICE_BYTES = 1 << 20
ITEM_BYTES = (16 << 20, 16 << 20)
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[97:123] = TERM[128:] = True
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _hashes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)]
    edges = np.diff(TERM[data], prepend=False, append=False).nonzero()[0]
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([0] + [len(p) + 1 for p in pieces])
    return span_hashes(prefix_hashes(data), starts, ends), np.diff(np.searchsorted(starts, bounds))


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of some texts in order, and the number of terms of each text.

    Long texts are hashed in pieces that end between terms, so that memory follows the slice, not the text.
    """
    pieces, owner = [], []
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > SLICE_BYTES and (gap := _GAP.search(text, at + SLICE_BYTES)):
            pieces.append(text[at:gap.end()])
            owner.append(i)
            at = gap.end()
        pieces.append(text[at:])
        owner.append(i)
    done = [_hashes(pieces[a:b]) for a, b in slices([len(p) for p in pieces], SLICE_BYTES)]
    if not done:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.zeros(len(texts), np.int64)
    np.add.at(counts, owner, np.concatenate([c for _, c in done]))
    return np.concatenate([h for h, _ in done]), counts


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list[bytes], list]]:
    """Runs of rows of about `most` bytes of text: ids (null: the largest), texts, and the rows' other columns.

    Batches are put together until a shard is full; a batch that holds more is cut.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).to_pylist()
        for a, b in slices(lengths, most):
            if held and size + sum(lengths[a:b]) > most:
                yield _shard(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += sum(lengths[a:b])
    if held:
        yield _shard(held)


def _shard(held: list[pa.RecordBatch]):
    table = pa.Table.from_batches(held)
    ids = table.column(0).fill_null(LAST_ID).to_numpy().astype(np.int64)
    return ids, table.column(1).cast(pa.binary()).to_pylist(), [table.column(i) for i in range(2, table.num_columns)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows that hold large values, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[Row]]:
    """The distinct (id, text) rows of a stated query set, in blocks of about 16 MB, one at a time.

    Only one block is held at a time; what tasks get of it is bounded by its size and by the longest item.
    """
    rows = items.select(F.col(item_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.distinct()
    blocks = cut(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, ITEM_BYTES)
    number = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield sorted(rows.where(number == b).collect(), key=lambda r: (r.id is None, r.id, r.text))
