"""Counting very many hashes over all documents without a row for each.

Documents are dealt to blocks of some megabytes.  A block sends its distinct hashes with their counts, as one
binary value for each part of the hash space; a part adds up what all blocks sent and answers every block
in the order of its hashes.  Hot hashes cost one entry per block, whatever their number of occurrences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Smallest and largest: a task holds some ten times a block or a part, whatever the total.
BLOCK_BYTES = (1 << 20, 8 << 20)
PART_BYTES = (3 << 20, 12 << 20)
FAN = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def cut(total: int, bounds: tuple[int, int]) -> int:
    """Number of pieces of a total of bytes; their size grows with the total within bounds."""
    return max(1, -(-total // min(max(total // FAN, bounds[0]), bounds[1])))


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial sums before each place; with `span_hashes` the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of some texts, where their words start and end, and the number of words of each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~BLANK[data]
    edges = np.diff(inside, prepend=False, append=False).nonzero()[0]
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, starts, ends, np.diff(np.searchsorted(starts, bounds))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, A-Z lower-cased, and the number of words of each text."""
    data, starts, ends, counts = word_spans(texts)
    return span_hashes(prefix_hashes(data), starts, ends), counts


def parts_of(hashes: np.ndarray, parts: int, top: int) -> np.ndarray:
    """Where each part begins in sorted hashes below `top`."""
    edges = [p * top // parts for p in range(1, parts)]
    inner = np.searchsorted(hashes, np.array(edges, np.uint64)) if edges else np.zeros(0, np.int64)
    return np.concatenate(([0], inner, [len(hashes)]))


REPORT = "block bigint, part int, hashes binary, counts binary"


def report(block: int, hashes: np.ndarray, counts: np.ndarray, parts: int, top: int = 1 << 64) -> pa.Table:
    """What a block sends: its sorted distinct hashes, all below `top`, and their counts, by part."""
    at = parts_of(hashes, parts, top)
    full = [p for p in range(parts) if at[p] < at[p + 1]]
    return pa.table({
        "block": pa.array([block] * len(full), pa.int64()),
        "part": pa.array(full, pa.int32()),
        "hashes": pa.array([hashes[at[p]:at[p + 1]].astype("<u8").tobytes() for p in full], pa.binary()),
        "counts": pa.array([counts[at[p]:at[p + 1]].astype("<u4").tobytes() for p in full], pa.binary()),
    })


def answers(
    reports: DataFrame,
    finish: Callable[[np.ndarray], np.ndarray],
    summary: Callable[[np.ndarray, np.ndarray], bytes] | None = None,
) -> DataFrame:
    """(block, part, totals): for each hash sent, in the order sent, `finish` of its total over all blocks.

    With `summary`, each part adds a row of block -1 that holds what `summary` makes of its distinct hashes and
    their totals.
    """

    def add_up(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(b, "<u8") for b in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("counts").to_pylist()])
        every = np.concatenate(sent)
        order = np.argsort(every, kind="stable")
        first = np.diff(every[order], prepend=~every[order[:1]]) != 0
        totals = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first))
        back = np.empty(len(every), np.int64)
        back[order] = totals[np.cumsum(first) - 1]
        done = finish(back)
        at = np.cumsum([0] + [len(s) for s in sent])
        told = [done[at[i]:at[i + 1]].tobytes() for i in range(len(sent))]
        blocks, parts = table.column("block").to_pylist(), table.column("part").to_pylist()
        if summary:
            blocks, parts = [*blocks, -1], [*parts, parts[0]]
            told.append(summary(every[order][first], totals))
        return pa.table({
            "block": pa.array(blocks, pa.int64()), "part": pa.array(parts, pa.int32()),
            "totals": pa.array(told, pa.binary()),
        })

    return reports.groupBy("part").applyInArrow(add_up, "block bigint, part int, totals binary")


def answered(table: pa.Table, kind: str) -> np.ndarray:
    """The totals of a block's hashes, in their order."""
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    blobs = table.column("totals").to_pylist()
    return np.frombuffer(b"".join(blobs[i] for i in order), kind)
