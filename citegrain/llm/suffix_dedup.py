"""Removal of long byte strings that an earlier document has, by induced suffix sorting.

A string of `length` bytes that also starts in a document of smaller id is removed from every later document.
Each window of that length holds an anchor, the 20-byte string in it with the smallest hash; equal windows
have equal anchors at equal places.  A census finds the anchors that more than one document has.  The
stretches of text around those go to the shard of their anchor, each distinct stretch of a block once and
with its smallest id, so that all copies of a window meet in one shard however documents are dealt.

A shard strings its stretches together and sorts their suffixes by induction: the left-most S-type suffixes
first, then L-type and S-type suffixes from queues by first byte, which move to disk beyond a size.  Names of
the sorted S-type substrings make a shorter string, whose suffixes are ranked by doubling (its alphabet is too
large for one queue per symbol), up to the depth that windows need.  Neighbours in suffix order are compared
for a common prefix of a window's length; a run of such neighbours shares its smallest document id.  Blocks
get these ids back in the order in which they sent their stretches.

Defined results: a null text is empty; null ids are larger than all others; rows that repeat an id remove
nothing from each other; texts shorter than a window keep all bytes; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.census import (
    REPORT, answered, answers, cut, mixed, prefix_hashes, report, span_hashes, total_bytes,
)
from citegrain.llm.texts import slices
from citegrain.operators.durable import stored

LAST_ID = (1 << 63) - 1
ANCHOR = 20
BLOCK_BYTES = (2 << 20, 64 << 20)
PART_BYTES = (12 << 20, 24 << 20)
SHARD_BYTES = (1 << 20, 8 << 20)
SLICE_BYTES = 1 << 20
QUEUE_BYTES = 256 << 20
# Places that are taken from a queue at once; blocks of few places would cost a call each.
BATCH = 1 << 20
SENT = "block bigint, shard bigint, payload binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


class Queues:
    """First-in-first-out queues of suffixes, one per first symbol; beyond `most` bytes they go to disk.

    A queue keyed by the first symbol, filled in the order of the suffixes that induced it, yields its suffixes
    in sorted order: the priority of a tuple is (symbol, arrival).
    """

    def __init__(self, symbols: int, most: int = QUEUE_BYTES, kind: type = np.int64):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.most, self.held, self.file, self.kind = most, 0, None, np.dtype(kind)

    def add(self, symbol: int, block: np.ndarray) -> None:
        if self.held + block.nbytes > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.blocks[symbol].append((self.file.tell(), len(block)))
            self.file.write(block.tobytes())
        else:
            self.held += block.nbytes
            self.blocks[symbol].append(block)

    def block(self, symbol: int, i: int) -> np.ndarray:
        kept = self.blocks[symbol][i]
        if isinstance(kept, tuple):
            self.file.seek(kept[0])
            return np.frombuffer(self.file.read(self.kind.itemsize * kept[1]), self.kind)
        return kept

    def next(self, symbol: int, i: int) -> tuple[np.ndarray, int]:
        """What a queue holds from its i-th block on, up to `BATCH` places, and the number of the block after."""
        found, held = [self.block(symbol, i)], 0
        while i + len(found) < len(self.blocks[symbol]) and held + len(found[-1]) < BATCH:
            held += len(found[-1])
            found.append(self.block(symbol, i + len(found)))
        return np.concatenate(found), i + len(found)

    def all(self, symbol: int) -> np.ndarray:
        found = [self.block(symbol, i) for i in range(len(self.blocks[symbol]))]
        return np.concatenate(found) if found else np.zeros(0, self.kind)

    def deal(self, places: np.ndarray, symbols: np.ndarray) -> None:
        """Append each place to the queue of its symbol, in order."""
        if not len(places):
            return
        order = np.argsort(symbols, kind="stable")
        ranked = symbols[order]
        cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
        for part, symbol in zip(np.split(places[order], cuts), ranked[np.concatenate(([0], cuts))].tolist()):
            self.add(symbol, part)


def _induce(text: np.ndarray, rising: np.ndarray, seeds: np.ndarray, symbols: int, most: int) -> np.ndarray:
    """All suffixes in order, from the left-most S-type ones in order."""
    begin = np.searchsorted(text[seeds], np.arange(symbols + 1))
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    seeds = seeds.astype(kind)
    # by suffix, the symbol before it, plus one: below 0 where the suffix from there is L-type; 0 has none before
    prior = np.zeros(len(text), np.int16 if symbols < 1 << 15 else np.int32)
    prior[1:] = text[:-1]
    prior[1:] += 1
    np.negative(prior[1:], out=prior[1:], where=~rising[:-1])
    falling = Queues(symbols, most, kind)
    # the last suffix is L-type by definition and comes before all others of its symbol
    falling.add(int(text[-1]), np.array([len(text) - 1], kind))

    def deal(queues: Queues, block: np.ndarray, sign: int) -> None:
        """The suffixes one place before those of the block go to their queues, if they are of one type."""
        codes = prior[block] * sign
        some = codes > 0
        queues.deal(block[some] - 1, codes[some] - 1)

    for c in range(symbols):
        i = 0
        while i < len(falling.blocks[c]):
            block, i = falling.next(c, i)
            deal(falling, block, -1)
        deal(falling, seeds[begin[c]:begin[c + 1]], -1)
    rising_queues = Queues(symbols, most, kind)
    order: list[np.ndarray] = []
    for c in reversed(range(symbols)):
        i = 0
        while i < len(rising_queues.blocks[c]):
            block, i = rising_queues.next(c, i)
            deal(rising_queues, block, 1)
        lower = falling.all(c)
        deal(rising_queues, lower[::-1], 1)
        order += [rising_queues.all(c)[::-1], lower]
    return np.concatenate(order[::-1])


def _ranked(names: np.ndarray, symbols: int) -> np.ndarray:
    """Places of a string of names in the order of their first `symbols` names or more, by doubling.

    A name's rank is the number of smaller ones; only places whose rank is not theirs alone are ranked again.
    """
    n = len(names)
    held = np.bincount(names)
    rank = (np.cumsum(held) - held)[names]
    tied = np.flatnonzero(held[names] > 1)
    span = 1
    while span < symbols and len(tied):
        ahead = tied + span
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + following
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        old = rank[tied]
        first = np.concatenate(([True], old[1:] != old[:-1]))
        at = np.arange(len(tied))
        # a rank grows by the tied places before it that had the same rank
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        span *= 2
    return np.argsort(rank, kind="stable")


def suffix_order(text: np.ndarray, symbols: int, depth: int, most: int = QUEUE_BYTES) -> np.ndarray:
    """Suffixes of a string of small integers in the order of at least their first `depth` symbols."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.uint16)
    step = np.sign(np.diff(text.astype(np.int32))).astype(np.int8)
    # S-type: the next different symbol is larger; the end counts as smaller than everything
    marks = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(marks[::-1])[::-1]
    rising = np.zeros(n, bool)
    inside = following < n - 1
    rising[:-1][inside] = step[following[inside]] > 0
    del step, marks, following, inside
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if len(lms):
        first = _induce(text, rising, lms[np.argsort(text[lms], kind="stable")], symbols, most)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = first[is_lms[first]]
        # equal substrings up to the next of their kind are neighbours now
        stop = np.append(lms[1:] + 1, n)
        ends = np.zeros(n, np.int64)
        ends[lms] = stop
        sums = prefix_hashes(text)
        marks = span_hashes(sums, ranked, ends[ranked])
        names = np.zeros(n, np.int64)
        names[ranked] = np.cumsum(np.concatenate(([0], marks[1:] != marks[:-1])))
        # a left-most S-type suffix begins two places or more before the next
        lms = lms[_ranked(names[lms], -(-depth // 2))]
        del first, is_lms, ranked, ends, sums, marks, names
    return _induce(text, rising, lms, symbols, most)


def shared_least(stretches: list[bytes], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch and each of its windows, the smallest id of all stretches that hold the window."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    data = np.frombuffer(b"\0".join(stretches) + b"\0" * (length + 8), np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    total = int(starts[-1] + sizes[-1] + 1)
    text = data[:total].astype(np.uint16) + 1
    text[starts + sizes] = 0
    owner = np.repeat(np.arange(len(stretches)), sizes + 1)
    windows = np.zeros(total, bool)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(total)
    windows[left >= length] = True
    order = suffix_order(text, 257, length)
    order = order[windows[order]]
    words = np.ndarray((total + length,), "<u8", data, strides=(1,))
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for offset in [*range(0, length - 7, 8), length - 8]:
        word = words[order + offset]
        same &= word[:-1] == word[1:]
    begins = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(ids[owner[order]], begins) if len(order) else np.zeros(0, np.int64)
    found = np.zeros(total, np.int64)
    found[order] = np.repeat(least, np.diff(np.append(begins, len(order))))
    return [found[a:a + n - length + 1] for a, n in zip(starts, sizes)]


def anchors(texts: list[bytes], length: int):
    """Runs of windows with one anchor: (text, first window, number of windows, hash of the anchor)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    places = np.arange(len(data) - ANCHOR + 1)
    hashes = span_hashes(prefix_hashes(data), places, places + ANCHOR)
    best = hashes & np.uint64(0xFFFFFFFF00000000) | places.astype(np.uint64)
    reach, have = length - ANCHOR + 1, 1
    while have < reach:
        step = min(have, reach - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes)[: len(at)] - np.arange(len(at))
    valid = left >= length
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(ends)
    owner = np.searchsorted(begin, first, side="right") - 1
    # the smallest of many hashes is small: mixed once more, anchors spread evenly over parts and shards
    return owner, first - begin[owner], last - first + 1, mixed(hashes[at[first]])


def _rows(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """A block's documents in an order that does not depend on how they came."""
    rows = sorted(zip(table.column("id").to_pylist(), (t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist())))
    return [i for i, _ in rows], [t for _, t in rows]


def _runs(texts: list[bytes], length: int):
    parts = []
    for a, b in slices([len(t) for t in texts], SLICE_BYTES):
        owner, first, count, hashes = anchors(texts[a:b], length)
        parts.append((owner + a, first, count, hashes))
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]


def dedup(docs: DataFrame, length: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: bytes, removed bytes and runs, and the bytes that are kept."""
    docs = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = total_bytes(docs)
    blocks, parts, shards = cut(total, BLOCK_BYTES), cut(total, PART_BYTES), cut(total, SHARD_BYTES)
    dealt = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"), "id", "text")

    def send(table: pa.Table) -> pa.Table:
        owner, _, _, hashes = _runs(_rows(table)[1], length)
        order = np.lexsort((owner, hashes))
        owner, hashes = owner[order], hashes[order].astype(np.uint64)
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        found, counts = np.unique(hashes[fresh], return_counts=True)
        return report(table.column("block")[0].as_py(), found, np.minimum(counts, 2), parts)

    told = stored(
        answers(dealt.groupBy("block").applyInArrow(send, REPORT), lambda totals: (totals > 1).astype(np.uint8))
    )

    def stretches(own: pa.Table, marks: pa.Table):
        """The block's rows, its runs with a shared anchor, and its distinct stretches by shard."""
        ids, texts = _rows(own)
        owner, first, count, hashes = _runs(texts, length)
        found = np.unique(hashes.astype(np.uint64))
        shared = answered(marks, "u1")[np.searchsorted(found, hashes)] == 1 if len(found) else np.zeros(0, bool)
        owner, first, count, hashes = (x[shared] for x in (owner, first, count, hashes))
        shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        held: dict[int, dict[bytes, list]] = {}
        slot = np.zeros(len(owner), np.int64)
        for i, (o, a, n, s) in enumerate(zip(owner.tolist(), first.tolist(), count.tolist(), shard.tolist())):
            there = held.setdefault(s, {})
            piece = texts[o][a:a + n + length - 1]
            if piece not in there:
                there[piece] = [len(there), ids[o]]  # rows come by id: the first is the smallest
            slot[i] = there[piece][0]
        return ids, texts, (owner, first, count, shard, slot), held

    def ask(own: pa.Table, marks: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})
        held = stretches(own, marks)[3]
        payloads = []
        for s in sorted(held):
            sizes = np.array([len(p) for p in held[s]], "<u2")
            least = np.array([v[1] for v in held[s].values()], "<i8")
            payloads.append(np.array([len(sizes)], "<u8").tobytes() + sizes.tobytes() + least.tobytes() + b"".join(held[s]))
        return pa.table({
            "block": pa.array([own.column("block")[0].as_py()] * len(held), pa.int64()),
            "shard": pa.array(sorted(held), pa.int64()), "payload": pa.array(payloads, pa.binary()),
        })

    def sort(table: pa.Table) -> pa.Table:
        distinct: dict[bytes, int] = {}
        least: list[int] = []
        sent = []
        for blob in table.column("payload").to_pylist():
            n = int(np.frombuffer(blob, "<u8", 1)[0])
            sizes, ids = np.frombuffer(blob, "<u2", n, 8), np.frombuffer(blob, "<i8", n, 8 + 2 * n)
            at = 8 + 10 * n
            slots = []
            for size, i in zip(sizes.tolist(), ids.tolist()):
                piece = blob[at:at + size]
                at += size
                k = distinct.setdefault(piece, len(distinct))
                if k == len(least):
                    least.append(i)
                elif i < least[k]:
                    least[k] = i
                slots.append(k)
            sent.append(slots)
        found = shared_least(list(distinct), np.array(least, np.int64), length)
        replies = [zlib.compress(np.concatenate([found[k] for k in slots]).astype("<i8").tobytes(), 1) for slots in sent]
        return pa.table({
            "block": table.column("block"), "shard": table.column("shard"), "payload": pa.array(replies, pa.binary()),
        })

    asked = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask, SENT)
    replied = asked.groupBy("shard").applyInArrow(sort, SENT)
    both = told.select("block", "part", F.col("totals"), F.lit(None).cast("bigint").alias("shard")).union(
        replied.select("block", F.lit(None).cast("int"), "payload", "shard")
    )

    def apply(own: pa.Table, news: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        if not own.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        is_mark = np.array([s is None for s in news.column("shard").to_pylist()], bool)
        marks = news.filter(pa.array(is_mark))
        ids, texts, (owner, first, count, shard, slot), held = stretches(own, marks)
        begin, values, at = {}, [], 0
        replies = news.filter(pa.array(~is_mark))
        for s, blob in zip(replies.column("shard").to_pylist(), replies.column("totals").to_pylist()):
            windows = np.array([len(p) - length + 1 for p in held[s]], np.int64)
            begin[s] = at + np.cumsum(windows) - windows
            values.append(np.frombuffer(zlib.decompress(blob), "<i8"))
            at += len(values[-1])
        least = np.concatenate(values) if values else np.zeros(0, np.int64)
        source = np.array([begin[s][k] for s, k in zip(shard.tolist(), slot.tolist())], np.int64)
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        earlier = least[np.repeat(source, count) + inner] < np.repeat(np.array(ids, np.int64)[owner], count)
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(sizes) - sizes
        hits = (np.repeat(base[owner] + first, count) + inner)[earlier]
        turns = np.zeros(int(sizes.sum()) + 1, np.int64)
        np.add.at(turns, hits, 1)
        np.add.at(turns, hits + length, -1)
        gone = np.cumsum(turns)[:-1] > 0
        rows = []
        for i, whole, a in zip(ids, texts, base.tolist()):
            cover = gone[a:a + len(whole)]
            kept = np.frombuffer(whole, np.uint8)[~cover].tobytes()
            spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
            rows.append((None if i == LAST_ID else i, len(whole), len(whole) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(apply, RESULT)
