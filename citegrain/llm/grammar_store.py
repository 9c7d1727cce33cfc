"""Token ids in files compressed by Re-Pair, with random access to single documents.

Documents are range-partitioned and sorted by id.  A partition's ids are cut into shards of whole documents;
in a shard frequent pairs of symbols are replaced, again and again, by new symbols.  The file of a shard is
one binary value:

    8 bytes   b"REPAIR01"
    6 x u64   documents, symbols, rules, first free symbol, ids in the shard, ids of earlier shards of the partition
    rules     two u32 each: what the symbol `first free symbol + i` stands for
    lengths   one u32 for each rule: how many ids it expands to
    symbols   one u32 each
    keys      one i64 for each document, its id
    nulls     one byte for each document: 1 where its id is null
    starts    one u64 for each document: ids before it in the shard
    counts    one u64 for each document: its ids

A document is decoded by expanding only the symbols that cover it: prefix sums of expansion lengths find them.
No symbol reaches over the end of a document.

Defined results: a null or empty text has the end id alone; null ids come first; rows that repeat an id are
stored one by one, ordered by text; an empty table gives no files and an empty result; other columns are not
read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.texts import text_slices
from citegrain.llm.tokens import encoder
from citegrain.operators.durable import stored

MAGIC = b"REPAIR01"
HEAD = struct.Struct("<8s6Q")
SHARD_IDS = 1 << 20
SLICE_BYTES = 4 << 20
FILES = "part bigint, shard bigint, part_ids bigint, payload binary"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def repair(ids: np.ndarray, last: np.ndarray, first_free: int, least: int = 4, most: int = 4096):
    """(symbols, rules): in each round the pairs that occur `least` times or more, up to `most` of them, the
    most frequent first, become new symbols; of overlapping pairs the more frequent wins, then the left one.
    Rounds go on until no pair occurs `least` times: a rule takes three numbers, so that rarer pairs do not pay.

    A pair that is too rare stays so until one of its sides is replaced, so that only changed places and pairs
    still to be replaced are counted again.
    """
    symbols, rules, live = ids.astype(np.int64), [], ~last
    while True:
        at = np.flatnonzero(live)
        codes = symbols[at] << 32 | symbols[at + 1]
        order = _order(symbols, at, first_free + len(rules))
        ranked = codes[order]
        begins = np.flatnonzero(np.diff(ranked, prepend=-1))
        counts = np.diff(np.append(begins, len(ranked)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            return symbols, np.array(rules, np.int64).reshape(-1, 2)
        every = ranked[begins[often]]
        best = np.argsort(-counts[often], kind="stable")
        rank_of = np.full(len(begins), -1, np.int32)
        rank_of[often[best]] = np.arange(len(every))
        ranks = np.empty(len(at), np.int32)
        ranks[order] = np.repeat(rank_of, counts)
        frequent = ranks >= 0
        live[at[~frequent]] = False
        at, ranks = at[frequent], ranks[frequent]
        chosen = min(len(every), most)
        pairs = every[best[:chosen]]
        at, ranks = at[ranks < chosen], ranks[ranks < chosen]
        # a place is taken if neither neighbour's pair has a better rank; runs of one pair take every other place
        taken = _spread(at, ranks)
        ranks, taken = ranks[taken], at[taken]
        fresh = first_free + len(rules)
        rules.extend(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()))
        symbols[taken] = fresh + ranks
        last[taken] = last[taken + 1]
        live[taken] = ~last[taken]
        before = taken[taken > 0] - 1
        live[before] = ~last[before]
        stay = np.ones(len(symbols), bool)
        stay[taken + 1] = False
        symbols, last, live = symbols[stay], last[stay], live[stay]


def _order(symbols: np.ndarray, at: np.ndarray, kinds: int) -> np.ndarray:
    """The order of the pairs at the places `at`; pair and number are sorted as one integer where they fit into it."""
    wide, far = int(kinds).bit_length(), len(at).bit_length()
    if 2 * wide + far > 63:
        return np.argsort(symbols[at] << 32 | symbols[at + 1], kind="stable")
    packed = (symbols[at] << wide | symbols[at + 1]) << far | np.arange(len(at))
    packed.sort()
    return packed & ((1 << far) - 1)


def _spread(at: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which of the places `at` (ascending) hold pairs that can be replaced together."""
    near = np.diff(at) == 1
    wins = np.ones(len(at), bool)
    wins[1:] &= ~(near & (ranks[:-1] < ranks[1:]))
    wins[:-1] &= ~(near & (ranks[1:] < ranks[:-1]))
    at_win = np.flatnonzero(wins)
    run = np.diff(at[at_win], prepend=-2) != 1
    order = np.arange(len(at_win))
    begin = np.maximum.accumulate(np.where(run, order, 0))
    return at_win[(order - begin) % 2 == 0]


def rule_lengths(rules: np.ndarray, first_free: int) -> np.ndarray:
    lengths = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (lengths[a - first_free] if a >= first_free else 1) + (lengths[b - first_free] if b >= first_free else 1)
    return lengths


def to_file(keys: list, counts: list[int], ids: np.ndarray, first_free: int, earlier: int) -> bytes:
    """The file of one shard: documents `keys` of `counts` ids each."""
    size = np.array(counts, np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(size) - 1] = True
    symbols, rules = repair(ids, last, first_free)
    head = HEAD.pack(MAGIC, len(keys), len(symbols), len(rules), first_free, len(ids), earlier)
    body = [rules.astype("<u4").tobytes(), rule_lengths(rules, first_free).astype("<u4").tobytes(),
            symbols.astype("<u4").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], "u1").tobytes(), (np.cumsum(size) - size).astype("<u8").tobytes(),
            size.astype("<u8").tobytes()]
    return head + b"".join(body)


class Shard:
    """A shard's file, read."""

    def __init__(self, payload: bytes):
        magic, docs, symbols, rules, self.first_free, self.ids, self.earlier = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.symbols = take("<u4", symbols)
        keys, null = take("<i8", docs), take("u1", docs)
        self.keys = [None if n else int(k) for k, n in zip(keys, null)]
        self.starts, self.counts = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        # prefix sums of expansion lengths: where each symbol ends
        sizes = np.ones(len(self.symbols), np.int64)
        made = self.symbols >= self.first_free
        sizes[made] = self.lengths[self.symbols[made] - self.first_free]
        self.ends = np.cumsum(sizes)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids that the symbols stand for; each step replaces every rule symbol by its two sides."""
        symbols = symbols.astype(np.int64)
        while True:
            made = symbols >= self.first_free
            if not made.any():
                return symbols
            places = np.cumsum(1 + made) - (1 + made)
            out = np.empty(len(symbols) + int(made.sum()), np.int64)
            out[places[~made]] = symbols[~made]
            sides = self.rules[symbols[made] - self.first_free]
            out[places[made]], out[places[made] + 1] = sides[:, 0], sides[:, 1]
            symbols = out

    def documents(self) -> list[np.ndarray]:
        """The ids of all documents, in order; every rule is expanded once, and its ids are copied."""
        spelt = self.expand(self.first_free + np.arange(len(self.rules)))
        begins = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        made = self.symbols >= self.first_free
        sizes = np.diff(self.ends, prepend=0)
        # plain ids stand behind the rules' ids
        begin = np.empty(len(sizes), np.int64)
        begin[made] = begins[self.symbols[made] - self.first_free]
        begin[~made] = len(spelt) + np.arange(len(sizes) - int(made.sum()))
        every = np.concatenate([spelt, self.symbols[~made]]).astype("<u4")
        ids = every[np.repeat(begin - (self.ends - sizes), sizes) + np.arange(len(sizes) and self.ends[-1])]
        return np.split(ids, self.starts[1:])

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from the symbols that cover it."""
        a = np.searchsorted(self.ends, self.starts[i], side="right")
        b = np.searchsorted(self.ends, self.starts[i] + self.counts[i], side="left")
        return self.expand(self.symbols[a:b + 1])


def write(docs: DataFrame, vocabulary: str, end_id: int, first_free: int, text: str = "text", doc_id: str = "doc_id"):
    """One row per shard (part, shard, part_ids so far, payload), written to the shared folder and read again."""
    end = end_id.to_bytes(4, "little")
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        part, shard, earlier = TaskContext.get().partitionId(), 0, 0
        encode = encoder(vocabulary, words=False)
        keys, counts, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = to_file(keys, counts, np.concatenate(held), first_free, earlier)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "shard": pa.array([shard], pa.int64()),
                "part_ids": pa.array([earlier + size], pa.int64()), "payload": pa.array([payload], pa.binary()),
            })

        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), SLICE_BYTES):
                ids, sizes = encode.many(texts, end)
                ends = np.cumsum(sizes).tolist()
                for key, count, to in zip(batch.column(0).slice(a, b - a).to_pylist(), sizes.tolist(), ends):
                    keys.append(key)
                    counts.append(count)
                    held.append(ids[to - count:to])
                    size += count
                    if size >= SHARD_IDS:
                        yield close()
                        earlier, shard = earlier + size, shard + 1
                        keys, counts, held, size = [], [], [], 0
        if keys:
            yield close()

    return stored(ordered.mapInArrow(run, FILES))


def read(files: DataFrame) -> DataFrame:
    """Every document of the files: (doc_id, start, n_tokens, ids_crc32), decoded shard by shard.

    `start` counts the ids of all documents before.  Partitions are few next to documents; only their totals,
    one row for each task that wrote, are summed in one place and broadcast.
    """

    def run(batches):
        for batch in batches:
            for before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(payload)
                crcs = [zlib.crc32(ids) for ids in shard.documents()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.keys, pa.int64()),
                    "start": pa.array(shard.starts + (shard.earlier + before), pa.int64()),
                    "n_tokens": pa.array(shard.counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    totals = files.groupBy("part").agg(F.max("part_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("earlier"))
    placed = files.select("part", "payload").join(F.broadcast(totals), "part")
    return placed.select("earlier", "payload").mapInArrow(run, READ)
