"""Removal of training documents that hold passages of a benchmark, by suffix arrays over the training text.

Each task puts its documents together to shards of some megabytes and sorts the suffixes of a shard's words,
deep enough for the longest test item.  Every suffix of every test item is then looked up by binary search, word
by word: what is left of the array after `window` words are all places that hold that window, and the words
there are hit.  Where a suffix matches further, a binary search by common prefixes (compared by hashes of
spans) finds its longest verbatim match in the shard and where that stands.

Test items come in blocks of bounded size, each sent to all tasks; shards are not shuffled.  A marker of its
own stands behind each document, so that no match crosses documents.

Defined results: null and empty texts have no words and are never hit; an item without words has no window; one
of fewer words than a window is a single window; rows that repeat an id are documents of their own; items that
repeat id and text count once, several texts of one id count as one item; a null item id counts as the empty
string; empty tables give an empty result or no hits; other columns are not read, and `clean` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.census import prefix_hashes, span_hashes
from citegrain.llm.terms import LAST_ID, item_blocks, shards, term_hashes
from citegrain.llm.texts import free_name

SHARD_BYTES = 8 << 20
RUNS = "array<struct<start:bigint,length:bigint>>"
HITS = f"doc_id bigint, mark bigint, n_words bigint, runs {RUNS}, items array<string>"
LONGEST = "item int, item_id bigint, n_words bigint, item_start bigint, doc_id bigint, doc_start bigint"


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first `depth` symbols, by doubling; settled suffixes rest."""
    n = len(text)
    symbols = int(text.max(initial=0)) + 1
    key = text.astype(np.int64) * (symbols + 1)
    key[:-1] += text[1:] + 1
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # the end is smaller than everything
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    unsure, span = np.flatnonzero(~(new & np.append(new[1:], True))), 2
    while span < depth and len(unsure):
        places = order[unsure]
        key = rank[places] * (n + 2) + rank[np.minimum(places + span, n)] + 1
        turn = np.argsort(key, kind="stable")
        order[unsure], key = places[turn], key[turn]
        new = np.append(True, key[1:] != key[:-1])
        rank[order[unsure]] = unsure[np.maximum.accumulate(np.where(new, np.arange(len(unsure)), 0))]
        unsure, span = unsure[~(new & np.append(new[1:], True))], 2 * span
    return order


class Shard:
    """A suffix array over the words of some documents."""

    def __init__(self, texts: list[bytes], depth: int):
        hashes, self.counts = term_hashes(texts)
        self.values, names = np.unique(hashes, return_inverse=True)
        ends = np.cumsum(self.counts)
        self.begin = ends - self.counts + np.arange(len(texts))
        self.text = np.empty(len(names) + len(texts), np.int64)
        marks = ends + np.arange(len(texts))
        inside = np.ones(len(self.text), bool)
        inside[marks] = False
        self.text[inside] = names + len(texts)  # smaller numbers mark the ends of documents
        self.text[marks] = np.arange(len(texts))
        self.order = suffix_array(self.text, depth)

    def named(self, hashes: np.ndarray) -> np.ndarray:
        """Words in the numbers of this shard; -1 for words that it does not have."""
        place = np.searchsorted(self.values, hashes)
        known = place < len(self.values)
        known[known] = self.values[place[known]] == hashes[known]
        return np.where(known, place + len(self.counts), -1)

    def _bound(self, low: np.ndarray, high: np.ndarray, offset: int, word: np.ndarray, right: bool) -> np.ndarray:
        """Within ranges of the array that agree on `offset` words, where the next word begins or ends."""
        low, high = low.copy(), high.copy()
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) // 2
            at = self.order[middle] + offset
            there = np.where(at < len(self.text), self.text[np.minimum(at, len(self.text) - 1)], -1)
            less = there <= word[todo] if right else there < word[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
        return low

    def ranges(self, words: np.ndarray, left: np.ndarray, most: int):
        """For each suffix of the test words (`left`: words to its item's end): how many of its first `most` words
        match, and the range of the array that agrees on that many."""
        n = len(words)
        low, high, depth = np.zeros(n, np.int64), np.full(n, len(self.order)), np.zeros(n, np.int64)
        alive = np.arange(n)
        for offset in range(most):
            alive = alive[left[alive] > offset]
            alive = alive[words[alive + offset] >= 0]
            a = self._bound(low[alive], high[alive], offset, words[alive + offset], False)
            b = self._bound(a, high[alive], offset, words[alive + offset], True)
            some = a < b
            alive, a, b = alive[some], a[some], b[some]
            low[alive], high[alive], depth[alive] = a, b, offset + 1
            if not len(alive):
                break
        return depth, low, high

    def longest(self, words: np.ndarray, left: np.ndarray, depth: np.ndarray, low: np.ndarray, high: np.ndarray, most: int):
        """(length, low, high): the longest match of each suffix and the range of the array that agrees on it.

        Suffixes that agree on `most` words, found by `ranges`, are searched on by common prefixes.
        """
        length, low, high = depth.copy(), low.copy(), high.copy()
        on = np.flatnonzero((depth == most) & (left > most))
        if not len(on):
            return length, low, high
        # both sides in one row of numbers, so that spans of either compare by their hashes
        other = len(self.text) + len(self.values) + np.arange(len(words))
        sums, base = prefix_hashes(np.append(self.text, np.where(words < 0, other, words))), len(self.text)

        def common(test: np.ndarray, slot: np.ndarray) -> np.ndarray:
            at = self.order[slot]
            good = np.zeros(len(test), np.int64)
            bad = np.minimum(left[test], base - at) + 1
            while len(todo := np.flatnonzero(bad - good > 1)):
                tried = (good[todo] + bad[todo]) // 2
                t, p = test[todo] + base, at[todo]
                same = span_hashes(sums, t, t + tried) == span_hashes(sums, p, p + tried)
                good[todo[same]] = tried[same]
                bad[todo[~same]] = tried[~same]
            return good

        def first(a: np.ndarray, b: np.ndarray, reached) -> np.ndarray:
            """The first slot from a up to b (none: b) for which `reached` holds, it holding from there on."""
            a, b = a.copy(), b.copy()
            while len(todo := np.flatnonzero(a < b)):
                middle = (a[todo] + b[todo]) // 2
                yes = reached(todo, middle)
                b[todo[yes]] = middle[yes]
                a[todo[~yes]] = middle[~yes] + 1
            return a

        def not_below(i: np.ndarray, slot: np.ndarray) -> np.ndarray:
            test, at = on[i], self.order[slot]
            agreed = common(test, slot)
            here = words[np.minimum(test + agreed, len(words) - 1)]
            there = self.text[np.minimum(at + agreed, base - 1)]
            return (agreed >= left[test]) | ((at + agreed < base) & (there >= here))

        a, b = low[on], high[on]
        slot = first(a, b, not_below)
        before, after = np.maximum(slot - 1, a), np.minimum(slot, b - 1)
        nearer = common(on, before) > common(on, after)
        slot = np.where(nearer, before, after)
        length[on] = common(on, slot)
        low[on] = first(a, slot, lambda i, s: common(on[i], s) >= length[on[i]])
        high[on] = first(slot, b, lambda i, s: common(on[i], s) < length[on[i]])
        return length, low, high


class Test:
    """The words of a block of items, and which of their suffixes are windows."""

    def __init__(self, block: list, window: int):
        self.ids = [r.id for r in block]
        self.words, counts = term_hashes([r.text.encode("utf-8", "surrogatepass") for r in block])
        self.item = np.repeat(np.arange(len(block)), counts)
        begin = np.cumsum(counts) - counts
        self.start = np.arange(len(self.words)) - begin[self.item]
        self.left = counts[self.item] - self.start
        self.size = np.minimum(counts, window)[self.item]  # of the item's windows
        self.depth = int(counts.max(initial=window))


def hits_of(shard: Shard, test: Test, window: int):
    """For each document: the maximal runs of hit words (start, length), and the items whose windows it holds."""
    depth, low, high = shard.ranges(shard.named(test.words), test.left, window)
    found = np.flatnonzero((depth >= test.size) & (test.left >= test.size))
    # equal windows of several items stand in one range of the array
    spans, kind = np.unique(np.stack([low[found], high[found], test.size[found]]), axis=1, return_inverse=True)
    kind = kind.reshape(-1)
    turns = np.zeros(len(shard.text) + 1, np.int64)
    counts = spans[1] - spans[0]
    slot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - spans[0], counts)
    places = shard.order[slot]
    np.add.at(turns, places, 1)
    np.add.at(turns, places + np.repeat(spans[2], counts), -1)
    covered = np.diff((np.cumsum(turns) > 0).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(covered > 0), np.flatnonzero(covered < 0)
    owner = np.searchsorted(shard.begin, starts, side="right") - 1
    runs: dict[int, list] = {}
    for o, a, b in zip(owner.tolist(), (starts - shard.begin[owner]).tolist(), (ends - starts).tolist()):
        runs.setdefault(o, []).append({"start": a, "length": b})
    held = np.unique(np.stack([np.searchsorted(shard.begin, places, side="right") - 1, np.repeat(np.arange(len(counts)), counts)]), axis=1)
    pairs = np.unique(np.stack([kind, test.item[found]]), axis=1)
    first, last = np.searchsorted(pairs[0], held[1]), np.searchsorted(pairs[0], held[1], side="right")
    n = last - first
    item = pairs[1][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)]
    items: dict[int, set] = {}
    for o, i in np.unique(np.stack([np.repeat(held[0], n), item]), axis=1).T.tolist():
        items.setdefault(o, set()).add("" if test.ids[i] is None else str(test.ids[i]))
    return runs, items


def _light(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("mark"))


def _hits(docs: DataFrame, block: list, window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Test(block, window))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for ids, texts, (marks,) in shards(batches, SHARD_BYTES):
            shard = Shard(texts, window)
            runs, items = hits_of(shard, test, window)
            n = range(len(ids))
            yield pa.record_batch([
                pa.array([None if i == LAST_ID else i for i in ids.tolist()], pa.int64()),
                pa.array(marks.to_pylist(), pa.int64()), pa.array(shard.counts, pa.int64()),
                pa.array([runs.get(i, []) for i in n], run),
                pa.array([sorted(items.get(i, ())) for i in n], pa.list_(pa.string())),
            ], ["doc_id", "mark", "n_words", "runs", "items"])

    return docs.mapInArrow(find, HITS)


def _covered(runs: str) -> Column:
    """Number of words in any of some runs, sorted by their start."""
    return F.aggregate(
        F.array_sort(runs),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("bigint"), r["start"] + r["length"] - F.greatest(r["start"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], r["start"] + r["length"]).alias("upto"),
        ),
        lambda a: a["n"],
    )


def hits(
    docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
) -> DataFrame:
    """Per document: (doc_id, mark, n_words, n_hit, runs, items), `mark` being a hash of its text."""
    light = _light(docs, text, doc_id)
    blocks = [_hits(light, block, window) for block in item_blocks(items, item_id, "text")]
    found = blocks[0]
    if len(blocks) > 1:
        # rows with equal id and text have equal results: one of them stands for all
        hit = blocks[0].where(F.size("items") > 0)
        for more in blocks[1:]:
            hit = hit.unionByName(more.where(F.size("items") > 0))
        both = hit.groupBy("doc_id", "mark").agg(
            F.flatten(F.collect_set("runs")).alias("all_runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("all_items")
        ).withColumnsRenamed({"doc_id": "i", "mark": "m"})
        found = found.join(both, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").select(
            "doc_id", "mark", "n_words", F.coalesce("all_runs", "runs").alias("runs"), F.coalesce("all_items", "items").alias("items")
        )
    return found.select("doc_id", "mark", "n_words", _covered("runs").alias("n_hit"), "runs", F.array_sort("items").alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """The rows of `docs` without a hit word, with all their columns."""
    gone = hits(docs, items, window, text, doc_id, item_id).where("n_hit > 0").select("doc_id", "mark").distinct()
    i, m = free_name(docs, "hit_id"), free_name(docs, "hit_mark")
    gone = gone.toDF(i, m)
    same = F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(m))
    return docs.join(gone, same, "left_anti")


def longest_matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Per item with words: its longest run of words that a document has verbatim, and where it stands in both.

    Of equal lengths the first place in the item stays, then the smallest document id, then the first place there.
    """
    light = _light(docs, text, doc_id)
    found = None
    for number, block in enumerate(item_blocks(items, item_id, "text")):
        sent = light.sparkSession.sparkContext.broadcast(Test(block, 1))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = sent.value
            best: dict[int, tuple] = {}
            for ids, texts, _ in shards(batches, SHARD_BYTES):
                by_id = np.argsort(ids, kind="stable")
                shard = Shard([texts[i] for i in by_id], test.depth)
                words = shard.named(test.words)
                length, low, high = shard.longest(words, test.left, *shard.ranges(words, test.left, 8), 8)
                at = np.flatnonzero(length)
                rank = np.lexsort((test.start[at], -length[at], test.item[at]))
                at = at[rank][np.unique(test.item[at][rank], return_index=True)[1]]
                for s in at.tolist():
                    place = shard.order[low[s]:high[s]].min()  # documents stand in the order of their ids
                    o = np.searchsorted(shard.begin, place, side="right") - 1
                    new = (-int(length[s]), int(test.start[s]), int(ids[by_id[o]]), int(place - shard.begin[o]))
                    i = int(test.item[s])
                    best[i] = min(new, best.get(i, new))
            rows = [(i, test.ids[i], -b[0], b[1], None if b[2] == LAST_ID else b[2], b[3]) for i, b in best.items()]
            kinds = [pa.int32()] + [pa.int64()] * 5
            names = [c.split()[0] for c in LONGEST.split(", ")]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        part = light.mapInArrow(find, LONGEST).withColumn("block", F.lit(number))
        found = part if found is None else found.unionByName(part)
    first = F.min_by(
        F.struct("item_id", "n_words", "item_start", "doc_id", "doc_start"),
        F.struct(-F.col("n_words"), "item_start", F.coalesce("doc_id", F.lit(LAST_ID)), "doc_start"),
    )
    return found.groupBy("block", "item").agg(first.alias("m")).select("m.*")
