"""Scores of whole texts under Brown class-based n-grams.

A census counts every word of the training documents; tokens are lower-cased words and one end per text.  The
most frequent words are put into classes by exchange: each word in turn moves to the class that most raises the
mutual information of adjacent classes, for some sweeps.  Then one parallel sweep puts every other word that was
seen twice or more into the class with the greatest gain, by the classes beside all its occurrences.  Words seen
once stand for those never seen: both have classes by their shape (last character, length).  A token's
probability is that of its class after the class before, smoothed by Witten and Bell, times that of the word
in its class.

Classes number the cube root of the distinct words (within `CLASSES`), and the words exchanged one by one
`SEEDS_A_CLASS` times that, up to `SEEDS`; only the table of their bigrams, bounded by the square of `SEEDS`, and
that of the classes come to the driver, and both count all training documents.  Words are told apart by 64-bit
hashes.

Defined results: a null text is empty and has the end token alone; without training documents all counts are
0 and only the smoothing is left; null ids fall into the fold of the empty text; repeated rows score alike;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.census import (
    REPORT, answered, answers, cut, parts_of, prefix_hashes, report, span_hashes, total_bytes, word_spans,
)
from citegrain.llm.texts import fold, slices
from citegrain.operators.durable import stored

BLOCK_BYTES = (8 << 20, 64 << 20)
PART_BYTES = (12 << 20, 24 << 20)
SLICE_BYTES = 1 << 19
SHAPES = 4
# Fewest and most classes; most words that are exchanged one by one, and how many for a class.
CLASSES, SEEDS, SEEDS_A_CLASS = (16, 256), 2048, 16
# A word that the parallel sweep leaves to its shape or to the exchange.
UNPLACED = (1 << 16) - 1
# Occurrences of other words beside their neighbours' classes, by part of the hash space.
BESIDE = "part int, hashes binary, counts binary, before binary, after binary"
SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
    "score double"
)


def byte_slices(column: pa.Array | pa.ChunkedArray):
    """(first row, row after the last, values as bytes), `SLICE_BYTES` at a time: only these are Python objects at once."""
    raw = column.cast(pa.binary())
    for a, b in slices(pc.binary_length(raw).to_numpy().tolist(), SLICE_BYTES):
        yield a, b, raw.slice(a, b - a).to_pylist()


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words, the lowest two bits being the word's shape, and the words of each text."""
    data, starts, ends, counts = word_spans(texts)
    hashes = span_hashes(prefix_hashes(data), starts, ends)
    marks = np.zeros(256, bool)
    marks[list(b".,;:!?|*&%$#")] = True
    shape = marks[data[ends - 1]].astype(np.uint64) * np.uint64(2) + (ends - starts > 6).astype(np.uint64)
    return hashes & ~np.uint64(3) | shape, counts


def with_ends(values: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The values of all words with an end after each text."""
    return np.insert(values, np.cumsum(counts), end)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, words: int, classes: int, sweeps: int = 4) -> np.ndarray:
    """The class of each of the first `words` types; the other types keep classes of their own.

    `pairs` counts adjacent types.  Words start in the classes of their rank modulo `classes`.
    """
    types = len(pairs)
    fixed = types - words
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(fixed)]).astype(np.int64)
    total = classes + fixed
    member = np.zeros((types, total))
    member[np.arange(types), of] = 1
    right, left = pairs @ member, pairs.T @ member  # by type: classes after it, classes before it
    joint = member.T @ right
    weight = pairs.sum(axis=1)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a, own = of[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= own
            l[a] -= own
            joint[a] -= r
            joint[:, a] -= l
            joint[a, a] -= own
            mass = joint.sum(axis=1)
            c = np.arange(classes)
            rows, columns, corner = joint[:classes], joint[:, :classes], joint[c, c]
            gain = (_plogp(rows + r) - _plogp(rows)).sum(axis=1) + (_plogp(columns.T + l) - _plogp(columns.T)).sum(axis=1)
            # the corner belongs to both its row and its column, and takes in the word's own repeats
            gain -= _plogp(corner + r[:classes]) + _plogp(corner + l[:classes]) - 2 * _plogp(corner)
            gain += _plogp(corner + r[:classes] + l[:classes] + own) - _plogp(corner)
            gain -= 2 * (_plogp(mass[:classes] + weight[w]) - _plogp(mass[:classes]))
            b = int(np.argmax(gain))
            joint[b] += r
            joint[:, b] += l
            joint[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return of


@dataclass(frozen=True)
class Seeds:
    """Keys of the exchanged words, sorted, with their classes; counts of adjacent classes, shapes and end last."""

    keys: np.ndarray
    classes: np.ndarray
    joint: np.ndarray

    @property
    def end(self) -> int:
        return len(self.joint) - 1

    def held(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and whether it is a seed; others have classes by shape."""
        shape = (keys & np.uint64(3)).astype(np.int64) + self.end - SHAPES
        if not len(self.keys):
            return shape, np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        seed = self.keys[at] == keys
        return np.where(seed, self.classes[at], shape), seed


def smoothed(joint: np.ndarray) -> np.ndarray:
    """log10 P(next class | class) by Witten and Bell, backing off to the classes' own shares."""
    share = (joint.sum(axis=0) + 1) / (joint.sum() + len(joint))
    seen = (joint > 0).sum(axis=1, keepdims=True) + 1
    return np.log10((joint + seen * share) / (joint.sum(axis=1, keepdims=True) + seen))


def census(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Documents dealt to blocks, what the blocks report, and the number of parts of the hash space."""
    total = total_bytes(docs)
    blocks, parts = cut(total, BLOCK_BYTES), cut(total, PART_BYTES)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    dealt = docs.select(block.alias("block"), "doc_id", "text", "held_out")

    def send(table: pa.Table) -> pa.Table:
        held = table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b, texts in byte_slices(table.column("text")):
            keys, n = word_keys(texts)
            found, back = np.unique(keys, return_inverse=True)
            hashes.append(found)
            counts.append(np.bincount(back, weights=np.repeat(~held[a:b], n), minlength=len(found)).astype(np.int64))
        found, back = np.unique(np.concatenate(hashes), return_inverse=True)
        summed = np.bincount(back, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
        return report(table.column("block")[0].as_py(), found, summed, parts)

    return dealt, dealt.groupBy("block").applyInArrow(send, REPORT), parts


def seeds(train: DataFrame, reports: DataFrame, vocabulary: int | None, classes: int | None) -> tuple[Seeds, np.ndarray]:
    """The exchanged words, and by shape: distinct words, words seen once, tokens."""

    def summary(keys: np.ndarray, totals: np.ndarray) -> bytes:
        shape = (keys & np.uint64(3)).astype(np.int64)
        sums = np.concatenate([np.bincount(shape[some], minlength=SHAPES) for some in (totals > 0, totals == 1)])
        sums = np.concatenate([sums, np.bincount(shape, totals, SHAPES).astype(np.int64)])
        top = np.lexsort((keys, -totals))[:SEEDS]
        top = top[totals[top] > 1]
        return sums.astype("<i8").tobytes() + keys[top].astype("<u8").tobytes() + totals[top].astype("<i8").tobytes()

    def opened(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                head, n = np.frombuffer(blob, "<i8", 3 * SHAPES), (len(blob) - 24 * SHAPES) // 16
                keys, totals = np.frombuffer(blob, "<i8", n, 24 * SHAPES), np.frombuffer(blob, "<i8", n, 24 * SHAPES + 8 * n)
                slots = -1 - np.arange(3 * SHAPES)
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(np.concatenate([slots, np.zeros(n, np.int64)])),
                    "key": pa.array(np.concatenate([np.zeros(3 * SHAPES, np.int64), keys])),
                    "total": pa.array(np.concatenate([head, totals])),
                })

    told = answers(reports, lambda totals: totals[:0], summary).where("block = -1")
    rows = stored(told.select("totals").mapInArrow(opened, "slot bigint, key bigint, total bigint"))
    found = {r.slot: r.total for r in rows.where("slot < 0").groupBy("slot").agg(F.sum("total").alias("total")).collect()}
    sums = np.array([found.get(-1 - i, 0) for i in range(3 * SHAPES)], np.int64).reshape(3, SHAPES)
    classes = classes or min(max(round(int(sums[0].sum()) ** (1 / 3)), CLASSES[0]), CLASSES[1])
    vocabulary = min(vocabulary or SEEDS_A_CLASS * classes, SEEDS)
    top = rows.where("slot = 0").orderBy(F.desc("total"), "key").limit(vocabulary).select("key").collect()
    keys = np.array([r.key for r in top], np.int64).view(np.uint64)
    pairs = bigrams(train, keys)
    of = exchange(pairs, len(keys), classes)
    member = np.zeros((len(pairs), classes + SHAPES + 1))
    member[np.arange(len(pairs)), of] = 1
    order = np.argsort(keys)
    return Seeds(keys[order], of[: len(keys)][order], member.T @ pairs @ member), sums


def beside(train: DataFrame, known: Seeds, parts: int) -> DataFrame:
    """`BESIDE`: all occurrences of words that are not seeds, with the classes before and after them."""

    def send(batches):
        for batch in batches:
            for _, _, texts in byte_slices(batch.column(0)):
                keys, n = word_keys(texts)
                kinds, seed = known.held(keys)
                line = np.concatenate(([known.end], with_ends(kinds, n, known.end))).astype("<u2")
                at = np.flatnonzero(~seed)
                at = at[np.argsort(keys[at], kind="stable")]
                # the line has its own begin and an end after each text
                place = at + 1 + np.repeat(np.arange(len(n)), n)[at]
                found, counts = np.unique(keys[at], return_counts=True)
                edges = parts_of(found, parts, 1 << 64)
                rows = np.concatenate(([0], np.cumsum(counts)))[edges]
                full = [p for p in range(parts) if edges[p] < edges[p + 1]]
                whole, sides = (found.astype("<u8"), counts.astype("<u4")), (line[place - 1], line[place + 1])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(full, pa.int32()),
                    "hashes": pa.array([whole[0][edges[p]:edges[p + 1]].tobytes() for p in full], pa.binary()),
                    "counts": pa.array([whole[1][edges[p]:edges[p + 1]].tobytes() for p in full], pa.binary()),
                    "before": pa.array([sides[0][rows[p]:rows[p + 1]].tobytes() for p in full], pa.binary()),
                    "after": pa.array([sides[1][rows[p]:rows[p + 1]].tobytes() for p in full], pa.binary()),
                })

    return train.select("text").mapInArrow(send, BESIDE)


def placed(words: np.ndarray, before: np.ndarray, after: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class of greatest gain for each word 0, 1, ... by the classes beside its occurrences.

    `words` is sorted and has one entry per occurrence; the gain is that of mutual information when a word joins
    a class and all other words stay, with the words before and those after taken each by themselves.  Of equal
    gains the first class wins.
    """
    classes, total = len(joint) - SHAPES - 1, len(joint)
    n = np.bincount(words)
    if not len(n):
        return np.zeros(0, np.int64)
    codes, times = np.unique(
        np.concatenate([words * (2 * total) + before, words * (2 * total) + total + after]), return_counts=True
    )
    sides, owners = codes % (2 * total), codes // (2 * total)
    # by neighbour (before, then after) and class: what they count together now
    table = np.concatenate([joint[:, :classes], joint[:classes].T])
    mass = np.stack([joint[:, :classes].sum(axis=0), joint[:classes].sum(axis=1)])
    once = _plogp(table + 1) - _plogp(table)
    best = np.zeros(len(n), np.int64)
    begins = np.searchsorted(owners, np.arange(len(n) + 1))
    step = max(1, (1 << 20) // classes)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + step, side="right")) - 1)
        some = slice(begins[at], begins[to])
        gain = once[sides[some]]
        more = np.flatnonzero(times[some] > 1)
        rows = table[sides[some][more]]
        gain[more] = _plogp(rows + times[some][more, None]) - _plogp(rows)
        gain = np.add.reduceat(gain, begins[at:to] - begins[at])
        for m in mass:
            gain -= _plogp(m + n[at:to, None]) - _plogp(m)
        best[at:to] = np.argmax(gain, axis=1)
        at = to
    return best


def placements(reports: DataFrame, occurrences: DataFrame, known: Seeds) -> DataFrame:
    """(block, part, totals): for each hash sent, in the order sent, its total (u32) and then all their classes (u16)."""

    def place(own: pa.Table, near: pa.Table) -> pa.Table:
        def whole(table: pa.Table, column: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)

        sent = [np.frombuffer(b, "<u8") for b in own.column("hashes").to_pylist()]
        keys, back = np.unique(np.concatenate([np.zeros(0, "<u8"), *sent]), return_inverse=True)
        totals = np.bincount(back, whole(own, "counts", "<u4"), len(keys)).astype(np.int64)
        classes = np.full(len(keys), UNPLACED, np.int64)
        each = np.repeat(np.searchsorted(keys, whole(near, "hashes", "<u8")), whole(near, "counts", "<u4"))
        often = totals[each] > 1
        each, sides = each[often], [whole(near, c, "<u2")[often].astype(np.int64) for c in ("before", "after")]
        order = np.argsort(each, kind="stable")
        some, number = np.unique(each[order], return_inverse=True)
        classes[some] = placed(number, sides[0][order], sides[1][order], known.joint)
        at = np.cumsum([0] + [len(x) for x in sent])
        told = [(totals[back[a:b]], classes[back[a:b]]) for a, b in zip(at[:-1], at[1:])]
        return pa.table({
            "block": own.column("block").cast(pa.int64()), "part": own.column("part").cast(pa.int32()),
            "totals": pa.array([t.astype("<u4").tobytes() for t, _ in told], pa.binary()),
            "classes": pa.array([c.astype("<u2").tobytes() for _, c in told], pa.binary()),
        })

    pairs = reports.groupBy("part").cogroup(occurrences.groupBy("part"))
    return pairs.applyInArrow(place, "block bigint, part int, totals binary, classes binary")


def bigrams(train: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Counts of adjacent types over all training documents: chosen words, shapes of others, end."""
    order = np.argsort(keys)
    ranked, n = keys[order], len(keys)
    types = n + SHAPES + 1

    def count(batches):
        sums = np.zeros(types * types, np.uint32)
        for batch in batches:
            for _, _, texts in byte_slices(batch.column(0)):
                found, words = word_keys(texts)
                shape = (found & np.uint64(3)).astype(np.int64) + n
                if n:
                    at = np.minimum(np.searchsorted(ranked, found), n - 1)
                    shape = np.where(ranked[at] == found, order[at], shape)
                line = np.concatenate(([types - 1], with_ends(shape, words, types - 1)))
                codes, times = np.unique(line[:-1] * types + line[1:], return_counts=True)
                sums[codes] += times.astype(np.uint32)
        some = np.flatnonzero(sums)
        for i in range(0, len(some), 1 << 16):
            part = some[i:i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"code": pa.array(part), "n": pa.array(sums[part].astype(np.int64))})

    rows = train.select("text").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    pairs = np.zeros(types * types)
    pairs[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return pairs.reshape(types, types)


KINDS = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, words double, kinds binary"
)


def in_classes(dealt: DataFrame, told: DataFrame, known: Seeds, train_docs: int) -> DataFrame:
    """`KINDS` per document: its tokens' classes, and sums of the logarithms of their words' counts."""

    def encode(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            own = own.slice(0, 0)
        totals = answered(told, "<u4").astype(np.int64)
        classes = answered(told.select(["part", "classes"]).rename_columns(["part", "totals"]), "<u2").astype(np.int64)
        found = [word_keys(texts) for _, _, texts in byte_slices(own.column("text"))]
        distinct = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found)]))
        n_tokens, n_known, base, words, kinds = [], [], [], [], []
        for keys, n in found:
            place = np.searchsorted(distinct, keys)
            c, own_class = with_ends(totals[place], n, train_docs), classes[place]
            kind = with_ends(np.where(own_class < UNPLACED, own_class, known.held(keys)[0]), n, known.end)
            at = np.cumsum(n + 1) - (n + 1)
            n_tokens.append(n + 1)
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), at))
            base.append(np.add.reduceat(np.log10(c + 0.5), at))
            inside = np.log10(np.where(kind >= known.end - SHAPES, c + 0.5, c), where=kind != known.end, out=np.zeros(len(c)))
            words.append(np.add.reduceat(inside, at))
            blob = kind.astype("<u2").tobytes()
            kinds.extend(blob[2 * i:2 * j] for i, j in zip(at, at + n + 1))
        join = [np.concatenate(x) if x else np.zeros(0) for x in (n_tokens, n_known, base, words)]
        return pa.table({
            "doc_id": own.column("doc_id"), "held_out": own.column("held_out"),
            "n_tokens": pa.array(join[0].astype(np.int64)), "n_known": pa.array(join[1].astype(np.int64)),
            "base": pa.array(join[2]), "words": pa.array(join[3]), "kinds": pa.array(kinds, pa.binary()),
        })

    return stored(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(encode, KINDS))


def class_bigrams(coded: DataFrame, total: int) -> np.ndarray:
    """Counts of adjacent classes over all training documents; each begins after an end."""

    def count(batches):
        sums = np.zeros(total * total, np.int64)
        for batch in batches:
            for _, _, kinds in byte_slices(batch.column(0)):
                line = np.concatenate(([total - 1], np.frombuffer(b"".join(kinds), "<u2").astype(np.int64)))
                sums += np.bincount(line[:-1] * total + line[1:], minlength=total * total)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"code": pa.array(some), "n": pa.array(sums[some])})

    rows = coded.where(~F.col("held_out")).select("kinds").mapInArrow(count, "code bigint, n bigint")
    found = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    joint = np.zeros(total * total)
    joint[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return joint.reshape(total, total)


def scores(
    docs: DataFrame, folds: int = 5, held_out: int = 1, vocabulary: int | None = None, classes: int | None = None,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per row of `docs`: token counts, the unigram base score and the class model's score (log10).

    `vocabulary` and `classes` grow with the distinct words where they are not given.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", fold(folds) == held_out)
    train = docs.where(~F.col("held_out"))
    dealt, reports, parts = census(docs)
    reports = stored(reports)
    known, sums = seeds(train, reports, vocabulary, classes)
    train_docs = int(known.joint[:, -1].sum())
    told = placements(reports, beside(train, known, parts), known)
    coded = in_classes(dealt, told, known, train_docs)
    joint = class_bigrams(coded, known.end + 1)
    train_tokens, distinct = int(sums[2].sum()) + train_docs, int(sums[0].sum()) + (train_docs > 0)
    moves = smoothed(joint)
    inside = joint.sum(axis=0)
    inside[known.end - SHAPES:known.end] += 0.5 * (sums[1] + 1)
    # a token costs its move and the size of its class, but the end is the only word of its class
    size = np.log10(np.maximum(inside, 0.5))
    size[known.end] = 0.0
    slot = float(np.log10(train_tokens + 0.5 * (distinct + 1)))

    def score(batches):
        for batch in batches:
            for a, b, kinds in byte_slices(batch.column("kinds")):
                some = batch.slice(a, b - a)
                n = some.column("n_tokens").to_numpy()
                line = np.frombuffer(b"".join(kinds), "<u2").astype(np.int64)
                cost = moves[np.concatenate(([known.end], line[:-1])), line] - size[line]
                full = np.add.reduceat(cost, np.cumsum(n) - n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": some.column("doc_id"), "held_out": some.column("held_out"), "n_tokens": some.column("n_tokens"),
                    "n_known": some.column("n_known"), "train_tokens": pa.array(np.full(len(n), train_tokens, np.int64)),
                    "base_score": pa.array(some.column("base").to_numpy() - n * slot),
                    "score": pa.array(full + some.column("words").to_numpy()),
                })

    return coded.mapInArrow(score, SCORES)
