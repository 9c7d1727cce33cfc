"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are shares of character classes, repetition and length, together
with the same figures of the lines before and after it.  Training documents give their label to all their
lines; the chain learns how labels persist, and the length-weighted marginals of forward-backward make the
document's score.  Nothing but the text enters a score.

Defined results: a null or empty text is one empty line and gets a score; ties and repeated rows get equal
scores; an empty table gives an empty result; extra columns pass through, and the added column takes a name
that is free.  A training sample without both labels gives a model that scores everything alike.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.texts import fold, free_name, text_slices

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": bytes(range(97, 123)), "digit": b"0123456789",
           "symbol": b"#*$%&<>~^=+@\\{}[]_", "pipe": b"|", "bang": b"!?", "space": b" \t\r\v\f",
           "high": bytes(range(128, 256))}
BASE = 20
SLICE_BYTES = 4 << 20


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for i, members in enumerate(CLASSES.values(), 1):
        table[list(members)] = i
    return table


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some documents, the lines' lengths, and each document's number of lines."""
    lines = [line for text in texts for line in text.split("\n")]
    counts = np.array([text.count("\n") + 1 for text in texts], np.int64)
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    kinds = _class_table()[data]
    share = {name: np.add.reduceat(kinds == i, starts, dtype=np.int64) for i, name in enumerate(CLASSES, 1)}
    length = (ends - starts).astype(np.float64)
    words, distinct, adjacent = (np.zeros(len(lines)) for _ in range(3))
    for i, line in enumerate(lines):
        w = line.split()
        words[i], distinct[i], adjacent[i] = len(w), len(set(w)), sum(map(operator.eq, w, w[1:]))
    again = np.zeros(len(lines))
    at = 0
    for n in counts:
        seen: set[str] = set()
        for i in range(at, at + n):
            again[i] = bool(lines[i]) and lines[i] in seen
            seen.add(lines[i])
        at += n
    some, some_words = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(share["upper"] + share["lower"], 1)
    upper, symbol = share["upper"] / letters, share["symbol"] / some
    pipe, bang, repeat = share["pipe"] / some_words, share["bang"] / some_words, 1 - distinct / some_words
    base = np.stack([
        upper, upper > 0.5, symbol, symbol > 0.02, symbol > 0.15, pipe, pipe > 0.1, bang, bang > 0.2,
        repeat * (words > 2), (repeat > 0.3) * (words > 9), adjacent / some_words, adjacent / some_words > 0.2,
        share["digit"] / some, share["high"] / some, again, words == 0, words < 4,
        np.log1p(words) / 5, np.minimum(length / some_words, 20) / 10,
    ], axis=1)
    first = np.zeros(len(lines), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    before, after = np.roll(base, 1, axis=0), np.roll(base, -1, axis=0)
    before[first], after[last] = 0, 0
    x = np.concatenate([base, before, after, first[:, None], last[:, None], np.ones((len(lines), 1))], axis=1)
    return x, length, counts


@dataclass(frozen=True)
class Chain:
    """Weights of the features for `good` against `bad`, and of the four transitions."""

    theta: np.ndarray
    moves: np.ndarray

    def messages(self, x: np.ndarray, counts: np.ndarray):
        """Log-odds from the left, from the right, and the lines' own, for documents of `counts` lines each."""
        (t00, t01), (t10, t11) = self.moves
        own = x @ self.theta
        left, right = own.copy(), np.zeros_like(own)
        order = np.argsort(-counts, kind="stable")
        start, n = (np.cumsum(counts) - counts)[order], counts[order]
        end = start + n - 1
        active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right") if len(n) else []
        for t in range(1, len(active)):
            i = start[: active[t]] + t
            r = left[i - 1]
            left[i] += np.logaddexp(t01, t11 + r) - np.logaddexp(t00, t10 + r)
            j = end[: active[t]] - t
            b = own[j + 1] + right[j + 1]
            right[j] = np.logaddexp(t10, t11 + b) - np.logaddexp(t00, t01 + b)
        return left, right, own

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        left, right, _ = self.messages(x, counts)
        return 1 / (1 + np.exp(-np.clip(left + right, -500, 500)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean marginal of each document's lines; an empty line weighs like one character."""
        x, length, counts = line_features(texts)
        good, weight = self.marginals(x, counts), length + 1
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def fit_chain(x: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = 150, decay: float = 0.02) -> Chain:
    """Maximum likelihood with an L2 penalty by Adam, over full batches; every document weighs alike."""
    if len(counts) == 0 or label.min() == label.max():
        return Chain(np.zeros(3 * BASE + 3), np.zeros((2, 2)))
    truth = np.repeat(label, counts).astype(np.float64)
    weight = np.repeat(1.0 / counts, counts)
    inner = np.ones(len(truth), bool)
    inner[np.cumsum(counts) - counts] = False
    i = np.flatnonzero(inner)
    same = np.zeros((len(i), 2, 2))
    same[np.arange(len(i)), truth[i - 1].astype(int), truth[i].astype(int)] = 1
    theta, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    for step in range(1, steps + 1):
        chain = Chain(theta, moves)
        left, right, own = chain.messages(x, counts)
        good = 1 / (1 + np.exp(-np.clip(left + right, -500, 500)))
        r, b = left[i - 1], own[i] + right[i]
        joint = np.stack([np.full_like(r, moves[0, 0]), moves[0, 1] + b, moves[1, 0] + r, moves[1, 1] + r + b], 1)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        joint = (joint / joint.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
        slope = x.T @ ((truth - good) * weight) / len(counts) - decay * theta / len(counts) ** 0.5
        turn = ((same - joint) * weight[i][:, None, None]).sum(axis=0) / len(counts)
        g = np.concatenate([slope, (turn - decay * moves).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta, moves = theta + move[:-4], moves + move[-4:].reshape(2, 2)
    return Chain(theta, moves)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, folds: int = 4, held_out: int = 2) -> Chain:
    """Fit on at most `sample` labelled documents outside the held-out fold, drawn by a hash of their id.

    The sample is the only part of the data that is bounded; its lines' features come to the driver.
    Labels other than 0 and 1 and null ids are left out; of repeated labels of an id the larger counts.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    drawn = known.where(fold(folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y")

    def extract(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), SLICE_BYTES):
                x, _, counts = line_features(texts)
                at = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0)[a:b], "y": batch.column(2)[a:b],
                    "x": [x[at[i]:at[i + 1]].astype(np.float32).tobytes() for i in range(b - a)],
                })

    got = rows.mapInArrow(extract, "doc_id bigint, y int, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    blocks = [np.frombuffer(r.x, np.float32).reshape(-1, 3 * BASE + 3) for r in got]
    x = np.concatenate(blocks).astype(np.float64) if blocks else np.zeros((0, 3 * BASE + 3))
    return fit_chain(x, np.array([len(b) for b in blocks], np.int64), np.array([r.y for r in got], np.int64))


def with_score(docs: DataFrame, chain: Chain, name: str = "score") -> DataFrame:
    """All rows with their score, whole texts read."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [chain.scores(texts) for _, _, texts in text_slices(text, SLICE_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, score(F.col("text")))


def keep_good(docs: DataFrame, chain: Chain, threshold: float = 0.7) -> DataFrame:
    """The rows that score `threshold` or more, with the columns they came with."""
    name = free_name(docs, "_score")
    return with_score(docs, chain, name).where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
