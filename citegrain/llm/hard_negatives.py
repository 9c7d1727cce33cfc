"""Hard negatives by a cover tree over norm-augmented candidates.

Vectors become integers.  Each task deals the rows it reads to shards and builds one cover tree per shard: a
node is a candidate, its children cover the candidates within its radius by balls of a smaller one, level by
level, and small sets are leaves.  Distances are those of vectors lengthened by one coordinate that makes all
norms equal, so that nearest means largest inner product.  A node at `c` with covering radius `r` bounds the
inner products of an anchor `a` with all below it: a.c - |a| r <= a.x <= a.c + |a| r.

Anchors meet the trees in blocks of bounded size.  For a block, bounds go down level by level; the leaves left
are taken by descending bound and their candidates scored exactly, until no leaf can change the result.  The
first search finds each anchor's positives, the second the negatives in the windows that the positives set:
nodes whose bounds lie outside all windows are skipped.  Tasks hand on their k best; an aggregate merges them.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part, nor do
vectors of a norm of 2 ** 26 or more after scaling (their products do not fit); shorter vectors are filled up
with zeros; a null id is never an anchor and counts as larger than all others; rows that repeat an id are
candidates of their own but no partners of an anchor with that id, and each such anchor row answers for itself;
an anchor without positives or negatives gives no row; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.terms import LAST_ID, rows_of
from citegrain.operators.durable import stored

SHARD_ROWS = 4096
LEAF_ROWS = 32
SHRINK = 0.7
BLOCK_BYTES = 8 << 20
MERGED = 64
TREE = "size int, ids binary, labels binary, vectors binary, nodes binary, radii binary"
POSITIVES = "anchor bigint, positive_id bigint, positive_score bigint"
NEGATIVES = "anchor bigint, positive int, negative_id bigint, negative_score bigint"


def scaled(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, vector of integers as doubles) of the rows that take part."""
    parts = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    taken = rows.where(finite & label.isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), parts.alias("vector")
    )
    return taken.where(norm < 2.0**52)


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of points, nodes, radii); a node is (point, parent, level, begin, end of its points, is leaf)."""
    reach = np.einsum("ij,ij->i", points, points)
    tall = np.column_stack([points, np.sqrt(np.maximum(reach.max(initial=0.0) - reach, 0.0))])
    norm = np.einsum("ij,ij->i", tall, tall)

    def distances(c: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm[members] + norm[c] - 2 * (tall[members] @ tall[c]), 0.0))

    order, nodes, radii = np.arange(len(points)), [], []
    waiting = [(0, -1, 0, 0, len(points), np.inf)] if len(points) else []
    while waiting:
        c, parent, level, begin, end, cover = waiting.pop()
        members = order[begin:end].copy()
        away = distances(c, members)
        radius = float(away.max())
        # rounding: distances are roots of differences of squares, whose error is far below this share
        slack = 1e-6 * (1.0 + np.sqrt(norm[c]))
        leaf = end - begin <= LEAF_ROWS or radius <= slack
        nodes.append((c, parent, level, begin, end, leaf))
        radii.append(radius + slack)
        if leaf:
            continue
        me, cover = len(nodes) - 1, min(cover, radius) * SHRINK
        rest, upto = members, begin
        near = away <= cover
        while len(rest):
            own = rest[near]
            order[upto:upto + len(own)] = own
            waiting.append((c, me, level + 1, upto, upto + len(own), cover))
            upto, rest = upto + len(own), rest[~near]
            if len(rest):
                c = int(rest[0])
                near = distances(c, rest) <= cover
    return order, np.array(nodes, np.int64).reshape(-1, 6), np.array(radii)


class Tree:
    def __init__(self, blob: dict):
        size = blob["size"]
        self.ids, self.labels = np.frombuffer(blob["ids"], "<i8"), np.frombuffer(blob["labels"], "<i8")
        self.points = np.frombuffer(blob["vectors"], "<i4").reshape(len(self.ids), size).astype(np.float64)
        nodes = np.frombuffer(blob["nodes"], "<i8").reshape(-1, 6)
        self.node, self.parent, self.level, self.begin, self.end, self.leaf = nodes.T
        self.radii = np.frombuffer(blob["radii"], "<f8")

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product of each anchor with what lies below each node."""
        products = anchors @ self.points[self.node].T
        reach = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))[:, None] * self.radii
        return np.floor(products - reach), np.ceil(products + reach)

    def leaves(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Per anchor and node: a leaf whose range, and those above it, meet [least, most]."""
        active = (high >= least[:, None]) & (low <= most[:, None])
        for level in range(1, int(self.level.max(initial=0)) + 1):
            here = np.flatnonzero(self.level == level)
            active[:, here] &= active[:, self.parent[here]]
        return active & (self.leaf == 1)

    def descending(self, leaves: np.ndarray, high: np.ndarray, some: int) -> Iterator[tuple[np.ndarray, float]]:
        """Candidates of one anchor's leaves by descending bound, in growing portions, and the bound of what is left."""
        order = leaves[np.argsort(-high[leaves], kind="stable")]
        upto = np.cumsum(self.end[order] - self.begin[order])
        at = 0
        while at < len(order):
            stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + some)) + 1
            taken = order[at:stop]
            n = self.end[taken] - self.begin[taken]
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.begin[taken], n)
            yield rows, float(high[order[stop]]) if stop < len(order) else -np.inf
            at, some = stop, 2 * some


class Best:
    """The k best (score, id): highest scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def least(self, otherwise: float) -> float:
        return self.scores[-1] if len(self.scores) == self.k else otherwise

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def nearest(tree: Tree, anchors: dict, best: list[Best]) -> None:
    """Add each anchor's candidates of its own label."""
    low, high = tree.bounds(anchors["vectors"])
    floor = np.array([b.least(-np.inf) for b in best])
    leaves = tree.leaves(low, high, floor, np.full(len(best), np.inf))
    for a, kept in enumerate(best):
        for rows, further in tree.descending(np.flatnonzero(leaves[a]), high[a], 4 * LEAF_ROWS):
            rows = rows[(tree.labels[rows] == anchors["labels"][a]) & (tree.ids[rows] != anchors["ids"][a])]
            kept.add(tree.points[rows] @ anchors["vectors"][a], tree.ids[rows])
            if further < kept.least(-np.inf):
                break


def in_windows(tree: Tree, anchors: dict, best: list[list[Best]]) -> None:
    """Add each anchor's candidates of other labels whose products lie in its positives' windows."""
    low, high = tree.bounds(anchors["vectors"])
    least = np.array([min(b.least(w) for b, (w, _) in zip(own, ranges)) for own, ranges in zip(best, anchors["windows"])])
    most = np.array([max(w for _, w in ranges) for ranges in anchors["windows"]], float)
    leaves = tree.leaves(low, high, least, most)
    for a, own in enumerate(best):
        ranges = anchors["windows"][a]
        for rows, further in tree.descending(np.flatnonzero(leaves[a]), high[a], 4 * LEAF_ROWS):
            rows = rows[(tree.labels[rows] != anchors["labels"][a]) & (tree.ids[rows] != anchors["ids"][a])]
            scores, ids = tree.points[rows] @ anchors["vectors"][a], tree.ids[rows]
            for kept, (w, upto) in zip(own, ranges):
                inside = (scores >= kept.least(w)) & (scores <= upto)
                if inside.any():
                    kept.add(scores[inside], ids[inside])
            if further < min(kept.least(w) for kept, (w, _) in zip(own, ranges)):
                break


def _trees(rows: DataFrame, size: int) -> DataFrame:
    """One row per shard of candidates; rows stay in the task that reads them."""

    def tree(ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        points = np.zeros((len(ids), size))
        for i, v in enumerate(vectors):
            points[i, : len(v)] = v
        order, nodes, radii = cover_tree(points)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes[:, 0] = place[nodes[:, 0]]
        blobs = [np.array(ids, "<i8")[order], np.array(labels, "<i8")[order], points[order].astype("<i4"), nodes.astype("<i8"), radii]
        return pa.record_batch(
            [pa.array([size], pa.int32())] + [pa.array([b.tobytes()], pa.binary()) for b in blobs],
            ["size", "ids", "labels", "vectors", "nodes", "radii"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            ids, labels, vectors = (batch.column(i).to_pylist() for i in range(3))
            for row in zip((LAST_ID if i is None else i for i in ids), labels, vectors):
                held.append(row)
                if len(held) == SHARD_ROWS:
                    yield tree(*zip(*held))
                    held = []
        if held:
            yield tree(*zip(*held))

    return rows.mapInArrow(build, TREE)


def _anchors(row: dict, size: int) -> dict:
    ids = np.frombuffer(row["ids"], "<i8")
    return {
        "numbers": np.frombuffer(row["numbers"], "<i8"), "ids": ids, "labels": np.frombuffer(row["labels"], "<i8"),
        "vectors": np.frombuffer(row["vectors"], "<i4").reshape(len(ids), size).astype(np.float64),
    }


def mine(
    rows: DataFrame, anchors: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` marks the rows to mine for, in terms of `id`; `window` is in hundredths of the positive's score.
    """
    taken = stored(scaled(rows, vec_id, vector, label, scale))
    size, n_anchors = taken.agg(F.max(F.size("vector")), F.count(F.when(anchors, 1))).first()
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], empty)
    size = max(size, 1)
    trees = stored(_trees(taken, size))
    blocks = max(1, -(-n_anchors * (4 * size + 200) // BLOCK_BYTES))
    # a number of its own for each anchor row, written once so that all uses agree
    queries = stored(
        taken.where(anchors).withColumn("number", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    )

    def packed(df: DataFrame) -> DataFrame:
        windows = "windows" in df.columns

        def pack(table: pa.Table) -> pa.Table:
            got = table.to_pydict()
            points = np.zeros((table.num_rows, size), "<i4")
            for i, v in enumerate(got["vector"]):
                points[i, : len(v)] = v
            columns = [np.array(got[c], "<i8").tobytes() for c in ("number", "id", "label")] + [points.tobytes()]
            names = ["numbers", "ids", "labels", "vectors"]
            out = {"block": pa.array([got["block"][0]], pa.int64())} | {n: pa.array([c], pa.binary()) for n, c in zip(names, columns)}
            if windows:
                out["windows"] = pa.array([got["windows"]], pa.list_(pa.list_(pa.int64())))
            return pa.table(out)

        kind = "block bigint, numbers binary, ids binary, labels binary, vectors binary"
        return stored(df.groupBy("block").applyInArrow(pack, kind + ", windows array<array<bigint>>" * windows))

    def search_positives(sent):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _anchors(sent.value, size)
            best = [Best(positives) for _ in own["ids"]]
            for row in rows_of(batches):
                nearest(Tree(row), own, best)
            n = [len(b.ids) for b in best]
            yield pa.record_batch([
                pa.array(np.repeat(own["numbers"], n), pa.int64()), pa.array(np.concatenate([b.ids for b in best]), pa.int64()),
                pa.array(np.concatenate([b.scores for b in best]).astype(np.int64), pa.int64()),
            ], ["anchor", "positive_id", "positive_score"])

        return search

    def search_negatives(sent):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _anchors(sent.value, size)
            # 30 p <= 100 n <= 90 p, in whole numbers
            own["windows"] = [[(-(-window[0] * p // 100), window[1] * p // 100) for p in w] for w in sent.value["windows"]]
            best = [[Best(negatives) for _ in w] for w in own["windows"]]
            for row in rows_of(batches):
                in_windows(Tree(row), own, best)
            flat = [(int(a), i, b) for a, kept in zip(own["numbers"], best) for i, b in enumerate(kept) if len(b.ids)]
            n, none = [len(b.ids) for *_, b in flat], [np.zeros(0, np.int64)]
            yield pa.record_batch([
                pa.array(np.repeat(np.array([a for a, *_ in flat], np.int64), n), pa.int64()),
                pa.array(np.repeat(np.array([i for _, i, _ in flat], np.int32), n), pa.int32()),
                pa.array(np.concatenate([b.ids for *_, b in flat] or none), pa.int64()),
                pa.array(np.concatenate([b.scores for *_, b in flat] or none).astype(np.int64), pa.int64()),
            ], ["anchor", "positive", "negative_id", "negative_score"])

        return search

    def over_blocks(anchor_blocks: DataFrame, search, result: str) -> DataFrame:
        """All trees with one block of anchors after the other; a task gets one block, of bounded size."""
        found = None
        for b in range(blocks):
            block = anchor_blocks.where(F.col("block") == b).first()
            if block:
                sent = rows.sparkSession.sparkContext.broadcast(block.asDict())
                part = trees.mapInArrow(search(sent), result)
                found = part if found is None else found.unionByName(part)
        return rows.sparkSession.createDataFrame([], result) if found is None else found

    def best_of(found: DataFrame, keys: list[str], kind: str, k: int) -> DataFrame:
        """The k best of each key as an array, highest score first, ties by smaller id; tasks' rows meet in two steps."""
        entry = F.struct((-F.col(f"{kind}_score")).alias("turned"), F.col(f"{kind}_id").alias("id"))
        part = F.pmod(F.spark_partition_id(), F.lit(MERGED))
        some = found.select(*keys, part.alias("part"), entry.alias("entry")).groupBy(*keys, "part").agg(
            F.slice(F.sort_array(F.collect_list("entry")), 1, k).alias("best")
        )
        return some.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias(kind))

    near = stored(best_of(over_blocks(packed(queries), search_positives, POSITIVES), ["anchor"], "positive", positives))
    asked = queries.join(near, F.col("number") == F.col("anchor")).select(
        "block", "number", "id", "label", "vector", F.transform("positive", lambda p: -p["turned"]).alias("windows")
    )
    mined = best_of(over_blocks(packed(asked), search_negatives, NEGATIVES), ["anchor", "positive"], "negative", negatives)
    back = lambda c: F.when(c != LAST_ID, c)
    pairs = queries.select("number", F.col("id").alias("anchor_id")).join(near, F.col("number") == F.col("anchor")).select(
        "number", "anchor_id", F.posexplode("positive").alias("place", "p")
    )
    mined = mined.withColumnRenamed("positive", "place").select(
        F.col("anchor").alias("number"), "place", F.posexplode("negative").alias("at", "n")
    )
    return pairs.join(mined, ["number", "place"]).select(
        "anchor_id", back(F.col("p.id")).alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        back(F.col("n.id")).alias("negative_id"), (-F.col("p.turned")).alias("positive_score"), (-F.col("n.turned")).alias("negative_score"),
    )
