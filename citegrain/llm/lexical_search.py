"""Ranked lexical search for a stated set of items, by grouping documents under presence masks.

Documents are read once into shards: for each shard the postings (document, occurrences) of the terms that
items use, kept as a table.  Counts over all documents (their number, their terms, the documents holding a
term) give the weights.  For an item, the postings of its terms set bits of a mask in every document of a
shard; documents with the same mask form a group.  A mask's score is at most the sum, over its bits, of the
largest part that the term has in any document of the shard.  Masks are taken by that sum, highest first, and
their documents are scored exactly, until no mask left can reach the k-th score found so far in the task.
The result is exact.  Each task hands on its k best for each item, and a window picks the k best of all.

Defined results: null and empty texts have no terms and are never found; a null document id counts as larger
than all others in ties; documents that repeat an id are ranked each; items without terms find nothing; items
that repeat both id and text count once, those that repeat only the id are searched each; an empty table on
either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.terms import LAST_ID, item_blocks, rows_of, shards, term_hashes
from citegrain.operators.durable import stored

SHARD_BYTES = 16 << 20
MERGED = 64
INDEX = (
    "ids binary, lengths binary, terms binary, cuts binary, rows binary, times binary, "
    "n_docs bigint, n_terms bigint, held array<int>, docs array<bigint>"
)
FOUND = "item int, item_id bigint, doc_id bigint, score bigint"


def postings(hashes: np.ndarray, counts: np.ndarray, vocabulary: np.ndarray):
    """Of the terms in sorted `vocabulary`: (places in it, cuts, rows, occurrences), by term, then row."""
    place = np.searchsorted(vocabulary, hashes)
    known = place < len(vocabulary)
    known[known] = vocabulary[place[known]] == hashes[known]
    row = np.repeat(np.arange(len(counts)), counts)[known]
    pairs, times = np.unique(place[known] * max(len(counts), 1) + row, return_counts=True)
    term, row = np.divmod(pairs, max(len(counts), 1))
    terms, cuts = np.unique(term, return_index=True)
    return terms, np.append(cuts, len(term)), row, times


def length_factor(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 * n * N) div L for each length n, exact beyond 64 bits too."""
    if int(lengths.max(initial=0)) * 25 * n_docs < 1 << 63:
        return 75 + (lengths * (25 * n_docs)) // n_terms
    return 75 + np.array([25 * int(n) * n_docs // n_terms for n in lengths], np.int64)


class Best:
    """The k best (score, id) pairs seen so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a further document must at least reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def presence_masks(lists: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks (one row per mask, one bit per list), rows ordered by mask, and where each mask's rows begin."""
    words = np.zeros((-(-len(lists) // 64), n), np.uint64)
    for j, rows in enumerate(lists):
        words[j // 64, rows] |= np.uint64(1 << (j % 64))
    touched = np.flatnonzero(words.any(axis=0))
    words = words[:, touched]
    order = np.lexsort(words) if len(words) > 1 else np.argsort(words[0], kind="stable")
    words = words[:, order]
    first = np.flatnonzero(np.append(True, (words[:, 1:] != words[:, :-1]).any(axis=0))) if len(touched) else touched
    return words[:, first], touched[order], np.append(first, len(touched))


def search_shard(lists: list, ids: np.ndarray, best: Best) -> int:
    """Add the documents of one shard for one item; `lists` holds (rows, score parts) of its terms.

    Returns the number of documents scored.
    """
    masks, rows, begin = presence_masks([r for r, _ in lists], len(ids))
    highest = np.array([p.max() for _, p in lists], np.int64)
    bound = np.zeros(masks.shape[1], np.int64)
    for j, top in enumerate(highest):
        bound += top * ((masks[j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    order = np.argsort(-bound, kind="stable")
    sizes = np.diff(begin)[order]
    at, scored, chunk = 0, 0, 2 * best.k
    while at < len(order) and bound[order[at]] >= best.least:
        upto = at + int(np.searchsorted(np.cumsum(sizes[at:]), chunk)) + 1
        taken = order[at:upto]
        taken = taken[bound[taken] >= best.least]
        some = np.sort(np.concatenate([rows[begin[m]:begin[m + 1]] for m in taken]))
        scores = np.zeros(len(some), np.int64)
        for where, parts in lists:
            place = np.minimum(np.searchsorted(where, some), len(where) - 1)
            scores += np.where(where[place] == some, parts[place], 0)
        best.add(scores, ids[some])
        scored += len(some)
        at, chunk = upto, 2 * chunk
    return scored


def _index(docs: DataFrame, vocabulary) -> DataFrame:
    """One row per shard with the postings of the vocabulary's terms, and one per task with its document counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        holding = np.zeros(len(known), np.int64)
        schema = pa.schema([pa.field(n, pa.binary()) for n in ("ids", "lengths", "terms", "cuts", "rows", "times")] + [
            pa.field("n_docs", pa.int64()), pa.field("n_terms", pa.int64()),
            pa.field("held", pa.list_(pa.int32())), pa.field("docs", pa.list_(pa.int64())),
        ])
        for ids, texts, _ in shards(batches, SHARD_BYTES):
            hashes, counts = term_hashes(texts)
            terms, cuts, rows, times = postings(hashes, counts, known)
            holding[terms] += np.diff(cuts)
            blobs = [(ids, "<i8"), (counts, "<i8"), (terms, "<u4"), (cuts, "<u4"), (rows, "<u4"), (times, "<u4")]
            row = [a.astype(kind).tobytes() for a, kind in blobs] + [int((counts > 0).sum()), int(counts.sum()), None, None]
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
        held = np.flatnonzero(holding)
        row = [None] * 6 + [0, 0, held.tolist(), holding[held].tolist()]
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return docs.mapInArrow(read, INDEX)


def _parts(blob: dict, weights: np.ndarray, n_docs: int, n_terms: int):
    """A shard's ids, and for each of its terms (rows, weighted score parts of one occurrence in an item)."""
    ids, lengths = np.frombuffer(blob["ids"], "<i8"), np.frombuffer(blob["lengths"], "<i8")
    terms, cuts = np.frombuffer(blob["terms"], "<u4").astype(np.int64), np.frombuffer(blob["cuts"], "<u4").tolist()
    rows, times = (np.frombuffer(blob[c], "<u4").astype(np.int64) for c in ("rows", "times"))
    factor = length_factor(lengths, n_docs, n_terms)[rows]
    worth = (1_000_000_000 * times) // (1000 * times + 12 * factor)
    worth *= weights[np.repeat(terms, np.diff(cuts))]
    return ids, {t: (rows[a:b], worth[a:b]) for t, a, b in zip(terms.tolist(), cuts, cuts[1:])}


def _block(docs: DataFrame, block: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    hashes, counts = term_hashes([r.text.encode("utf-8", "surrogatepass") for r in block])
    vocabulary = np.unique(hashes)
    index = stored(_index(docs, spark.sparkContext.broadcast(vocabulary)))
    n_docs, n_terms = (int(v or 0) for v in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    told = index.where("held is not null").select(F.explode(F.arrays_zip("held", "docs")).alias("e"))
    holding = np.zeros(len(vocabulary), np.int64)
    for term, docs_with in told.groupBy("e.held").agg(F.sum("e.docs")).collect():  # at most the block's terms
        holding[term] = docs_with
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    wanted = []
    for row, own in zip(block, np.split(np.searchsorted(vocabulary, hashes), np.cumsum(counts)[:-1])):
        terms, repeats = np.unique(own, return_counts=True)
        wanted.append((row.id, [(t, n) for t, n in zip(terms.tolist(), repeats.tolist()) if weights[t] > 0]))
    wanted = spark.sparkContext.broadcast((wanted, weights))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = wanted.value
        best = [Best(k) for _ in items]
        for blob in rows_of(batches):
            ids, parts = _parts(blob, weights, n_docs, n_terms)
            for (_, terms), kept in zip(items, best):
                lists = [(parts[t][0], parts[t][1] * n if n > 1 else parts[t][1]) for t, n in terms if t in parts]
                if lists:
                    search_shard(lists, ids, kept)
        for i, ((item_id, _), kept) in enumerate(zip(items, best)):
            n = len(kept.ids)
            if n:
                found = [None if d == LAST_ID else d for d in kept.ids.tolist()]
                yield pa.record_batch([
                    pa.array([i] * n, pa.int32()), pa.array([item_id] * n, pa.int64()), pa.array(found, pa.int64()),
                    pa.array(kept.scores, pa.int64()),
                ], ["item", "item_id", "doc_id", "score"])

    shards_only = index.where("ids is not null").select("ids", "lengths", "terms", "cuts", "rows", "times")
    found = shards_only.mapInArrow(find, FOUND).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "part"], ["item"]):  # many tasks' rows meet in two steps
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select(
        "item_id", "rank", "doc_id", "score"
    )


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    docs = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = [_block(docs, block, k) for block in item_blocks(items, item_id, "text") if block]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
