"""Jaccard join of documents on word n-grams by vertical partitioning.

Texts with equal words form one class.  A census of n-gram hashes tells each class how many of its n-grams
occur elsewhere; a class with more n-grams of its own than the similarity allows can have no partner.  For
the rest, n-grams are put in a global order, rare ones first, and the order is cut into fragments.  Classes
that share an n-gram within their prefixes are candidates.  A pair's overlap is counted fragment by fragment
and the counts are summed.

Buckets are not expanded into all pairs at once.  Some times over, each class is compared with one class of
its bucket, and what proves similar becomes one component.  Then only pairs between different components
remain, and those that the places of their first common n-gram leave possible are all compared, so that no
link that joins components is missed.

n-grams are compared by 64-bit hashes.  Defined results: a null text is empty; a text without words has no
n-grams and is linked with nothing; a text of fewer than n words is one n-gram; rows that repeat an id with
equal texts are linked, null ids count as the largest id, an empty table gives an empty result, and columns
other than id and text are not read (`one_per_group` passes them through).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.llm.census import (
    BLOCK_BYTES, PART_BYTES, REPORT, answered, answers, cut, mixed, report, total_bytes, word_hashes,
)
from citegrain.llm.graph import components
from citegrain.llm.texts import free_name, slices, text_slices
from citegrain.operators.durable import stored

LAST_ID = (1 << 63) - 1
CENSUS_SHARE = 0.4
FRAGMENTS = 4
STARS = 3
SLICE_BYTES, GRAM_BYTES = 1 << 20, 1 << 18
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
UPPER = bytes(range(65, 91))
TO_LOWER = bytes.maketrans(UPPER, UPPER.lower())


def words_key(text: str | None) -> bytes | None:
    """128 bits that stand for the sequence of lower-cased words; null without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    return hashlib.md5(b" ".join(words)).digest() if words else None


@F.arrow_udf(T.BinaryType())
def words_keys(text: pa.Array) -> pa.Array:
    return pa.array([words_key(t) for _, _, texts in text_slices(text, SLICE_BYTES) for t in texts], pa.binary())


def gram_sets(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and the size of each set.

    Hashing takes some fifty times a text's bytes, so that it sees the texts of one slice at a time.
    """
    done = [_slice_sets(texts[a:b], n) for a, b in slices([len(t) for t in texts], GRAM_BYTES)]
    done = done or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    return np.concatenate([grams for grams, _ in done]), np.concatenate([sizes for _, sizes in done])


def _slice_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = word_hashes(texts)
    factors = [np.uint64(FACTORS[i % 5] * (2 * (i // 5) + 1) & (1 << 64) - 1) for i in range(n)]
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.cumsum(counts) - counts
    if len(words) >= n:
        grams = sum(words[i:len(words) - n + 1 + i] * factors[i] for i in range(n))
        inner = owner[: len(grams)] == owner[n - 1:]
        grams, owners = mixed(grams[inner]), owner[: len(inner)][inner]
    else:
        grams, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = counts[short] > i
            whole[has] += words[at[short[has]] + i] * factors[i]
        grams = np.concatenate([grams, mixed(whole + counts[short].astype(np.uint64))])
        owners = np.concatenate([owners, short])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], np.bincount(owners[new], minlength=len(texts))


def spare(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams of a set may lie outside a partner's."""
    return sizes - (percent * sizes + 99) // 100


def class_sets(docs: DataFrame, keys: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, size, grams): every class's set size, and the set itself where a partner is possible."""
    total = total_bytes(docs)
    blocks, parts = cut(total, BLOCK_BYTES), cut(int(total * CENSUS_SHARE), PART_BYTES)
    low = np.uint64(int(CENSUS_SHARE * (1 << 64)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    first = keys.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    rows = docs.select("id", "text", F.lit(None).cast("binary").alias("key")).union(
        first.select("id", F.lit(None).cast("string"), "key")
    )
    dealt = rows.select(block.alias("block"), "id", "text", "key")

    def chosen(table: pa.Table) -> tuple[list[bytes], list[bytes]]:
        ids, texts, marks = (table.column(c).to_pylist() for c in ("id", "text", "key"))
        wanted = {(i, k) for i, k in zip(ids, marks) if k is not None}
        held = {}
        for i, text in zip(ids, texts):
            if text is not None and (mark := (i, words_key(text))) in wanted:
                held[mark] = text
        order = sorted(held)
        return [k for _, k in order], [held[m].encode("utf-8", "surrogatepass") for m in order]

    def send(table: pa.Table) -> pa.Table:
        grams, _ = gram_sets(chosen(table)[1], n)
        hashes, counts = np.unique(grams[grams < low], return_counts=True)
        return report(table.column("block")[0].as_py(), hashes, counts, parts, int(low))

    def choose(own: pa.Table, told: pa.Table) -> pa.Table:
        names, texts = chosen(own) if own.num_rows else ([], [])
        grams, sizes = gram_sets(texts, n)
        below = grams < low
        hashes = np.unique(grams[below])
        alone = np.zeros(len(grams), bool)
        if len(hashes):
            alone[below] = (answered(told, "u1") == 1)[np.searchsorted(hashes, grams[below])]
        owner = np.repeat(np.arange(len(texts)), sizes)
        singles = np.bincount(owner[alone], minlength=len(texts))
        at = np.cumsum(np.concatenate(([0], sizes)))
        keep = singles <= spare(sizes, percent)
        return pa.table({
            "key": pa.array(names, pa.binary()), "size": pa.array(sizes, pa.int64()),
            "grams": pa.array([grams[at[i]:at[i + 1]].astype("<i8").tolist() if keep[i] else None
                               for i in range(len(texts))], pa.list_(pa.int64())),
        })

    sent = dealt.groupBy("block").applyInArrow(send, REPORT)
    told = answers(sent, lambda totals: np.minimum(totals, 2).astype(np.uint8))
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        choose, "key binary, size bigint, grams array<bigint>"
    )


def partial_overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: overlaps per fragment, summed."""
    left = segments.select(F.col("key").alias("a"), F.col("size").alias("na"), "fragment", F.col("hs").alias("ha"))
    right = segments.select(F.col("key").alias("b"), F.col("size").alias("nb"), "fragment", F.col("hs").alias("hb"))
    counted = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("shared")
    )
    summed = counted.groupBy("a", "b").agg(
        F.sum("shared").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb")
    )
    return summed.where(F.col("shared") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def linked_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) for the classes that are linked with another."""
    size = F.col("size")
    need = F.floor((size * percent + 99) / 100)
    tokens = sets.where("grams is not null").select("key", "size", F.explode("grams").alias("h"))
    owners = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
    band = F.floor(F.log2(F.col("owners").cast("double"))).cast("int")
    met = tokens.join(owners, "h").select("key", "size", F.struct(band.alias("band"), "h").alias("token"))
    lists = met.groupBy("key", "size").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    # n-grams of one owner come first in the order: they use up the prefix and match nothing
    lists = lists.withColumn("prefix", F.size("tokens") - need + 1).where("prefix > 0")
    lists = stored(lists)
    fragment = F.least(F.col("t.band"), F.lit(FRAGMENTS - 1))
    segments = lists.select("key", "size", F.explode("tokens").alias("t")).groupBy(
        "key", "size", fragment.alias("fragment")
    ).agg(F.collect_list("t.h").alias("hs"))
    # `rest` bounds the overlap of two sets whose first common n-gram this is
    prefixes = lists.select(
        "key", "size", F.size("tokens").alias("shared"), F.posexplode(F.slice("tokens", 1, F.col("prefix").cast("int")))
    ).select(
        "key", "size", F.col("col.h").alias("h"), (F.col("shared") - F.col("pos")).alias("rest"),
        (F.col("size") - F.col("shared")).alias("alone"),
    )

    def possible(size_a: str, rest_a: str, size_b: str, rest_b: str) -> Column:
        return F.expr(f"least({rest_a}, {rest_b}) * {100 + percent} >= ({size_a} + {size_b}) * {percent}")

    roots = prefixes.select(F.col("key").alias("node"), F.col("key").alias("root")).limit(0)
    open_ = prefixes.withColumn("root", F.col("key"))
    for turn in range(STARS):
        # in each bucket all are compared with one: in turns one with the fewest n-grams of its own, as the
        # original of edited copies has, and any one
        first = [F.col("alone")] if turn % 2 == 0 else []
        order = F.struct(*first, F.xxhash64("key", F.lit(turn)).alias("mark"), "key", "root", "size", "rest")
        hub = open_.groupBy("h").agg(F.min(order).alias("hub"))
        near = open_.join(hub, "h").where(
            (F.col("root") != F.col("hub.root")) & possible("size", "rest", "hub.size", "hub.rest")
        )
        pairs = near.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()
        links = partial_overlaps(pairs, segments, percent)
        tree = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = stored(components(tree.union(links)))
        known = prefixes.join(roots.withColumnRenamed("node", "key"), "key", "left")
        known = known.withColumn("root", F.coalesce("root", "key"))
        split = known.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2")
        open_ = stored(known.join(split.select("h"), "h", "left_semi"))
    # what is left: pairs between components, which all have to be looked at.  Sizes within the similarity
    # differ by less than one step of this scale
    step = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    a = open_.select("h", "key", "size", "rest", "root", step.alias("step"))
    b = open_.select("h", F.col("key").alias("k2"), F.col("size").alias("s2"), F.col("rest").alias("t2"),
                     F.col("root").alias("r2"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    met = (F.col("key") < F.col("k2")) & (F.col("root") != F.col("r2")) & possible("size", "rest", "s2", "t2")
    rest = a.join(b, ["h", "step"]).where(met).select(F.col("key").alias("a"), F.col("k2").alias("b")).distinct()
    more = partial_overlaps(rest, segments, percent)
    tree = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(tree.union(more))


def groups(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) per row of `docs`."""
    docs = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = stored(docs.select("id", words_keys("text").alias("key")))
    sets = stored(class_sets(docs, keys, n, percent))
    roots = linked_classes(sets, percent)
    classes = keys.where("key is not null").groupBy("key").agg(F.min("id").alias("first"))
    classes = classes.join(sets.select("key", "size"), "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    classes = classes.withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "root").select("key", "size", "component_id")
    return keys.join(classes, "key", "left").select(
        "id", F.coalesce("size", F.lit(0)).cast("bigint").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their group, with all their columns; copies of such a row stay too."""
    name = free_name(docs, "stays")
    stay = groups(docs, n, percent).where("id = component_id").select(F.col("id").alias(name)).distinct()
    return docs.join(stay, F.coalesce(F.col("doc_id"), F.lit(LAST_ID)) == F.col(name), "left_semi")
