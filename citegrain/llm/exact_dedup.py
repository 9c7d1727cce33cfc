"""Exact duplicates by an extendible-hash index in shared files.

Texts are compared after each run of white space has become one blank.  Reading tasks write the index file:
a row per document and, once per batch, the bytes of each distinct text with its hash.  The directory maps a
hash's leading bits to buckets; it doubles, one more bit at a time, for as long as a bucket holds more bytes
than its capacity and more bits can split it.  Owner tasks take whole buckets in hash order, chain the texts
whose hashes collide, and compare bytes; only equal bytes are copies.  Each batch's entry then tells its own
documents where they belong, so that no key of that join is hot, however many copies a text has.

Defined results: a null text is empty; null ids count as larger than all others, and a group of null ids only
keeps one of its rows; of rows that repeat both id and text one is kept; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.operators.durable import stored

INDEX = (
    "doc_id bigint, entry bigint, copy int, hash bigint, text_sha256 string, least_id bigint, rows bigint, "
    "n_bytes bigint, body binary"
)
CHAINS = "entry bigint, keep_id bigint, keep_entry bigint, group_size bigint"
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 14
LAST = 1 << 63
SPACES = b" \t\n\r\x0b\x0c"


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes with each run of white space as one blank."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] in SPACES else b"") + b" ".join(words) + (b" " if raw[-1] in SPACES else b"")


def hash64(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def index_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hashed=hash64) -> DataFrame:
    """The index file's rows; `hashed` makes a 64-bit hash of a SHA-256."""

    def run(batches):
        entry = TaskContext.get().partitionId() << 40
        for batch in batches:
            held: dict[bytes, list] = {}
            order = []
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = normalised(whole)
                if body not in held:
                    held[body] = [entry, hashlib.sha256(body).digest(), []]
                    entry += 1
                held[body][2].append(key)
                order.append(body)
            columns: list[list] = [[] for _ in range(9)]
            for body, (number, digest, keys) in held.items():
                seen: dict = {}
                known = [k for k in keys if k is not None]
                for i, key in enumerate(keys):
                    seen[key] = seen.get(key, -1) + 1
                    head = (min(known, default=None), len(keys), len(body), body) if i == 0 else (None,) * 4
                    row = (key, number, seen[key], hashed(digest), digest.hex(), *head)
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
                     pa.binary()]
            names = [n.split()[0] for n in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(doc_id, text).mapInArrow(run, INDEX)


def directory(heads: DataFrame, capacity: int | None = None, bits: int | None = None) -> tuple[DataFrame, int]:
    """(prefix, bucket) for the leading `bits` of a hash, and how many bits those are.

    A bucket has the fewest leading bits with which it holds at most `capacity` bytes; by default 16 MB, or
    what cuts the total into `MOST_BUCKETS`.  The depth is four bits more than an even spread needs, so that
    the directory has 2 ** 19 rows at most; a bucket that is still overfull then is one hash's.
    """
    total = heads.agg(F.sum("n_bytes")).first()[0] or 0
    capacity = capacity or max(BUCKET_BYTES, -(-total // MOST_BUCKETS))
    if bits is None:
        bits = max(1, (total // capacity).bit_length() + 4)
    prefix = F.shiftrightunsigned("hash", 64 - bits).alias("prefix")
    filled = heads.groupBy(prefix).agg(F.sum("n_bytes").alias("n_bytes"))
    depth = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    levels = filled.select("prefix", "n_bytes", depth)
    code = F.expr(f"shiftright(prefix, {bits} - depth)").alias("code")
    fits = levels.groupBy("depth", code).agg(F.sum("n_bytes").alias("held"))
    fits = fits.where((F.col("held") <= capacity) | (F.col("depth") == bits))
    met = levels.select("prefix", "depth", code).join(fits, ["depth", "code"])
    leaf = met.groupBy("prefix").agg(F.min("depth").alias("depth"))
    # a bucket's number: a leading one, then its bits
    number = F.expr(f"shiftleft(1L, depth) + shiftright(prefix, {bits} - depth)")
    return leaf.select("prefix", number.alias("bucket")), bits


def chains(heads: DataFrame, capacity: int | None = None, bits: int | None = None) -> DataFrame:
    """For every entry of the index: the group that its bytes belong to."""
    buckets, bits = directory(heads, capacity, bits)
    placed = heads.select(
        F.shiftrightunsigned("hash", 64 - bits).alias("prefix"), "hash", "entry", "least_id", "rows", "body"
    ).join(F.broadcast(buckets), "prefix")  # at most 2 ** 19 rows of two longs by construction
    owned = placed.select("bucket", "hash", "entry", "least_id", "rows", "body").repartition("bucket")

    def run(batches):
        now, chain = None, []

        def told() -> pa.RecordBatch:
            rows = []
            for _, members in chain:
                size = sum(n for _, _, n in members)
                least, at = min((LAST if i is None else i, e) for e, i, _ in members)
                rows += [(e, None if least == LAST else least, at, size) for e, _, _ in members]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)], [n.split()[0] for n in CHAINS.split(", ")]
            )

        for batch in batches:
            for key, entry, least, n, body in zip(*[batch.column(i).to_pylist() for i in range(1, 6)]):
                if key != now:
                    if chain:
                        yield told()
                    now, chain = key, []
                for head, members in chain:
                    if head == body:
                        members.append((entry, least, n))
                        break
                else:
                    chain.append((body, [(entry, least, n)]))
        if chain:
            yield told()

    return owned.sortWithinPartitions("bucket", "hash").mapInArrow(run, CHAINS)


def duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int | None = None,
    bits: int | None = None, hashed=hash64,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`."""
    index = stored(index_rows(docs, text, doc_id, hashed))
    groups = chains(index.where("rows is not null"), capacity, bits)
    rows = index.select("doc_id", "entry", "copy", "text_sha256").join(groups, "entry")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("entry") == F.col("keep_entry")) & (F.col("copy") == 0)
    return rows.select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256")
