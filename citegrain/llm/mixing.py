"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a weight; targets share the mix's size by weight and stop at `most` times a source's own
size, the excess being shared again among the others.  A target is met by complete passes over the source
and then by a fraction of one more: documents in the order of exponential keys divided by their quality
weight, while their prefix sum fits what is missing.  The keys come from hashes, so reruns agree.

No source is sorted in one task: keys are cut into buckets whose number follows the source's rows, bucket
sums are prefix-summed over the small bucket table, and only the rows of the one bucket per source that
holds the border are sorted; all others are taken or left whole.

Everything is DataFrame operations.  Defined results: a null text has size 0 and is taken with size 0; a
null source is a source of its own, the last in order; repeated rows are sampled one by one; an empty table
gives an empty result; other columns pass through, and working names are kept off them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.texts import whole_text, word_count

BUCKET_ROWS = 5_000


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ... `cycle`, repeating over the sources (source, size) by code point, null last."""
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    return sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("double"))


def targets(weighted: DataFrame, most: float = 3.0) -> DataFrame:
    """Adds `target` to one row per source (source, size, weight): shares by weight under the cap.

    Sources are few next to documents (one row each).  In the order of cap over weight, a source is capped
    exactly if its cap is below its share of what the ones before it leave.
    """
    cap, size, weight = F.col("size") * F.lit(most), F.col("size"), F.col("weight")
    order = Window.orderBy(cap / weight, F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(cap / weight, F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = F.sum(size).over(every) - F.coalesce(F.sum(cap).over(order), F.lit(0.0))
    level = left / F.sum(weight).over(rest)
    ranked = weighted.withColumn("_level", F.when(cap > level * weight, level))
    # the first level that caps nothing more holds for all sources from there on
    common = F.first("_level", ignorenulls=True).over(
        Window.orderBy(cap / weight, F.col("source").isNull(), "source")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranked.withColumn("target", F.coalesce(common * weight, cap)).drop("_level")


def clean_share(text: str) -> Column:
    """A quality weight from 0.05 to 1: falls with the share of symbols and of upper-case letters."""
    whole = whole_text(text)
    odd = F.length(whole) - F.length(F.translate(whole, "#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.greatest(F.lit(0.05), 1 - 2.0 * odd / F.greatest(F.length(whole), F.lit(1)))


def mix(
    docs: DataFrame,
    quality: Column | None = None,
    size: Column | None = None,
    weights=cyclic_weights,
    most: float = 3.0,
    seed: int = 11,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(row, size, source_size, target, copies): `row` is the input row, `copies` how often the mix takes it.

    `quality` and `size` may be expressions over `docs`, where they were worked out before.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mark = F.xxhash64(F.lit(seed), F.col(doc_id))
    uniform = (F.shiftrightunsigned(mark, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    worth = clean_share(text) if quality is None else quality
    sized = docs.select(
        row.alias("row"), F.col(source).alias("source"), (word_count(text) if size is None else size).alias("size"),
        (-F.log(uniform) / F.coalesce(worth, F.lit(1.0)).cast("double")).alias("key"),
        F.col(doc_id).alias("id"),
    )
    light = sized.select("source", "size", "key")
    sums = light.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    goals = targets(weights(sums), most)
    goals = goals.select(
        F.col("source").alias("_source"), F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).alias("passes"),
        F.ceil(F.col("rows") / BUCKET_ROWS).alias("cuts"),
    ).withColumn("missing", F.col("target") - F.col("passes") * F.col("source_size"))

    def bucketed(rows: DataFrame) -> DataFrame:
        met = rows.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        # a monotone map of the key to 0..1; with equal quality it is uniform, and any shape is right
        place = F.floor((1 - F.exp(-F.col("key"))) * F.col("cuts")).cast("bigint")
        return met.withColumn("bucket", F.least(place, F.col("cuts") - 1))

    partial = bucketed(light).groupBy("_source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = partial.select(
        F.col("_source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before_bucket"), "in_bucket",
    )
    placed = bucketed(sized).join(offsets, F.col("_source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.col("before_bucket") + F.col("in_bucket") <= F.col("missing")
    none = F.col("before_bucket") >= F.col("missing")
    clear = placed.where(whole | none).withColumn("extra", whole.cast("int"))
    border = fill(placed.where(~(whole | none)).withColumn("room", F.col("missing") - F.col("before_bucket")))
    names = ["row", "size", "source_size", "target", "passes", "extra"]
    return clear.select(*names).union(border.select(*names)).select(
        "row", "size", "source_size", "target", (F.col("passes") + F.col("extra")).cast("bigint").alias("copies")
    )


def fill(rows: DataFrame, rounds: int = 4) -> DataFrame:
    """Adds `extra` to the rows of border buckets: 1 for those taken to fill `room`.

    Rows are taken in key order while their prefix sum fits.  A row that no longer fits is passed over, and
    the rest of the room goes to later rows that do, for some rounds; a last row is added if that brings the
    sum nearer to the room.
    """
    group = Window.partitionBy("s", "b")
    order = group.orderBy("key", "id", "size", F.xxhash64("row"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("extra", F.lit(0)).withColumn("free", F.col("room"))
    for _ in range(rounds):
        fits = F.when((F.col("extra") == 0) & (F.col("size") <= F.col("free")), F.col("size")).otherwise(0)
        rows = rows.withColumn("_sum", F.sum(fits).over(upto))
        takes = (F.col("extra") == 0) & (F.col("size") <= F.col("free")) & (F.col("_sum") <= F.col("free"))
        rows = rows.withColumn("extra", F.when(takes, 1).otherwise(F.col("extra")))
        rows = rows.withColumn("free", F.col("room") - F.sum(F.col("extra") * F.col("size")).over(group))
    spare = F.when(F.col("extra") == 0, F.struct("size", "key", "id", F.xxhash64("row").alias("h")))
    rows = rows.withColumn("_least", F.min(spare).over(group))
    nearer = (spare == F.col("_least")) & (F.col("size") < 2 * F.col("free"))
    rank = F.row_number().over(group.orderBy(F.col("extra"), "size", "key", "id", F.xxhash64("row")))
    return rows.withColumn("extra", F.when(nearer & (rank == 1), 1).otherwise(F.col("extra")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns it came with."""
    taken = mix(docs, **options).where("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return taken.select("row", times.alias("time")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
