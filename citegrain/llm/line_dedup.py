"""Fuzzy duplicate lines over all documents: MinHash, banding, exact Jaccard, distributed union-find.

A line is a `\\n`-separated piece of a text, lower-cased and without outer white space (six characters) for
comparison; blank lines are never duplicates.  Its shingles are all stretches of `SHINGLE` characters (UTF-16
units); a shorter line is one shingle.  Exact copies merge first.

MinHash values are taken over all shingles of short lines and over a fourth of those of long lines, chosen by
their hash; lines near the border have both.  Bands are sets of the values that overlap, so that few values give
many bands, and bring the distinct lines together.  Every member of a band's bucket is compared with up to four members
of it, which settles buckets of up to three lines, and what proves similar becomes one component.  The lines of larger
buckets that still hold several components get further bands, and in all such buckets every line outside the largest
component is compared with all lines of other components.  Pairs most of whose values differ are not similar; the others
are compared by all their shingles, taken from the lines' text as the pair is read; in crowded buckets a bound on the
Jaccard, from bits that each line's shingles set once, first tells those that can't be similar.  Those whose Jaccard similarity is
at least `similarity` are linked, and of each connected component only its earliest line, by document id and
line number, stays.

Everything is DataFrame operations.  Defined results: a null text is empty; an empty table gives an empty
result; null ids come last in the order and count as one id; rows that repeat an id keep or lose equal
lines at equal places together; all other columns pass through, and working names are kept off them.
"""

from __future__ import annotations

import random
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.graph import components
from citegrain.llm.texts import free_name, whole_text
from citegrain.operators.durable import freed, shared_folder, stored

SHINGLE = 5
# MinHash values, and bands of some of them each.
VALUES, BANDS, ROWS = 24, 10, 5
# Further bands, for the lines of buckets that the first ones leave open.
MORE_BANDS, MORE_ROWS = 32, 6
# Lines of up to so many places use all shingles, those of more than the first number (also) one in SAMPLED.
LONG, SHORT, SAMPLED = 128, 160, 4
# Pairs that agree in fewer values are not compared: of similar ones fewer than 1 in 1,000 do.
AGREED = 12
# So many low bits of each value are compared; values that differ have the same ones in 1 of 256 cases.
BITS, IN_WORD = 8, 8
# Members of a bucket are put in order by their number and by their number with these bits turned over.
TURNED = 0x2AAAAAAAAAAAAAAA
# Bits that a line's shingles set by their hashes, in numbers of 64.
OUTLINE = 16
# Places of a long line are listed by so many at a time.
STRETCH = 65536
LAST_ID = (1 << 63) - 1
LINE_BITS = 1 << 32
BLANKS = " \t\n\x0b\f\r"


def _hash(units: str, place: str) -> str:
    """The hash of the shingle at a place of a line's UTF-16 units."""
    return f"xxhash64(substring({units}, 2 * {place} + 1, {2 * SHINGLE}))"


LAST_PLACE = f"greatest(int(octet_length({{}}) / 2) - {SHINGLE}, 0)"


def shingle_set(line: str) -> Column:
    """The distinct hashes of a line's shingles; the line is encoded once."""
    places = f"sequence(0, {LAST_PLACE.format('u')})"
    of_units = f"u -> array_distinct(transform({places}, i -> {_hash('u', 'i')}))"
    return F.expr(f"element_at(transform(array(encode({line}, 'UTF-16BE')), {of_units}), 1)")


def bands(count: int = BANDS, rows: int = ROWS) -> list[list[int]]:
    """For each band the values that it joins: sets drawn at random, the same ones everywhere."""
    return [sorted(random.Random(rows * 1000 + b).sample(range(VALUES), rows)) for b in range(count)]


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per line that is not blank: its document and number, its key (128 bits) and its compared form."""
    lines = docs.select(F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"), F.posexplode(F.split(whole_text(text), "\n")))
    norm = trimmed(F.lower("col"))
    return lines.select("id", "pos", norm.alias("norm")).where("norm != ''").withColumn("key", F.unhex(F.md5("norm")))


def with_place(marks: DataFrame) -> DataFrame:
    """`marks` with each line's place in the order of documents and their lines."""
    place = F.col("id").cast("decimal(20,0)") * F.lit(LINE_BITS).cast("decimal(11,0)") + F.col("pos")
    return marks.withColumn("place", place.cast("decimal(32,0)"))


def shingles(units: DataFrame, *names: str) -> DataFrame:
    """The place `i` and hash `h` of each shingle of the lines `u`, whose last place is `last`, with the columns `names`."""
    runs = units.selectExpr("*", f"explode(sequence(0, last, {STRETCH})) AS run")
    places = runs.selectExpr(*names, "u", f"explode(sequence(run, least(run + {STRETCH - 1}, last))) AS i")
    return places.selectExpr(*names, "i", f"{_hash('u', 'i')} AS h")


def signatures(found: DataFrame) -> DataFrame:
    """(n, key, kind, twin, values): distinct lines by kind of signature, numbered.

    `kind` is 0 over all shingles, 1 over a share of them; lines with both are twins.  Copies merge here: they have
    the same hashes, so that partial aggregates of a task hold one row each, and no text is shuffled.  A shingle is
    hashed once; each value orders the hashes under a mask.  The first shingle is always in.
    """
    units = found.select("key", F.encode("norm", "UTF-16BE").alias("u"))
    # 2 and 3 are the two kinds of a twin
    kinds = f"CASE WHEN last < {LONG} THEN array(0) WHEN last < {SHORT} THEN array(2, 3) ELSE array(1) END"
    kinds = units.selectExpr("*", f"{LAST_PLACE.format('u')} AS last").selectExpr("*", f"explode({kinds}) AS kind")
    chosen = shingles(kinds, "key", "kind").where(f"(kind & 1) = 0 OR i = 0 OR (h & {SAMPLED - 1}) = 0")
    masks = [F.xxhash64(F.lit(j)) for j in range(VALUES)]
    least = [F.min(F.shiftright(F.col("h").bitwiseXOR(m), 32).cast("int")).alias(f"m{j}") for j, m in enumerate(masks)]
    signed = chosen.groupBy("key", "kind").agg(*least)
    return signed.select(
        F.monotonically_increasing_id().alias("n"), "key", F.col("kind").bitwiseAND(1).alias("kind"),
        (F.col("kind") > 1).alias("twin"), F.array(*[f"m{j}" for j in range(VALUES)]).alias("values"),
    )


def kept_rows(rows: DataFrame) -> DataFrame:
    """The rows as a written table."""
    return freed(stored(rows))


def band_keys(sets: list[list[int]], first: int, *also: str) -> Column:
    """For each band, numbered from `first`, a hash of the values that it joins and of the columns `also`."""
    places = F.array(*[F.array(*map(F.lit, of)) for of in sets])
    return F.transform(
        places, lambda of, b: F.xxhash64(*also, b + F.lit(first), F.transform(of, lambda j: F.get("values", j)))
    )


def bucketed(lines: DataFrame) -> DataFrame:
    """(n, bucket, held, hubs) of all buckets that hold two lines or more, with up to four of their members.

    Nearly all buckets hold a single line: one shuffle of two numbers a row, and no second pass that joins counts.
    """
    banded = lines.select("n", F.explode(band_keys(bands(), 0, "kind")).alias("bucket"))
    of, turned = Window.partitionBy("bucket"), F.col("n").bitwiseXOR(F.lit(TURNED))
    ends = [F.min("n").over(of).alias("e0"), F.max("n").over(of).alias("e1")]
    ends += [F.min(turned).over(of).alias("e2"), F.max(turned).over(of).alias("e3")]
    met = banded.select("n", "bucket", F.count(F.lit(1)).over(of).alias("held"), *ends).where("held > 1")
    hubs = [F.col("e0"), F.col("e1")] + [F.col(e).bitwiseXOR(F.lit(TURNED)) for e in ("e2", "e3")]
    return met.select("n", "bucket", "held", F.array_distinct(F.array(*hubs)).alias("hubs"))


def agreement(a: str, b: str) -> Column:
    """In how many of their values two lines agree."""
    # written out value by value, the code generated for it is too large to be compiled and takes a hundred times as long
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, one: total + one)


def marked(values: str | Column, bits: int = 2) -> Column:
    """The lowest bits of each value in one number."""
    low = (1 << bits) - 1
    return F.aggregate(
        values, F.lit(0).cast("bigint"),
        lambda mark, x: F.shiftleft(mark, bits).bitwiseOR(x.bitwiseAND(F.lit(low)).cast("bigint")),
    )


def most_agreement(a: str, b: str, bits: int = 2, count: int = VALUES) -> Column:
    """At least `agreement`, from the marks of two lines: in how many of them all bits are the same."""
    either, step = F.col(a).bitwiseXOR(F.col(b)), 1
    while step < bits:
        either, step = either.bitwiseOR(F.shiftright(either, step)), 2 * step
    return count - F.bit_count(either.bitwiseAND(F.lit(sum(1 << bits * j for j in range(count)))))


WORDS = [f"w{k}" for k in range(VALUES // IN_WORD)]


def words(values: str) -> list[Column]:
    """The compared bits of all values in three numbers."""
    return [marked(F.slice(values, 1 + k * IN_WORD, IN_WORD), BITS).alias(w) for k, w in enumerate(WORDS)]


def agreed(a: str, b: str) -> Column:
    """At least `agreement` of two lines, from their `words` in columns that begin with the given names."""
    return sum((most_agreement(a + w, b + w, BITS, IN_WORD) for w in WORDS), F.lit(0))


def with_words(values: DataFrame, n: str, line: str) -> DataFrame:
    """`values` under the names of one side of a pair."""
    return values.select(F.col("n").alias(n), F.col("line").alias(line), *[F.col(w).alias(n + w) for w in WORDS])


def with_hubs(met: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, agreed): each line of a bucket with the bucket's hubs, if most of their values agree."""
    near = met.select("n", F.explode("hubs").alias("hub")).where("n != hub")
    pairs = near.select(F.least("n", "hub").alias("p"), F.greatest("n", "hub").alias("q")).distinct()
    both = pairs.join(with_words(values, "p", "lp"), "p").join(with_words(values, "q", "lq"), "q")
    both = both.where("lp != lq").withColumn("agreed", agreed("p", "q")).where(F.col("agreed") >= AGREED)
    ends = [F.least("lp", "lq").alias("a"), F.greatest("lp", "lq").alias("b")]
    return both.select(*ends, "agreed").groupBy("a", "b").agg(F.max("agreed").alias("agreed"))


def split_only(known: DataFrame) -> DataFrame:
    """The rows of `known` (n, bucket, root) whose bucket holds several components."""
    of = Window.partitionBy("bucket")
    ends = known.select("*", F.min("root").over(of).alias("r1"), F.max("root").over(of).alias("r2"))
    return ends.where("r1 != r2").drop("r1", "r2")


def more_buckets(open_: DataFrame, values: DataFrame) -> DataFrame:
    """`open_` and the further buckets of its lines, as far as they hold several components."""
    lines = open_.select("n", "root").distinct().join(values.select("n", "values"), "n")
    keys = band_keys(bands(MORE_BANDS, MORE_ROWS), BANDS)
    return open_.select("n", "bucket", "root").union(split_only(lines.select("n", F.explode(keys).alias("bucket"), "root")))


def rest_pairs(open_: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b): the pairs of lines of one bucket, but of different components, most of whose values agree.

    One of the two lies outside the bucket's largest component, so that this one is never paired with itself.
    """
    sizes = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("held"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("held", "root")).alias("top")).select("bucket", "top.root")
    inside = open_.join(largest.withColumnRenamed("root", "top"), "bucket")
    inside = inside.select("bucket", "n", "root", (F.col("root") == F.col("top")).alias("inside"))

    def side(rows: DataFrame, n: str) -> DataFrame:
        return rows.withColumnsRenamed({"n": n, "root": f"r{n}"}).join(with_words(values, n, f"l{n}"), n)

    some = side(inside.where("not inside").drop("inside"), "p")
    every = side(inside, "q").withColumnRenamed("bucket", "other")
    once = F.col("inside") | (F.col("p") < F.col("q"))
    apart = (F.col("bucket") == F.col("other")) & (F.col("rp") != F.col("rq")) & once
    met = some.join(every, apart & (agreed("p", "q") >= AGREED))
    return met.select(F.least("lp", "lq").alias("a"), F.greatest("lp", "lq").alias("b")).distinct()


def line_texts(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(n, norm): the compared form of the lines of `wanted` (n, key, place), taken from the documents."""
    pos = F.pmod("place", F.lit(LINE_BITS).cast("decimal(11,0)"))
    where = wanted.select("n", "key", pos.cast("int").alias("pos"), "place").withColumn(
        "id", ((F.col("place") - F.col("pos")) / F.lit(LINE_BITS).cast("decimal(11,0)")).cast("bigint")
    )
    lists = where.groupBy("id").agg(F.collect_list(F.struct("n", "key", "pos")).alias("wanted"))
    texts = docs.select(F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"), F.split(whole_text(text), "\n").alias("pieces"))

    def line(w: Column) -> Column:
        return trimmed(F.lower(F.get("pieces", w["pos"])))

    found = texts.join(lists, "id").select(
        F.explode(F.transform("wanted", lambda w: F.struct(w["n"].alias("n"), w["key"].alias("key"), line(w).alias("norm"))))
        .alias("w")
    )
    # where an id repeats, the row that holds the line itself counts
    return found.select("w.*").where(F.unhex(F.md5("norm")) == F.col("key")).select("n", "norm")


def by_number(rows: DataFrame) -> DataFrame:
    """Rows of lines as a table bucketed by line, in the shared folder: joins leave them where they are."""
    spark, name = rows.sparkSession, f"line_rows_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(parts, "n").write.bucketBy(parts, "n").sortBy("n")
    writer.option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return freed(spark.table(name))


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least the Jaccard similarity."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def enough(p: Column) -> Column:
        of_sizes = F.struct(
            (F.size(p["sa"]) + F.size(p["sb"])).alias("sum"), F.size(F.array_intersect(p["sa"], p["sb"])).alias("shared")
        )
        return F.forall(F.array(of_sizes), lambda z: z["shared"] >= F.lit(similarity) * (z["sum"] - z["shared"]))

    # bound by functions of one element, so that no set is worked out twice
    sets = F.array(F.struct(shingle_set("ta").alias("sa"), shingle_set("tb").alias("sb")))
    return both.where(F.forall(sets, enough)).select("a", "b")


def outlines(texts: DataFrame) -> DataFrame:
    """(n, places, o0, o1, ...): a line's number of places and the bits that its shingles set."""
    units = texts.select("n", F.encode("norm", "UTF-16BE").alias("u")).selectExpr("*", f"{LAST_PLACE.format('u')} AS last")
    bit, word = "shiftleft(1L, cast(h & 63 AS int))", f"(shiftright(h, 6) & {OUTLINE - 1})"
    bits = [F.expr(f"bit_or(IF({word} = {k}, {bit}, 0L))").alias(f"o{k}") for k in range(OUTLINE)]
    return shingles(units, "n").groupBy("n").agg(F.count(F.lit(1)).alias("places"), *bits)


def may_be_similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose outlines leave the similarity open; none that has it is left out.

    A bit that one line alone sets stands for a shingle that only this line has, and a line has no more distinct
    shingles than places: with `d` such bits and `p` places in all, the Jaccard is at most (p - d) / (p + d).
    """
    ends = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct()
    lines = by_number(outlines(texts.join(ends, "n")))
    both = pairs
    for c in "ab":
        both = both.join(lines.select(F.col("n").alias(c), *[F.col(x).alias(c + x) for x in lines.columns[1:]]), c)
    apart = sum((F.bit_count(F.col(f"ao{k}").bitwiseXOR(F.col(f"bo{k}"))) for k in range(OUTLINE)), F.lit(0))
    places = F.col("aplaces") + F.col("bplaces")
    return both.where(places - apart >= F.lit(similarity) * (places + apart)).select("a", "b")


def linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, root) after linking the similar ones of `pairs`.

    Each line is first compared with its likeliest partner; then the pairs are left that components keep apart.
    """
    ends = pairs.select("a", "b", "agreed", F.explode(F.array("a", "b")).alias("n"))
    best = ends.groupBy("n").agg(F.max(F.struct("agreed", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    roots = kept_rows(components(similar_pairs(best, texts, similarity)))
    apart = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    for c in "ab":
        apart = apart.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    apart = apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    more = similar_pairs(apart, texts, similarity)
    return kept_rows(components(forest(roots).union(more)))


def forest(roots: DataFrame) -> DataFrame:
    return roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def linked_lines(
    met: DataFrame, values: DataFrame, pairs: DataFrame, texts: DataFrame, similarity: float
) -> DataFrame:
    """(node, root) for the lines that are linked with another; `pairs` have met their buckets' hubs."""
    roots = linked(pairs, texts, similarity)
    # buckets of up to three lines are settled: all their pairs have met
    lines = values.select("n", "line").join(roots.withColumnRenamed("node", "line"), "line", "left")
    lines = lines.select("n", F.coalesce("root", "line").alias("root"))
    open_ = kept_rows(split_only(met.where("held > 3").select("n", "bucket").join(lines, "n")))
    rest = kept_rows(rest_pairs(kept_rows(more_buckets(open_, values)), values))
    rest = may_be_similar(rest, texts, similarity)
    return components(forest(roots).union(similar_pairs(rest, texts, similarity)))


def doubled_lines(docs: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Lines that go: (id, pos, kept_place), one row each."""
    found = occurrences(docs, text, doc_id)
    lines = kept_rows(signatures(found))
    marks = with_place(kept_rows(found.select("key", "id", "pos")))
    firsts = kept_rows(marks.groupBy("key").agg(F.min("place").alias("place")))
    met = kept_rows(bucketed(lines))
    # of a twin's two numbers the smaller one stands for the line
    twins = lines.where("twin").groupBy("key").agg(F.max("n").alias("n"), F.min("n").alias("line")).drop("key")
    values = lines.select("n", "values").join(met.select("n").distinct(), "n").join(twins, "n", "left")
    values = by_number(values.select("n", F.coalesce("line", "n").alias("line"), "values", *words("values")))
    pairs = kept_rows(with_hubs(met, values))
    crowded = values.select("n", "line").join(met.where("held > 3").select("n").distinct(), "n").select("line")
    wanted = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).union(crowded).distinct()
    places = lines.select("n", "key").join(wanted, "n").join(firsts, "key")
    texts = by_number(line_texts(docs, places, text, doc_id))
    roots = linked_lines(met, values, pairs, texts, similarity)
    linked_keys = lines.select("n", "key").join(roots.withColumnRenamed("node", "n"), "n").select("key", "root")
    grouped = linked_keys.join(firsts, "key")
    first = grouped.groupBy("root").agg(F.min("place").alias("kept_place"))
    linked_places = grouped.join(first, "root").select("key", "kept_place")
    kept = firsts.join(linked_places, "key", "left").select("key", F.coalesce("kept_place", "place").alias("kept_place"))
    return marks.join(kept, "key").where("place != kept_place").select(
        "id", "pos", "kept_place"
    )


def dedup_lines(docs: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All documents with their remaining lines, the dropped numbers and the count of both.

    Adds `lines_kept`, `lines_dropped` and `any_left` (with `_` added where taken) to the columns of `docs`;
    `text` holds the lines that stay, blank ones included.
    """
    gone = doubled_lines(docs, similarity, text, doc_id)
    gone = gone.groupBy("id").agg(F.collect_set("pos").alias("_gone")).withColumnRenamed("id", "_gone_id")
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row_id, whole = F.col("_row").getField(doc_id), F.coalesce(F.col("_row").getField(text), F.lit(""))
    joined = inside.join(gone, F.coalesce(row_id, F.lit(LAST_ID)) == F.col("_gone_id"), "left")
    pieces = F.split(whole, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("_gone"))
    left = F.transform(places, lambda i: F.get(pieces, i))
    dropped = F.coalesce(F.size("_gone"), F.lit(0))
    none = F.col("_gone").isNull()
    result = joined.select(
        "_row",
        F.when(none, F.col("_row").getField(text)).otherwise(F.concat_ws("\n", left)).alias("_text"),
        F.when(none, 0).otherwise(dropped).cast("bigint").alias("_dropped"),
        F.size(pieces).cast("bigint").alias("_all"),
        F.when(none, True).otherwise(F.exists(left, lambda line: trimmed(line) != "")).alias("_any"),
    )
    names = [F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]
    spare = [free_name(docs, c) for c in ("lines_kept", "lines_dropped", "any_left")]
    return result.select(
        *names, (F.col("_all") - F.col("_dropped")).alias(spare[0]), F.col("_dropped").alias(spare[1]),
        F.col("_any").alias(spare[2]),
    )


def drop_emptied(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Documents with their remaining lines and their own columns; those whose every line was a copy go."""
    result = dedup_lines(docs, similarity)
    keep = result.columns[-1]
    return result.where(F.col(keep)).select(*[F.col(f"`{c}`") for c in docs.columns])
