"""Sentences by what a corpus shows of its own abbreviations, without labels (after Kiss and Strunk 2006).

A word that stands with a full stop far more often than chance, and is short, is an abbreviation: the
log-likelihood of word and stop together, against the stop's share of all words, is weighed down by the word's
length and by each time it stands without a stop.  After an abbreviation a sentence ends only where the next
word, written with a capital here, is written small elsewhere.  Stops inside numbers and words are followed by
no blank and end nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import BLANK, find_all
from citegrain.operators.durable import stored

# A token's word, the stop that may follow it, and closing marks.
WORD = r"([\p{L}\p{N}][^.]*(?:\.[^.]+)*)(\.?)[\"'’”)\]]*$"
ENDING = r"[.!?]+[\"'’”)\]]*$"
THRESHOLD = 0.3


def token_pieces(text: Column) -> Column:
    """Tokens with the blanks that follow them, in text order."""
    return find_all(text, rf"[^{BLANK}]+[{BLANK}]*")


def _bare(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"[{BLANK}]+$", "")


def stop_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Per word, in small letters: times with a stop and without, times written small, and its score.

    Words are counted where they stand, with map-side combine; what is shuffled is a row per word and task.
    """
    piece = F.explode(token_pieces(F.col(text))).alias("piece")
    bare = docs.select(piece).select(_bare(F.col("piece")).alias("bare"))
    found = bare.select(F.regexp_extract("bare", WORD, 1).alias("seen"), F.regexp_extract("bare", WORD, 2).alias("stop"))
    word, first = F.lower("seen"), F.substring("seen", 1, 1)
    counted = found.where(F.col("seen").rlike(r"\p{L}")).groupBy(word.alias("word")).agg(
        F.count(F.when(F.col("stop") == ".", 1)).alias("with_stop"),
        F.count(F.when(F.col("stop") == "", 1)).alias("without_stop"),
        F.count(F.when((F.lower(first) == first) & (F.upper(first) != first), 1)).alias("small"),
    )
    counted = stored(counted)
    stops, words = (int(n or 0) for n in counted.agg(F.sum("with_stop"), F.sum(F.col("with_stop") + F.col("without_stop"))).first())
    share = stops / words if words else 0.0
    if not 0 < share < 1:
        return counted.withColumn("score", F.lit(0.0))
    with_stop, without = F.col("with_stop"), F.col("without_stop")

    def likelihood(p: float) -> Column:
        return with_stop * F.log(F.lit(p)) + without * F.log(F.lit(1 - p))

    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - letters + 1
    ratio = -2 * (likelihood(share) - likelihood(0.99))
    return counted.withColumn("score", ratio * F.exp(-letters) * inner * F.pow(letters.cast("double"), -without))


def sentence_rows(docs: DataFrame, doc: str, text: str, statistics: DataFrame | None = None) -> DataFrame:
    """(doc, pos, sentence): trimmed sentences in text order; null and blank texts have none.

    Only the places where a sentence may end are looked up, in two joins on words; the text is cut afterwards.
    `statistics` may come from another corpus; without, the documents' own are taken.
    """
    known = stop_statistics(docs, text) if statistics is None else statistics
    rows = stored(docs.select(doc, token_pieces(F.col(text)).alias("_t")).withColumn("_row", F.monotonically_increasing_id()))
    ended = F.filter(
        F.transform("_t", lambda p, i: F.struct(i.alias("i"), _bare(p).alias("p"))), lambda e: e["p"].rlike(ENDING)
    )
    places = rows.select("_row", "_t", F.explode(ended).alias("_e")).select(
        "_row", F.col("_e.i").alias("_i"), F.col("_e.p").alias("_p"), F.get("_t", F.col("_e.i") + 1).alias("_next")
    )
    places = places.select(
        "_row", "_i", F.lower(F.regexp_extract("_p", WORD, 1)).alias("word"),
        (F.regexp_extract("_p", WORD, 2) == ".").alias("_plain"),
        F.regexp_extract(F.coalesce(_bare(F.col("_next")), F.lit("")), WORD, 1).alias("_seen"), F.col("_next").isNull().alias("_last"),
    )
    short = known.where(F.col("score") >= THRESHOLD).select("word", F.lit(True).alias("_short"))
    small = known.where("small > 0").select(F.col("word").alias("_after"), F.lit(True).alias("_small"))
    first = F.substring("_seen", 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    judged = places.join(short, "word", "left").withColumn("_after", F.lower("_seen")).join(small, "_after", "left")
    initial = F.col("_plain") & (F.length("word") == 1) & F.col("word").rlike(r"\p{L}")
    held = F.col("_plain") & (F.coalesce("_short", F.lit(False)) | initial)
    ends = judged.where(F.col("_last") | ~held | (capital & F.coalesce("_small", F.lit(False))))
    ends = ends.groupBy("_row").agg(F.array_sort(F.collect_list(F.col("_i") + 1)).alias("_ends"))
    whole = rows.join(ends, "_row", "left").withColumn("_ends", F.coalesce("_ends", F.array().cast("array<int>")))
    cuts = F.array_distinct(F.concat(F.array(F.lit(0)), "_ends", F.array(F.size("_t"))))
    pieces = F.transform(
        F.slice("_cuts", F.lit(1), F.greatest(F.size("_cuts") - 1, F.lit(0))),
        lambda a, n: F.array_join(F.slice("_t", a + 1, F.element_at("_cuts", n + 2) - a), ""),
    )
    trimmed = F.transform(pieces, lambda s: F.regexp_replace(s, rf"^[{BLANK}]+|[{BLANK}]+$", ""))
    told = F.posexplode(F.filter(trimmed, lambda s: s != "")).alias("pos", "sentence")
    return whole.where("_t is not null").withColumn("_cuts", cuts).select(doc, told)
