"""Report text as tables: actors, sentences, tokens and co-mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions import text as t


def text_table(citations: DataFrame) -> DataFrame:
    """The side table of report texts."""
    # fixed values: its five columns
    return citations.select("facility_id", "eventid", "inspection_text", "deficiency_tag", "scope_severity")


def sentence_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per sentence with its position."""
    return docs.select(doc, F.posexplode(t.sentences(F.col(text))).alias("pos", "sentence"))


def actor_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Distinct actors per report, from normalised text."""
    return docs.select(doc, t.actors(t.normalise(F.col(text))).alias("actors"))


def co_mentions(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Undirected actor pairs sharing a sentence, with the number of such sentences.

    Each name meets the later ones of its sentence, a row at a time, without a self-join and without holding a
    sentence's pairs together.  A sentence starts with a blank added for matching, as the actor pattern wants
    one in front of each mention.
    """
    marked = docs.where(F.contains(F.col(text), F.lit("#")))
    spoken = sentence_rows(marked.select(doc, t.normalise(F.col(text)).alias("_t")), doc, "_t")
    named = spoken.select(doc, t.actors(F.concat(F.lit(" "), F.col("sentence"))).alias("_names"))
    return (
        named.where(F.size("_names") > 1)
        .select(doc, "_names", F.posexplode("_names").alias("_i", "a"))
        .select(doc, "a", F.explode(F.slice("_names", F.col("_i") + 2, F.size("_names"))).alias("b"))
        .groupBy(doc, "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def reports_by_year(reports: DataFrame, date: str) -> DataFrame:
    return (
        reports.where(F.col(date).isNotNull())
        .groupBy(F.year(date).alias("inspection_year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
