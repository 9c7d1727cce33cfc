"""Report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrain.functions import text as t
from citegrain.operators import boundaries, reports
from citegrain.operators.durable import stored
from workload import views as v
from workload.registry import query

BLANK, WORD = t.BLANK, t.WORD


def normal(column: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({column}), '<br/?>', '', 'g'), '[{BLANK}]?#[{BLANK}]?', '#', 'g')"


def pieces(column: str) -> str:
    return rf"""list_filter(list_transform(regexp_extract_all({column}, '{t.SENTENCE_PATTERN}'),
  lambda s: regexp_replace(s, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')), lambda s: s <> '')"""


def docs(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"SELECT page_id, {normal('html')} AS report FROM pages")
def normalise_text(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", t.normalise(F.col("html")).alias("report"))


@query(f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(
  regexp_extract_all({normal('text')}, '{t.ACTOR_PATTERN}', 1))), '|'), '') AS actors FROM documents""")
def actors(spark, sf_dir):
    return reports.actor_rows(docs(spark, sf_dir), "doc_id", "text").withColumn("actors", F.concat_ws("|", "actors"))


@query(f"""WITH p AS (SELECT doc_id, {pieces('text')} AS pieces FROM documents)
SELECT doc_id, CAST(i - 1 AS INT) AS pos, pieces[i] AS sentence
FROM (SELECT doc_id, pieces, unnest(generate_series(1, len(pieces))) AS i FROM p)""")
def sentences(spark, sf_dir):
    return reports.sentence_rows(docs(spark, sf_dir), "doc_id", "text")


MARKED = rf"[{WORD}]+[{BLANK}]?#+"


@query(f"""SELECT doc_id, CAST(len(m) AS INT) AS n_tokens, coalesce(array_to_string(m, '|'), '') AS tokens
FROM (SELECT doc_id, regexp_extract_all(text, '{MARKED}') AS m FROM documents)""")
def pattern_tokens(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", t.tokens(F.col("text"), MARKED).alias("tokens"))
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), F.concat_ws("|", "tokens").alias("tokens"))


@query(f"""SELECT doc_id, CAST(len(m) AS INT) AS n_tokens, coalesce(array_to_string(m, '|'), '') AS tokens
FROM (SELECT doc_id, regexp_extract_all(text, '{t.TOKEN_PATTERN}') AS m FROM documents)""")
def word_tokens(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", t.tokens(F.col("text")).alias("tokens"))
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), F.concat_ws("|", "tokens").alias("tokens"))


@query(f"""WITH n AS (SELECT doc_id, {normal('text')} AS tx FROM documents),
s AS (SELECT doc_id, row_number() OVER () AS sid, sentence FROM (
  SELECT doc_id, unnest({pieces('tx')}) AS sentence FROM n)),
a AS (SELECT doc_id, sid, unnest(list_distinct(regexp_extract_all(' ' || sentence, '{t.ACTOR_PATTERN}', 1))) AS name
  FROM s)
SELECT l.doc_id, l.name AS a, r.name AS b, count(*) AS n
FROM a l JOIN a r ON l.sid = r.sid AND l.name < r.name GROUP BY ALL""")
def actor_edges(spark, sf_dir):
    return reports.co_mentions(docs(spark, sf_dir), "doc_id", "text")


@query("SELECT CAST(year(l_shipdate) AS INT) AS inspection_year, count(*) AS n FROM lineitem GROUP BY ALL")
def reports_by_year(spark, sf_dir):
    return reports.reports_by_year(v.table(spark, sf_dir, "lineitem"), "l_shipdate")


# A sentence end is judged by how often words stand with a stop; the share of stops is that of the corpus.
STOPS = rf"""tok AS (SELECT regexp_replace(unnest(regexp_extract_all(text, '[^{BLANK}]+[{BLANK}]*')), '[{BLANK}]+$', '') AS bare FROM documents),
seen AS (SELECT regexp_extract(bare, '{boundaries.WORD.replace("'", "''")}', 1) AS seen,
  regexp_extract(bare, '{boundaries.WORD.replace("'", "''")}', 2) AS stop FROM tok),
cnt AS (SELECT lower(seen) AS word, count(*) FILTER (WHERE stop = '.') AS with_stop, count(*) FILTER (WHERE stop = '') AS without_stop,
  count(*) FILTER (WHERE lower(seen[1]) = seen[1] AND upper(seen[1]) <> seen[1]) AS small
  FROM seen WHERE regexp_matches(seen, '\p{{L}}') GROUP BY ALL),
par AS (SELECT sum(with_stop) / sum(with_stop + without_stop)::DOUBLE AS p FROM cnt),
lik AS (SELECT *, length(replace(word, '.', '')) AS len,
  -2 * (with_stop * ln(p) + without_stop * ln(1 - p) - with_stop * ln(0.99) - without_stop * ln(1 - 0.99)) AS ratio FROM cnt, par)"""


@query(f"""WITH {STOPS} SELECT word, with_stop, without_stop, small,
  round(ratio * exp(-len) * (length(word) - len + 1) * pow(len::DOUBLE, -without_stop), 6) AS score FROM lik""")
def stop_statistics(spark, sf_dir):
    return boundaries.stop_statistics(docs(spark, sf_dir), "text").withColumn("score", F.round("score", 6))


@query("""SELECT o_custkey AS facility_id, o_orderkey AS eventid, o_orderpriority AS inspection_text, o_orderstatus AS deficiency_tag,
  CAST(year(o_orderdate) AS VARCHAR) AS scope_severity FROM orders""")
def text_side_table(spark, sf_dir):
    """The side table of texts, written and read again."""
    orders = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("facility_id"), F.col("o_orderkey").alias("eventid"), F.col("o_orderpriority").alias("inspection_text"),
        F.col("o_orderstatus").alias("deficiency_tag"), F.year("o_orderdate").cast("string").alias("scope_severity"), "o_totalprice",
    )
    return stored(reports.text_table(orders))
