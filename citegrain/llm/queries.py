"""One registered query per operator, over the whole of its table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from citegrain.llm import (
    class_lm, crf, decontamination, exact_dedup, grammar_store, hard_negatives, lexical_search, line_dedup, mixing, packing,
    quality_rules, shingle_join, suffix_dedup,
)
from citegrain.llm.texts import benchmark, documents, embeddings, fold, labels, whole_text, word_count
from citegrain.operators.durable import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = crf.fit(docs, labels(spark, sf_dir))
    return crf.with_score(docs, chain).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query()
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of lines and the numbers of those that go."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    gone = line_dedup.doubled_lines(docs).groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    lines = docs.select("doc_id", F.size(F.split(whole_text(), "\n")).cast("bigint").alias("n_lines"))
    return lines.join(gone, F.coalesce("doc_id", F.lit(line_dedup.LAST_ID)) == F.col("id"), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), "gone"
    )


@query()
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    docs = documents(spark, sf_dir)
    # texts are read once; what sampling needs of a document is four numbers
    light = stored(docs.select("doc_id", "source", word_count().alias("size"), mixing.clean_share("text").alias("worth")))
    mixed = mixing.mix(light, quality=F.col("worth"), size=F.col("size"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("row.doc_id", "size", "source_size", "target", taken, "copies")


@query()
def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its place in its document and in its sequence."""
    docs = documents(spark, sf_dir)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("tokens")


@query()
def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its set of five-word shingles and the smallest id it is linked with."""
    return shingle_join.groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query()
def op10_grammar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the compressed files: its place among all ids, its number of ids and their checksum."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return grammar_store.read(grammar_store.write(documents(spark, sf_dir), path, end_id=0, first_free=50257))


@query(
    r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
groups AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN groups USING (text_sha256)
"""
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the copy that stays, the number of copies and a digest of the compared text."""
    return exact_dedup.duplicates(documents(spark, sf_dir))


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base counts, whether it fails by them alone, and the voters' verdict."""
    counts = stored(quality_rules.base_counts(documents(spark, sf_dir)))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return quality_rules.judged(counts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("good")).alias("kept"), "posterior",
    )


@query()
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the bytes that an earlier document has in runs of 50 or more, and a digest of the rest."""
    return suffix_dedup.dedup(documents(spark, sf_dir)).drop("kept")


@query()
def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token counts, the unigram base score and the class model's score."""
    scores = class_lm.scores(documents(spark, sf_dir))
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


@query(
    r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
items AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark))),
wanted AS (SELECT i, item_id, term, count(*)::BIGINT AS repeats FROM items GROUP BY ALL),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term),
parts AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l)))) AS part
  FROM tf JOIN weights USING (term) JOIN sizes USING (r), totals),
scored AS (
  SELECT i, item_id, doc_id, r, sum(repeats * part)::BIGINT AS score FROM wanted JOIN parts USING (term) JOIN sizes USING (r) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark item: its 20 highest-scoring documents."""
    return lexical_search.search(documents(spark, sf_dir), benchmark(spark, sf_dir))


@query(
    """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per anchor and positive: the first ten rows of other labels whose scores lie in the positive's window."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir), F.col("id") % 100 == 0, label)


@query(
    r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10)::BIGINT AS k, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
grams AS (
  SELECT r, i, k, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(words) >= k)),
found AS (SELECT DISTINCT r, i, k, item_id FROM grams JOIN windows USING (k, gram)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r),
held AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""
)
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those that stand in windows of the benchmark, and the items concerned."""
    found = decontamination.hits(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
