"""Small helpers on whole texts that several operators share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space is these six characters wherever words are counted or compared.
SPACE = r"[\x20\x09-\x0D]"

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
BENCHMARK = "item_id bigint, text string"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(LABELS).parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(BENCHMARK).parquet(f"{sf_dir}/benchmark.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of maximal runs without white space; 0 for null."""
    text = whole_text(column)
    pieces = F.size(F.split(text, f"{SPACE}+"))
    outer = text.rlike(f"^{SPACE}").cast("int") + text.rlike(rf"{SPACE}\z").cast("int")
    return F.when(text.rlike(r"^[\x20\x09-\x0D]*\z"), 0).otherwise(pieces - outer).cast("bigint")


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def slices(sizes, most: int):
    """(start, end) ranges that cover a batch in order, each of `most` bytes or of a single row."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column: pa.Array, most: int):
    """(start, end, texts) of a batch's slices of `most` characters; only one slice's texts are Python objects."""
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    for a, b in slices(lengths, most):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
