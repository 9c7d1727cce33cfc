"""Parquet and CSV sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.sources.schemas import all_text

LATIN_1 = "ISO-8859-1"


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None) -> DataFrame:
    """Parquet file or folder; a declared schema saves looking into the files first."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_text_columns(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    header: bool = True,
    encoding: str = "UTF-8",
    pattern: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with every column as text, so that ids keep their leading zeros.

    `pattern` picks files of a folder by name.  With `columns` the file is read once; without, Spark
    looks at the header only.  Reports with line breaks inside quotes need `multi_line`, which gives
    up splitting one file over tasks.
    """
    reader = (
        spark.read.option("header", header)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
    )
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if columns:
        reader = reader.schema(all_text(columns)).option("enforceSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_typed(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """Text source cast to a declared schema in one projection; unreadable values become null."""
    text = read_text_columns(spark, path, schema.names, **options)
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def local_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """Small driver rows as a table, NaN as null."""
    df = spark.createDataFrame(rows, schema)
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def write_table(df: DataFrame, path: str, overwrite: bool = False, by: Sequence[str] = ()) -> None:
    """Parquet; an existing target is an error unless overwriting is asked for."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = False, encoding: str = "UTF-8") -> None:
    """CSV, replacing what is there."""
    df.write.mode("overwrite").option("header", header).option("encoding", encoding).csv(path)
