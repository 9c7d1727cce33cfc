"""Text extracts that name their own columns: one scan over files of any number and layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.operators.durable import stored
from citegrain.sources.files import read_text_columns


def read_headed(
    spark: SparkSession, path: str | Sequence[str], saved_index: bool = False, most_columns: int = 256, **options
) -> DataFrame:
    """CSV files whose first record names the columns, joined by column name, all as text.

    The header of a file is the first record of its first block, so a like row further down is data.  Headers are
    looked up first; the rows are then read as wide as the widest header, so no field is parsed that none names,
    and kept in the shared folder.
    A record of more than `most_columns` fields is an error.  Distinct headers are few and come to the driver; files
    keep to their tasks.  Columns follow the order of the headers, by file name; a blank name becomes `_c` and its
    place, a repeated one gets its place added.  With `saved_index` a first column without a name of its own is left
    out.  Files without a record add nothing.
    """
    fields = [f"_f{i}" for i in range(most_columns + 1)]
    raw = read_text_columns(spark, path, fields, header=False, **options)
    if raw.where(F.col(fields[-1]).isNotNull()).limit(1).count():
        raise ValueError(f"a record has more than {most_columns} fields")
    heads = stored(first_records(spark, path, fields, **options))
    found = heads.groupBy("_names").agg(F.min("_file").alias("_file")).orderBy("_file").collect()
    layouts = [_unique(r["_names"], saved_index) for r in found]
    number = F.array_position(F.array(*[F.array(*map(F.lit, r["_names"])) for r in found]), F.col("_names")) if found else F.lit(0)
    wide = fields[: max([1, *map(len, layouts)])]
    data = read_text_columns(spark, path, wide, header=True, **options).select("*", F.col("_metadata.file_path").alias("_file"))
    rows = data.join(heads.select("_file", number.alias("_layout")), "_file")
    names = list(dict.fromkeys(n for layout in layouts for n in layout if n))
    picked = rows.select(*[_picked(layouts, fields, n).alias(f"_{i}") for i, n in enumerate(names)])
    return stored(picked).toDF(*names) if names else picked


def first_records(
    spark: SparkSession, path: str | Sequence[str], fields: Sequence[str], encoding: str = "UTF-8",
    pattern: str | None = None, multi_line: bool = False,
) -> DataFrame:
    """(_file, _names): the trimmed fields of each file's first record that is not blank."""
    if multi_line:
        rows = read_text_columns(spark, path, fields, header=False, encoding=encoding, pattern=pattern, multi_line=True)
        record = F.struct(*fields)
    else:
        reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
        rows = reader.text(path if isinstance(path, str) else list(path))
        rows = rows.where(F.col("value").rlike(r"[^\x00-\x20]"))
        record = F.decode(F.col("value").cast("binary"), encoding) if encoding != "UTF-8" else F.col("value")
    numbered = rows.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("_file"), record.alias("_record"), F.monotonically_increasing_id().alias("_row")
    )
    # one number a file: an aggregate that kept the text would sort all lines
    first = numbered.join(F.broadcast(numbered.groupBy("_file").agg(F.min("_row").alias("_row"))), ["_file", "_row"])
    if not multi_line:
        parsed = F.from_csv("_record", ", ".join(f"{f} string" for f in fields), {"quote": '"', "escape": '"'})
        first = first.select("_file", parsed.alias("_record"))
    width = F.array_max(F.array(*[F.when(F.col(f"_record.{f}").isNotNull(), i + 1).otherwise(0) for i, f in enumerate(fields)]))
    filled = F.array(*[F.coalesce(F.trim(f"_record.{f}"), F.lit("")) for f in fields])
    return first.select("_file", F.slice(filled, F.lit(1), width).alias("_names"))


def _unique(names: Sequence[str], saved_index: bool) -> list[str | None]:
    """Names of a layout by place; None for a saved index."""
    out: list[str | None] = []
    for i, n in enumerate(names):
        if saved_index and i == 0 and (n in ("", "_c0") or n.startswith("Unnamed")):
            out.append(None)
        else:
            n = n or f"_c{i}"
            out.append(f"{n}{i}" if n in out else n)
    return out


def _picked(layouts: list[list[str | None]], fields: list[str], name: str) -> Column:
    """The field that holds a column in a row's layout; null where the layout lacks it."""
    value = F.lit(None).cast("string")
    for number, layout in enumerate(layouts, 1):
        if name in layout:
            value = F.when(F.col("_layout") == number, F.col(fields[layout.index(name)])).otherwise(value)
    return value


def read_extracts(spark: SparkSession, folder: str | Sequence[str], part: str = "text", **options) -> DataFrame:
    """All CSV extracts whose file name holds `part`, without their saved index column, joined by column name."""
    combined = read_headed(spark, folder, saved_index=True, pattern=f"*{part}*", **options)
    if not combined.columns:
        raise FileNotFoundError(f"no extract named *{part}* in {folder}")
    return combined
