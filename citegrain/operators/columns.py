"""Column selection, renaming and typing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.values import lenient_number, strict_number


def drop_prefixed(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Leave out columns whose name starts with one of the prefixes (case counts)."""
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.startswith(tuple(prefixes))])


def lower_names(df: DataFrame, underscore: bool = False) -> DataFrame:
    """Lower-case names, with blanks as underscores on request."""
    names = [c.lower() for c in df.columns]
    return df.toDF(*[n.replace(" ", "_") for n in names] if underscore else names)


def rename_positions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename the leading columns by position; surplus columns keep their names."""
    return df.toDF(*names, *df.columns[len(names):])


def short_names(long_names: Mapping[str, str]) -> dict[str, str]:
    """Turn a short-to-long rename map round, with lower-case targets."""
    return {long: short.lower() for short, long in long_names.items()}


def cast_numbers(df: DataFrame, columns: Iterable[str], strict: bool = True) -> DataFrame:
    """Cast the named columns that exist to double in one projection."""
    convert = strict_number if strict else lenient_number
    return df.withColumns({c: convert(F.col(f"`{c}`")) for c in columns if c in df.columns})


def promote_header(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Name columns after a known header row and take that row out, wherever it sits."""
    named = rename_positions(df, names)
    is_header = F.lit(True)
    for c in names:
        is_header = is_header & F.col(f"`{c}`").eqNullSafe(F.lit(c))
    return named.where(~is_header)


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str):
    """One row per id and non-null column value."""
    return df.unpivot(list(ids), list(columns), name, value).where(F.col(value).isNotNull())


def union_eras(parts: Iterable[tuple[DataFrame, Mapping[str, str]]], common: Iterable[str]) -> DataFrame:
    """Append tables of different eras: each renamed by its own map, then cut to the common columns."""
    wanted = [F.col(f"`{c}`") for c in common]
    return reduce(DataFrame.unionByName, [df.withColumnsRenamed(dict(m)).select(*wanted) for df, m in parts])
