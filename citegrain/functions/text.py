"""Report text: normalising, tokens, sentences, actors.

The classes below spell out Unicode letters, digits and blanks so that accented words stay whole
in Java regular expressions, which treat `\\w` and `\\s` as ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"

# The patterns of the report study.
ACTOR_PATTERN = rf"[{BLANK}]([a-z]*#[0-9]*)"
PERSON_PATTERN = rf"[{WORD}]+[{BLANK}]?#\p{{Nd}}+"
TOKEN_PATTERN = rf"[{WORD}]+|[^{WORD}{BLANK}]+"
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def normalise(text: Column) -> Column:
    """Lower-case, drop line-break tags, close up blanks around `#`."""
    lower = F.lower(text)
    plain = F.when(F.contains(lower, F.lit("<br")), F.regexp_replace(lower, r"<br/?>", "")).otherwise(lower)
    closed = F.regexp_replace(plain, rf"[{BLANK}]?#[{BLANK}]?", "#")
    # most reports name nobody by number: a byte search spares them the pattern
    return F.when(F.contains(text, F.lit("#")), closed).otherwise(plain)


def actors(text: Column) -> Column:
    """Distinct actor mentions such as `lpn#3`, sorted."""
    found = F.array_sort(F.array_distinct(find_all(text, ACTOR_PATTERN, 1)))
    return F.when(F.contains(text, F.lit("#")), found).when(text.isNotNull(), F.array().cast("array<string>"))


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """All matches of a token pattern, in text order."""
    return find_all(text, pattern)


def sentences(text: Column) -> Column:
    """Trimmed sentences, in text order; blank pieces are left out."""
    pieces = F.transform(
        find_all(text, SENTENCE_PATTERN),
        lambda s: F.regexp_replace(s, rf"^[{BLANK}]+|[{BLANK}]+$", ""),
    )
    return F.filter(pieces, lambda s: s != "")
