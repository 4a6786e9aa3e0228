"""Words, lines and row keys shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns of the word definitions.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def words_of(text: Column, pattern: str = SPACED_WORD) -> Column:
    """The words of a text in order; an absent text has none."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, name: str, value: Column, *carried: Column | str) -> DataFrame:
    """`carried` and a costly column that filters and later columns read but never compute again.

    The optimizer copies column definitions into filters and lambdas; it does not look into a generator.
    """
    return df.select(*carried, F.explode(F.array(value)).alias(name))


def row_key(*columns: str) -> Column:
    """A number that only rows with equal values share; absent values count as values."""
    parts = []
    for name in columns:
        parts += [F.col(name).isNull(), F.col(name)]
    return F.xxhash64(*parts)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
