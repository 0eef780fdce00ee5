"""Column expressions that the plans share. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revenue() -> Column:
    """Price after discount of a line item."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def charge() -> Column:
    """Price after discount and with tax."""
    return revenue() * (1 + F.col("l_tax"))


def money(c: Column, digits: int = 2) -> Column:
    """Rounded, as sums of doubles differ in their last bits by order of addition. Sums of discounted prices have four digits."""
    return F.round(c, digits)


def ratio(c: Column) -> Column:
    return F.round(c, 6)


def year_of(c: str) -> Column:
    return F.year(c).cast("int")


def ts(text: str) -> Column:
    """A time without zone, as the tables store dates."""
    return F.lit(text).cast("timestamp_ntz")


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def two_words(c: str, first: str, second: str) -> Column:
    """LIKE with two words in order."""
    return F.col(c).like(f"%{first}%{second}%")


def starts(c: str, prefix: str) -> Column:
    return F.col(c).startswith(prefix)


def ends(c: str, suffix: str) -> Column:
    return F.col(c).endswith(suffix)


def contains(c: str, word: str) -> Column:
    return F.col(c).contains(word)
