"""Text functions, all inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import LOWERED_DIGITS, RAISED_DIGITS, TERM

#: What str.strip() takes away in most languages: Unicode white space.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Not used by texts; stands between parts while they are one string.
CUT = ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once: what a lambda repeats is computed anew for each element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def split(c: Column, pattern: str = "\n") -> Column:
    return F.split(c, pattern, -1)


def full_lines(c: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(split(c), strip), lambda x: x != "")


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def word_set(c: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), f"[{SPACES}]+"), lambda x: x != ""))


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller word set that the other has too; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def plain_digits(c: Column) -> Column:
    return F.translate(c, LOWERED_DIGITS + RAISED_DIGITS, "0123456789" * 2)
