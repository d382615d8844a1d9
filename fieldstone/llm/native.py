"""Small building blocks for array expressions in DataFrame code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators between words, as a Java regular expression and as characters.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def most(numbers: Column) -> Column:
    """The largest of an array of long; 0 for an empty one."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))


def running_before(numbers: Column, fold: Callable[[Column], Column], chunk: int = 128) -> Column:
    """For each entry of an array of long the fold (total or most) of those before it, in two levels of chunks."""

    def over(arr: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / chunk).cast("int")), lambda c: F.slice(arr, c * chunk + 1, chunk)
        )
        return let(chunks, lambda ch: let(F.transform(ch, fold), lambda folded: _shifted(ch, folded, fold)))

    return F.when(F.size(numbers) == 0, F.array().cast("array<long>")).otherwise(let(numbers, over))


def _shifted(chunks: Column, folded: Column, fold: Callable[[Column], Column]) -> Column:
    def within(ch: Column, base: Column) -> Column:
        return F.transform(ch, lambda x, i: fold(F.array(base, fold(F.slice(ch, F.lit(1), i)))))

    return F.flatten(F.transform(chunks, lambda ch, c: let(fold(F.slice(folded, F.lit(1), c)), lambda base: within(ch, base))))


def words(text: Column) -> Column:
    """The non-empty words of a text, split at runs of blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    """The text without some characters."""
    return F.translate(text, chars, "")
