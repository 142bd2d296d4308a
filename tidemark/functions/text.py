"""Column functions over text. Lengths and positions are code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_RATIO = 1.4


def est_tokens(text: Column) -> Column:
    """Token estimate of a text by its length."""
    return F.floor(F.length(text) * F.lit(TOKEN_RATIO)).cast("long")


def anchor(text: Column, size: int = 30) -> Column:
    """The first characters without white space, by which a text is found again."""
    return F.substring(F.regexp_replace(text, r"\s+", ""), 1, size)


def safe_id(text: Column, size: int = 80) -> Column:
    """An identifier: anything but letters, digits, _ and - becomes one underscore."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), 1, size)


def any_of(text: Column, words: list[str]) -> Column:
    """True where the text holds one of the words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def hits(text: Column, words: list[str]) -> Column:
    """How many different words of the list the text holds; each counts once."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("long") for w in words], F.lit(0).cast("long"))


def strip_emphasis(text: Column) -> Column:
    """Text without Markdown asterisks."""
    return F.trim(F.regexp_replace(text, r"\*+", ""))


def first_match(value: Column, cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Ordered alternatives: the value of the first case that holds."""
    out = reduce(lambda acc, case: acc.when(*case), cases[1:], F.when(*cases[0]))
    return out.otherwise(default if default is not None else F.lit(None))


def zero_padded(number: Column, least: int) -> Column:
    """Digits filled with zeros to a least length; lpad alone would cut longer ones."""
    return F.when(F.length(number) < least, F.lpad(number, least, "0")).otherwise(number)
