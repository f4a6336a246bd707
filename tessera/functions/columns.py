"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words; a null text holds none."""
    hits = [F.coalesce(text, F.lit("")).contains(w) for w in words]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def occurrences(text: Column, word: str) -> Column:
    """How often a word occurs in a text."""
    text = F.coalesce(text, F.lit(""))
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends included; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s　]+|[\s　]+$", "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
