"""Pieces that the expressions of proposal text are put together from, in Java's dialect."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "[0-9]+"
DASH = "[-–]"
#: A month's letter, Latin or Greek.
MONTH = "[MmΜμ]"


def either(choices: Iterable[str]) -> str:
    return f"(?:{'|'.join(choices)})"


def loose(words: str) -> str:
    """The words, with any white space or none between them."""
    return r"\s*".join(words.split())


def spaced(words: str) -> str:
    """The words, with some white space between them."""
    return r"\s+".join(words.split())


def after_first(text: Column, mark: str) -> Column:
    """What follows the first mark; null without one."""
    return F.get(F.split(text, mark, 2), F.lit(1))


def begins(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i)^{pattern}")
