"""Text helpers as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# White space inside a line, for patterns that must not run over a line end.
BLANK = r"[^\S\n]"


def rx(pattern: str, flags: str = "") -> str:
    """A pattern with Unicode classes and newline as the only line end.

    ``flags`` takes any of ``i`` (ignore case), ``m`` (line anchors) and
    ``s`` (dot matches newline).
    """
    return f"(?dU{flags}){pattern}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Higher-order functions re-evaluate whatever they close over for every
    element; a one-element transform pins the value as a lambda variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(text: Column) -> Column:
    """The text, or NULL when it is empty; ``nullif`` would evaluate it twice."""
    return let(text, lambda t: F.when(t != "", t))


def first_match(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """First match of a group, NULL when there is none."""
    return filled(F.regexp_extract(text, rx(pattern, flags), group))


def all_matches(text: Column, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def squeeze(text: Column, limit: int | None = None) -> Column:
    """Collapse runs of white space, trim, and cut to ``limit`` characters."""
    flat = strip(F.regexp_replace(text, rx(r"\s+"), " "))
    return F.substring(flat, 1, limit) if limit else flat


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def non_empty(items: Column) -> Column:
    """The array itself, or NULL when it has no element."""
    return let(items, lambda a: F.when(F.size(a) > 0, a))


def first_non_empty(*candidates: Column) -> Column:
    """Fallback chain over arrays: later ones run only if earlier gave nothing."""
    return F.coalesce(*[non_empty(c) for c in candidates])
