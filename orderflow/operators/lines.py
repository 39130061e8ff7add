"""Line-level operators on whole document texts.

A document is one row, so everything here works on the array of its lines
inside that row: no shuffle, no window, and one very long document costs only
its own task. Results become rows with a final explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.text import first_of, let, lines_of, matches, strip

Predicate = Callable[[Column], Column]


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per (document, line), numbered from 0."""
    return docs.select("doc_id", F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def stripped_lines(text: Column) -> Column:
    return F.transform(lines_of(text), strip)


def head_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def head_lines(text: Column, n: int) -> Column:
    return F.slice(lines_of(text), 1, n)


def text_before(text: Column, markers: list[str], limit: int | None = None) -> Column:
    """Text before the first marker that occurs, else all; ``limit`` cuts it if given."""
    end = F.lit(limit) if limit else F.length(text)
    for marker in reversed(markers):
        at = F.locate(marker, text)
        end = F.when(at > 0, at - 1).otherwise(end)
    return F.substring(text, F.lit(1), F.least(end, F.lit(limit)) if limit else end)


def first_line(lines: Column, keep: Predicate) -> Column:
    """First line that qualifies, NULL if none does."""
    return first_of(F.filter(lines, keep))


def indexes_where(lines: Column, keep: Predicate) -> Column:
    """Positions of qualifying lines, in order."""
    marked = F.transform(lines, lambda x, i: F.when(keep(x), i))
    return F.array_compact(marked)


def first_neighbour(lines: Column, pick: Callable[[Column, Column, Column], Column]) -> Column:
    """First non-null ``pick(previous, line, next)`` over the lines of a document."""
    return let(
        lines,
        lambda ls: first_of(
            F.array_compact(
                F.transform(ls, lambda x, i: pick(F.get(ls, i - 1), x, F.get(ls, i + 1)))
            )
        ),
    )


def first_within(lines: Column, anchor: Predicate, wanted: Predicate, span: int) -> Column:
    """First wanted line among the ``span`` lines after the first anchor line."""
    return let(
        lines,
        lambda ls: let(
            first_of(indexes_where(ls, anchor)),
            lambda at: first_line(F.slice(ls, at + 2, F.lit(span)), wanted),
        ),
    )


def blocks(lines: Column, start: Predicate) -> Column:
    """Cut lines into blocks, each from one start line up to the next.

    Gives ``array<struct<start, lines>>``; lines before the first start belong
    to no block.
    """
    return let(
        lines,
        lambda ls: let(
            indexes_where(ls, start),
            lambda at: F.transform(
                at,
                lambda s, k: F.struct(
                    s.alias("start"),
                    F.slice(
                        ls, s + 1, F.coalesce(F.get(at, k + 1), F.size(ls)) - s
                    ).alias("lines"),
                ),
            ),
        ),
    )


def blocks_ending(lines: Column, end: Predicate) -> Column:
    """Cut lines into blocks that each run up to and including an end line."""
    return let(
        lines,
        lambda ls: let(
            indexes_where(ls, end),
            lambda at: F.transform(
                at,
                lambda e, k: let(
                    F.coalesce(F.get(at, k - 1) + 1, F.lit(0)),
                    lambda s: F.struct(
                        s.alias("start"), F.slice(ls, s + 1, e - s + 1).alias("lines")
                    ),
                ),
            ),
        ),
    )


def segment_blocks(docs: DataFrame, start_pattern: str, code_position: str = "before") -> DataFrame:
    """Blocks as rows: (doc_id, block_no, start, lines).

    ``code_position`` says whether the matching line opens its block or, with
    ``after``, closes it.
    """
    if code_position not in ("before", "after"):
        raise ValueError("code_position must be 'before' or 'after'")
    cut = blocks if code_position == "before" else blocks_ending
    found = cut(stripped_lines(F.col("text")), lambda x: matches(x, start_pattern))
    return docs.select("doc_id", F.posexplode(found).alias("block_no", "b")).select(
        "doc_id", "block_no", "b.start", "b.lines"
    )


def islands(lines: Column, member: Predicate, least: int) -> Column:
    """Maximal runs of consecutive member lines, of at least ``least`` lines."""

    def edge(ls: Column, step: int) -> Column:
        outside = lambda i: ~F.coalesce(member(F.get(ls, i + step)), F.lit(False))
        return F.array_compact(
            F.transform(ls, lambda x, i: F.when(member(x) & outside(i), i))
        )

    runs = let(
        lines,
        lambda ls: F.zip_with(
            edge(ls, -1), edge(ls, 1), lambda s, e: F.slice(ls, s + 1, e - s + 1)
        ),
    )
    return F.filter(runs, lambda run: F.size(run) >= least)


def until(lines: Column, stop: Predicate) -> Column:
    """Lines before the first stop line; all of them when there is none."""
    return let(
        lines,
        lambda ls: let(
            first_of(indexes_where(ls, stop)),
            lambda at: F.slice(ls, F.lit(1), F.coalesce(at, F.size(ls))),
        ),
    )
