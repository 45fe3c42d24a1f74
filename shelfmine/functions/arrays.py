"""Array building blocks used inside one row, so that no shuffle is needed.

A document is one row, hence its tokens, lines and sections are bounded by that row. Grouping them with
array functions keeps parsing, counting and chunking in the map side of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters removed by a Unicode-aware strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda variable is computed once per row, whereas a plain expression repeated inside a lambda would be
    recomputed for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def lines_of(text: Column) -> Column:
    """Split on line feeds only, keeping empty lines."""
    return F.split(text, "\n", -1)


def run_lengths(values: Column, name: str = "term", count: str = "tf") -> Column:
    """``array<struct<name, count>>`` of distinct values, by sorting once and measuring the runs."""

    def runs(ordered: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            first,
            lambda starts: F.transform(
                starts,
                lambda start, j: F.struct(
                    F.get(ordered, start).alias(name),
                    (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - start).alias(count),
                ),
            ),
        )

    # sequence(0, -1) would count downwards, so empty input yields null and explodes to no row
    return let(F.sort_array(values), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)))


def islands(lines: Column, is_head: Callable[[Column], Column]) -> Column:
    """Cut an array of lines at its head lines.

    Returns ``array<struct<head, body array<string>>>``; lines before the first head are dropped.
    """

    def cut(all_lines: Column, heads: Column) -> Column:
        return F.transform(
            heads,
            lambda position, j: F.struct(
                F.get(all_lines, position - 1).alias("head"),
                F.slice(
                    all_lines,
                    position + 1,
                    F.coalesce(F.get(heads, j + 1), F.size(all_lines) + 1) - position - 1,
                ).alias("body"),
            ),
        )

    return let(lines, lambda all_lines: let(head_positions(all_lines, is_head), lambda heads: cut(all_lines, heads)))


def head_positions(lines: Column, is_head: Callable[[Column], Column]) -> Column:
    """One-based positions of the lines that satisfy ``is_head``."""
    return F.filter(
        F.transform(lines, lambda line, i: F.when(is_head(line), i + 1).otherwise(F.lit(0))),
        lambda position: position > 0,
    )


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``first[i], first[i] + 1, ...``, ``sizes[i]`` of them, of all ``i`` one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
