"""Array helpers that keep per-file work inside one row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    Inside a lambda an outer expression would otherwise be computed again for every
    element; a lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def where_index(items: Column, test: Callable[[Column], Column]) -> Column:
    """Ascending zero-based positions of the elements that pass ``test``."""
    marked = F.transform(items, lambda x, i: F.when(test(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def positions_of(items: Column, symbol: str) -> Column:
    return where_index(items, lambda x: x == symbol)


def cut(items: Column, start: Column, end: Column) -> Column:
    """Elements ``start`` (inclusive, zero-based) to ``end`` (exclusive), clipped."""
    stop = F.least(end, F.size(items))
    return F.slice(items, start + 1, F.greatest(stop - start, F.lit(0)))


def join_lines(lines: Column) -> Column:
    """Serialise lines of tokens: tokens by space, lines by newline."""
    return F.array_join(F.transform(lines, lambda line: F.array_join(line, " ")), "\n")


def lines_containing(lines: Column, symbol: str) -> Column:
    """Indexes of the lines in which ``symbol`` is a token."""
    return where_index(lines, lambda line: F.array_contains(line, symbol))


def mask_prefix(ids: Column, context_len: Column, ignored: int) -> Column:
    """``ids`` with the first ``context_len`` entries replaced by ``ignored``."""
    masked = F.least(context_len, F.size(ids))
    return F.concat(F.array_repeat(F.lit(ignored), masked), cut(ids, masked, F.size(ids)))


def pad(items: Column, width: Column, fill: int, left: bool = True) -> Column:
    filler = F.array_repeat(F.lit(fill), width - F.size(items))
    return F.concat(filler, items) if left else F.concat(items, filler)
