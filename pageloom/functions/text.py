"""Column expressions for literal matching and replacement in text. Offsets count characters, not bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.folds import let, running_sums

WORD_CHAR = r"^[\p{L}\p{Nd}]$"
#: Fixed value: the share of a space from which a gap is one.
WORD_GAP = 0.70
HYPHENS = "-­‐‑"


def pieces(text: Column, literal: str | Column) -> Column:
    """Text between the non-overlapping occurrences of ``literal``, left to right; a hit lies between two neighbours."""
    if isinstance(literal, Column):
        return F.split(text, F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    return F.split(text, "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def hit_is_bounded(parts: Column, i: Column, literal: str | Column) -> Column:
    """Whether hit ``i`` (from 1) has no letter or digit on either side. A neighbour without text is the literal itself,
    unless it is the text's edge, so a hit that is turned down still uses up its text."""
    left, right = F.get(parts, i - 1), F.get(parts, i)
    first, last = (F.left(literal, F.lit(1)), F.right(literal, F.lit(1))) if isinstance(literal, Column) else (F.lit(literal[0]), F.lit(literal[-1]))
    before = F.when((F.length(left) > 0) | (i == 1), F.right(left, F.lit(1))).otherwise(last)
    after = F.when((F.length(right) > 0) | (i == F.size(parts) - 1), F.left(right, F.lit(1))).otherwise(first)
    return ~before.rlike(WORD_CHAR) & ~after.rlike(WORD_CHAR)


def _hits(parts: Column) -> Column:
    return F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))


def bounded_hits(text: Column, literal: str) -> Column:
    """How often ``literal`` stands as words of its own."""
    return let(pieces(text, literal), lambda parts: F.size(F.filter(_hits(parts), lambda i: hit_is_bounded(parts, i, literal))))


def anywhere_hits(text: Column, literal: str) -> Column:
    return F.size(pieces(text, literal)) - 1


def _placed(parts: Column, size: Column, wanted: Callable[[Column], Column]) -> Column:
    def spans(ends: Column) -> Column:
        each = F.transform(_hits(parts), lambda i: F.struct((F.get(ends, i - 1) + (i - 1) * size).alias("lo"), (F.get(ends, i - 1) + i * size).alias("hi"), wanted(i).alias("ok")))
        return F.transform(F.filter(each, lambda s: s["ok"]), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))

    return let(running_sums(F.transform(parts, lambda p: F.length(p))), spans)


def bounded_spans(text: Column, literal: str | Column) -> Column:
    """Array of (lo, hi) of the bounded hits, in order. The literal may be a column."""
    size = F.length(literal) if isinstance(literal, Column) else F.lit(len(literal))
    return let(pieces(text, literal), lambda parts: _placed(parts, size, lambda i: hit_is_bounded(parts, i, literal)))


def anywhere_spans(text: Column, literal: str | Column) -> Column:
    """Array of (lo, hi) of all hits, in words too."""
    size = F.length(literal) if isinstance(literal, Column) else F.lit(len(literal))
    return let(pieces(text, literal), lambda parts: _placed(parts, size, lambda i: F.lit(True)))


def replace_bounded(text: Column, literal: str, token: str) -> Column:
    """Text with each bounded hit of ``literal`` replaced; hits inside words stay."""

    def glued(parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(hit_is_bounded(parts, i, literal), F.lit(token)).otherwise(F.lit(literal)), p)))

    return F.array_join(let(pieces(text, literal), glued), "")


def dehyphenate(text: Column) -> Column:
    """Words broken over lines put together: only what stands before the hyphen is looked at."""
    return F.regexp_replace(text, rf"([\p{{L}}\p{{Nd}}])[{HYPHENS}][ \t]*\n", "$1")


def flatten_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def needs_space(before: Column, after: Column, gap: Column, space_width: Column) -> Column:
    """Whether two runs read as two words: a gap of more than WORD_GAP of a space, and no white space at the seam."""
    seam = F.right(before, F.lit(1)).rlike("[\\s ]") | F.left(after, F.lit(1)).rlike("[\\s ]")
    return (gap > WORD_GAP * F.when(space_width <= 0, F.lit(1.0)).otherwise(space_width)) & ~seam
