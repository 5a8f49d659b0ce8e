"""Setting text to a width: advances, the size at which a text is just so wide, and rules that fit or undo themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.folds import let
from pageloom.functions.text import bounded_spans

#: The share of a size below which a token isn't shrunk, and the least share that may be asked for.
FLOOR, LEAST_FLOOR = 0.45, 0.05


@dataclass(frozen=True)
class FitRule:
    literal: str
    token: str
    floor: float = 0.0

    def share(self) -> float:
        return max(self.floor, LEAST_FLOOR) if self.floor > 0 else FLOOR


def advance(text: Column, size: Column, width: Callable[[Column], Column], char_spacing: float = 0.0, word_spacing: float = 0.0) -> Column:
    """How wide a text is: ``width`` of a character is in thousandths of the size, spacing is absolute. Null if a width is."""
    characters = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    glyphs = F.aggregate(characters, F.lit(0.0), lambda acc, c: acc + width(c))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return glyphs / 1000 * size + F.length(text) * char_spacing + spaces * word_spacing


def fit_size(size: Column, full: Column, half: Column, want: Column, share: float = FLOOR) -> Column:
    """struct(size, fits) for a text that is ``full`` wide at ``size`` and ``half`` at half of it: widths are affine in the size,
    so both measurements give the size at which it is ``want`` wide. It is never enlarged, and not shrunk below ``share``
    of the size: then it doesn't fit. Nor does one that no size makes narrow enough; it keeps its size, as it does where
    something isn't known."""

    def solved(scaled: Column) -> Column:
        exact = F.try_divide(want - (full - scaled * size), scaled)
        tight = exact < size * share
        return F.struct(F.when(tight, size * share).otherwise(exact).alias("size"), (~tight).alias("fits"))

    known = (size > 0) & (want > 0) & full.isNotNull() & half.isNotNull()
    scaled = F.try_divide(full - half, size / 2)
    stays = lambda fits: F.struct(size.cast("double").alias("size"), F.lit(fits).alias("fits"))
    return F.when(~F.coalesce(known, F.lit(False)) | ((full > want) & (scaled <= 0)), stays(False)).when(full <= want, stays(True)).otherwise(let(scaled, solved))


def _taken(rule: FitRule, size: Column, measured: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """What is taken once a rule has had its turn. Every hit of a rule has the same text, so it is measured once; what was
    taken before is named once, so that expressions of many rules don't multiply."""
    token, literal = F.lit(rule.token), F.lit(rule.literal)
    # Named once: the fit asks for each of them several times, and a measurement goes through all characters.
    widths = F.struct(measured(token, size).alias("full"), measured(token, size / 2).alias("half"), measured(literal, size).alias("want"))
    fit = let(widths, lambda w: fit_size(size, w["full"], w["half"], w["want"], rule.share()))
    span = lambda f: lambda h: F.struct(h["lo"].alias("lo"), h["hi"].alias("hi"), token.alias("token"), f["size"].alias("size"))

    def after(before: Column) -> Column:
        apart = lambda h: ~F.exists(before, lambda t: (h["lo"] < t["hi"]) & (t["lo"] < h["hi"]))
        free = lambda f: F.transform(F.filter(bounded_spans(F.col("text"), rule.literal), apart), span(f))
        # A text without the literal is left before anything is measured or cut.
        return F.when(F.contains(F.col("text"), literal), let(fit, lambda f: F.when(f["fits"], F.concat(before, free(f))).otherwise(before))).otherwise(before)

    return after


def fitted(rows: DataFrame, rules: list[FitRule], size: Column, width: Callable[[Column], Column], char_spacing: float = 0.0, word_spacing: float = 0.0) -> DataFrame:
    """``rows`` (text, ...) with placed, an array of (lo, hi, token, size) in order: what each rule's bounded hits become, so that
    nothing else moves.

    Rules come in order. A hit that overlaps one already taken is passed over; a rule of which some hit can't be set to its width
    undoes itself, all its hits, and no other rule."""
    kind = "array<struct<lo:int,hi:int,token:string,size:double>>"
    measured = lambda t, s: advance(t, s, width, char_spacing, word_spacing)
    rows = rows.withColumn("placed", F.array().cast(kind))
    for rule in rules:
        rows = rows.withColumn("placed", let(F.col("placed"), _taken(rule, size, measured)).cast(kind))
    return rows.withColumn("placed", F.array_sort("placed"))


def with_tokens(text: Column, placed: Column) -> Column:
    """A text with what ``fitted`` gives in place."""
    before = lambda i: F.coalesce(F.get(placed, i - 1)["hi"], F.lit(0))
    parts = F.transform(placed, lambda p, i: F.concat(F.substring(text, before(i) + 1, p["lo"] - before(i)), p["token"]))
    return F.concat(F.array_join(parts, ""), F.substring(text, before(F.size(placed)) + 1, F.length(text)))
