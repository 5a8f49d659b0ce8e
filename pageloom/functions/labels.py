"""Page labels: number styles and the label of a page from its range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place values of Roman numerals.
ROMAN = (
    ("", "m", "mm", "mmm"),
    ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"),
    ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"),
    ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"),
)


def roman(n: Column) -> Column:
    """Lower-case numeral of 1 to 3999, decimal beyond."""
    places = [F.get(F.array(*map(F.lit, digits)), (F.floor(n / 10 ** (3 - i)) % 10).cast("int")) for i, digits in enumerate(ROMAN)]
    return F.when(n > 3999, n.cast("string")).otherwise(F.concat(*places))


def letters(n: Column, first: Column | int = 97) -> Column:
    """a to z, then aa to zz, by repetition; ``first`` is the code of the first letter. Capitals are repeated as such: putting
    a long label in upper case would read and copy it once more."""
    return F.repeat(F.char(first + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def format_label(style: Column, n: Column) -> Column:
    """Style D, r, R, a, A or none, of a number; nothing below 1."""
    first = F.when(style == "A", 65).otherwise(97)
    label = F.when(style == "D", n.cast("string")).when(style == "r", roman(n)).when(style == "R", F.upper(roman(n))).when(style.isin("a", "A"), letters(n, first))
    return F.when(n < 1, F.lit("")).otherwise(F.coalesce(label, F.lit("")))
