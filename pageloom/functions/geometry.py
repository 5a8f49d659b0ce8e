"""Rectangles, matrices and colour arithmetic on columns. Top-left origin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.folds import let

Box = tuple[Column, Column, Column, Column]


def intersects(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def contains(outer: Box, inner: Box) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def valid(box: Box) -> Column:
    """Whether a box has a width and a height."""
    return (box[2] > box[0]) & (box[3] > box[1])


def character_range(x: Column, width: Column, n: Column, x0: Column, x1: Column) -> tuple[Column, Column]:
    """[lo, hi) of the characters of a run, all of one width, whose middle lies within x0 and x1."""
    each = width / n
    return F.greatest(F.ceil((x0 - x) / each - 0.5).cast("int"), F.lit(0)), F.least(F.floor((x1 - x) / each - 0.5).cast("int") + 1, n)


def rotation(a: Column, b: Column) -> Column:
    """Clockwise degrees in [0, 360) of a matrix whose first row is (a, b)."""
    return F.pmod(F.degrees(F.atan2(-b, a)), F.lit(360.0))


def blend(mode: str, backdrop: Column, source: Column) -> Column:
    """Separable blend modes on values of 0 to 1."""
    b, s = backdrop, source
    hard = F.when(s <= 0.5, b * 2 * s).otherwise(b + (2 * s - 1) - b * (2 * s - 1))
    return {
        "Normal": s,
        "Multiply": b * s,
        "Screen": b + s - b * s,
        "Darken": F.least(b, s),
        "Lighten": F.greatest(b, s),
        "Difference": F.abs(b - s),
        "Exclusion": b + s - 2 * b * s,
        "HardLight": hard,
        "Overlay": F.when(b <= 0.5, s * 2 * b).otherwise(s + (2 * b - 1) - s * (2 * b - 1)),
        "ColorDodge": F.when(b <= 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(b, 1 - s))),
        "ColorBurn": F.when(b >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), F.try_divide(1 - b, s))),
        "SoftLight": F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b)) - b)),
    }[mode]


MODES = ("Normal", "Multiply", "Screen", "Darken", "Lighten", "Difference", "Exclusion", "HardLight", "Overlay", "ColorDodge", "ColorBurn", "SoftLight")
RGB_MODES = ("Hue", "Saturation", "Color", "Luminosity")


def nearest_whole(x: Column) -> Column:
    """``round(x)`` as a long, halves away from zero. Spark's own goes through decimals, which takes microseconds a value; where a
    double has a fraction it is exact to take the floor off."""
    size = F.abs(x)
    up = F.floor(size) + F.when(size - F.floor(size) >= 0.5, 1).otherwise(0)
    return F.when(size < 2.0**52, F.when(x < 0, -up).otherwise(up)).otherwise(F.round(x).cast("long"))


#: A colour on its way, as named scalars: channels c0 to c2, and what they are brought to.
_State = dict[str, Column]


def _luminosity(c0: Column, c1: Column, c2: Column) -> Column:
    return 0.3 * c0 + 0.59 * c1 + 0.11 * c2


def _begun(mode: str, b: list[Column], s: list[Column]) -> _State:
    """The channels that a mode starts from, whether and how far they are spread, and the luminosity that they get."""
    extent = lambda c: F.greatest(*c) - F.least(*c)
    none = F.lit(None).cast("double")
    base, amount, light = {"Hue": (s, extent(b), b), "Saturation": (b, extent(s), b), "Color": (s, none, b), "Luminosity": (b, none, s)}[mode]
    return {f"c{i}": x for i, x in enumerate(base)} | {"spread": F.lit(mode in ("Hue", "Saturation")), "amount": amount, "light": _luminosity(*light)}


def _channels(x: _State, f) -> _State:
    return {c: f(x[c]) for c in ("c0", "c1", "c2")}


def _bounds(x: _State) -> _State:
    c = [x["c0"], x["c1"], x["c2"]]
    return {"level": _luminosity(*c), "lo": F.least(*c), "hi": F.greatest(*c)}


def _saturated(x: _State) -> _State:
    """Channels spread from 0 to an amount."""
    lo, hi = (f(x["c0"], x["c1"], x["c2"]) for f in (F.least, F.greatest))
    spread = lambda c: F.when(~x["spread"], c).when(hi == lo, 0.0).otherwise(F.try_divide((c - lo) * x["amount"], hi - lo))
    return _channels(x, spread) | {"light": x["light"]}


def _lit(x: _State) -> _State:
    """A colour brought to its luminosity."""
    raise_by = x["light"] - _luminosity(x["c0"], x["c1"], x["c2"])
    return _channels(x, lambda c: c + raise_by)


def _measured(x: _State) -> _State:
    return _channels(x, lambda c: c) | _bounds(x)


def _above_black(x: _State) -> _State:
    """Drawn towards grey until no channel is below 0."""
    level, lo = x["level"], x["lo"]
    return _channels(x, lambda c: F.when((lo < 0) & (level != lo), level + F.try_divide((c - level) * level, level - lo)).otherwise(c)) | {"level": level, "hi": x["hi"]}


def _below_white(x: _State) -> _State:
    """Drawn towards grey until no channel is above 1."""
    level, hi = x["level"], x["hi"]
    return _channels(x, lambda c: F.when((hi > 1) & (hi != level), level + F.try_divide((c - level) * (1 - level), hi - level)).otherwise(c))


_STEPS = (_saturated, _lit, _measured, _above_black, _below_white)


def _struct(x: _State) -> Column:
    return F.struct(*(c.alias(n) for n, c in x.items()))


def _sides(backdrop: Column, source: Column) -> list[list[Column]]:
    return [[F.get(c, F.lit(i)) for i in range(3)] for c in (backdrop, source)]


def blend_rgb(mode: str, backdrop: Column, source: Column) -> Column:
    """The modes that take hue, saturation and luminosity of whole colours (arrays of three) from one side or the other. For
    whole tables see ``blended_rgb``."""
    further = lambda step: lambda v: _struct(step(v))
    value = _struct(_begun(mode, *_sides(backdrop, source)))
    for step in _STEPS:
        value = let(value, further(step))
    return let(value, lambda v: F.array(v["c0"], v["c1"], v["c2"]))


def blended_rgb(rows: DataFrame, backdrop: str, source: str, keys: list[str]) -> DataFrame:
    """(keys, mode, c0, c1, c2): ``blend_rgb`` of two columns under all its modes. Every step is a projection of scalars, so Spark
    compiles it; inside a lambda it would be interpreted. A mode has its own scan: all four in one loop over the rows are a method
    too long for the JVM to compile."""
    sides = [[f"_{n}{i}" for i in range(3)] for n in "bs"]
    flat = rows.select(*keys, *(c.alias(n) for cs, ns in zip(_sides(F.col(backdrop), F.col(source)), sides) for c, n in zip(cs, ns)))

    def under(mode: str) -> DataFrame:
        mixed, state = flat, _begun(mode, *([F.col(n) for n in ns] for ns in sides))
        for step in (lambda x: x, *_STEPS):
            mixed = mixed.select(*keys, *(c.alias(n) for n, c in step(state).items()))
            state = {n: F.col(n) for n in mixed.columns}
        return mixed.select(*keys, F.lit(mode).alias("mode"), "c0", "c1", "c2")

    return reduce(DataFrame.unionAll, map(under, RGB_MODES))
