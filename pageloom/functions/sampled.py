"""Functions of numbers as columns: exponential, sampled and stitched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.folds import bisect, let


def normalized(t: Column, lo: Column, hi: Column) -> Column:
    """A value of a domain on 0 to 1, cut to it; an empty domain gives 0."""
    return F.when(hi == lo, 0.0).otherwise(F.least(F.greatest(F.try_divide(t - lo, hi - lo), F.lit(0.0)), F.lit(1.0)))


def exponential(t: Column, c0: Column, c1: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Array of c0 + x^n (c1 - c0), x being ``t`` on its domain; as long as the shorter of both. A power of 0 or null is 1."""
    power = F.when(F.coalesce(n, F.lit(0.0)) == 0, 1.0).otherwise(n)
    some = F.least(F.size(c0), F.size(c1))
    return let(F.pow(normalized(t, lo, hi), power), lambda x: F.zip_with(F.slice(c0, 1, some), F.slice(c1, 1, some), lambda a, b: a + x * (b - a)))


def unpacked(data: Column, bits: Column, n: Column) -> Column:
    """The first ``n`` samples of ``bits`` bits (1 to 32) each, on 0 to 1, that bytes hold end to end without regard for byte
    edges, highest bit first; null if there are fewer."""
    byte = lambda i: F.conv(F.substring(F.hex(data), 2 * i + 1, 2), 16, 10).cast("long")
    whole = F.transform(F.sequence(F.lit(0), F.length(data) - 1), byte)

    def read(bytes_: Column) -> Column:
        def sample(k: Column) -> Column:
            first, last = F.floor(k * bits / 8).cast("int"), F.floor(((k + 1) * bits - 1) / 8).cast("int")
            word = F.aggregate(F.slice(bytes_, first + 1, last - first + 1), F.lit(0).cast("long"), lambda acc, b: acc * 256 + b)
            spare = (F.lit(8) * (last + 1) - (k + 1) * bits).cast("int")
            return F.pmod(F.floor(word / F.pow(F.lit(2.0), spare)), F.pow(F.lit(2.0), bits)) / (F.pow(F.lit(2.0), bits) - 1)

        return F.transform(F.sequence(F.lit(0), n - 1), sample)

    enough = (bits > 0) & (n > 0) & (F.length(data) * 8 >= bits * n)
    return F.when(enough, let(F.when(enough, whole), read))


def interpolated(at: Column, sizes: Column, samples: Column, outputs: Column, lo: Column, hi: Column) -> Column:
    """Array of ``outputs`` values at ``at`` (an array of numbers on 0 to 1, one a dimension) on a grid of ``sizes``, whose first
    dimension varies fastest and whose ``samples`` are 0 to 1: all corners of the cell, weighted. Decoded to ``lo`` and ``hi``."""
    places = F.zip_with(at, sizes, lambda t, n: let(t * (n - 1), lambda p: let(F.least(F.greatest(F.floor(p).cast("int"), F.lit(0)), n - 1), lambda i: F.struct(i.alias("i"), F.least(i + 1, n - 1).alias("j"), (p - i).alias("f"), n.alias("n")))))
    corners = F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.size(sizes)) - 1).cast("int"))

    def mixed(cells: Column) -> Column:
        def corner(k: Column) -> Column:
            start = F.struct(F.lit(0).alias("index"), F.lit(1).alias("stride"), F.lit(1.0).alias("weight"), F.lit(1).alias("bit"))

            def along(acc: Column, c: Column) -> Column:
                upper = F.floor(k / acc["bit"]) % 2 == 1
                return F.struct(
                    (acc["index"] + acc["stride"] * F.when(upper, c["j"]).otherwise(c["i"])).alias("index"), (acc["stride"] * c["n"]).alias("stride"),
                    (acc["weight"] * F.when(upper, c["f"]).otherwise(1 - c["f"])).alias("weight"), (acc["bit"] * 2).alias("bit"),
                )

            return F.aggregate(cells, start, along)

        def output(points: Column, o: Column) -> Column:
            value = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + F.when(p["weight"] == 0, 0.0).otherwise(p["weight"] * F.get(samples, p["index"] * outputs + o)))
            return F.get(lo, o) + value * (F.get(hi, o) - F.get(lo, o))

        return let(F.transform(corners, corner), lambda points: F.transform(F.sequence(F.lit(0), outputs - 1), lambda o: output(points, o)))

    return let(places, mixed)


def stitched(t: Column, bounds: Column, encode: Column, n: Column, lo: Column, hi: Column) -> Column:
    """struct(piece, x): which of ``n`` functions laid end to end over a domain answers for ``t``, and its argument. Pieces begin
    at ``bounds``; ``encode`` holds two numbers a piece, 0 and 1 where it is short."""

    def placed(v: Column) -> Column:
        piece = F.least(bisect(F.size(bounds), lambda i: F.get(bounds, i) <= v), n - 1)

        def argument(i: Column) -> Column:
            begin, end = F.when(i > 0, F.get(bounds, i - 1)).otherwise(lo), F.coalesce(F.get(bounds, i), hi)
            coded = F.size(encode) >= 2 * i + 2
            e0, e1 = F.when(coded, F.get(encode, 2 * i)).otherwise(0.0), F.when(coded, F.get(encode, 2 * i + 1)).otherwise(1.0)
            return F.struct(i.alias("piece"), F.when(end == begin, e0).otherwise(e0 + F.try_divide(v - begin, end - begin) * (e1 - e0)).alias("x"))

        return let(piece, argument)

    return let(F.greatest(F.least(t, hi), lo), placed)
