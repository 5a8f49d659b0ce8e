"""Ordered folds over arrays inside a row: running states, running sums, binary search, runs of neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose outputs are appended one by one: an append copies the array, so long ones are put together from blocks.
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """struct(state, out) of the last state and the outputs. The last output waits beside those before it: ``let`` copies its result
    with all that is in it, so outputs must not pass through it at every element."""
    begin = F.struct(F.struct(start.alias("state"), F.lit(None).cast(kind).alias("out")).alias("last"), F.array().cast(f"array<{kind}>").alias("outs"))

    def further(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["last"]["state"], x).alias("last"), F.array_append(acc["outs"], acc["last"]["out"]).alias("outs"))

    def ended(acc: Column) -> Column:
        outs = F.slice(F.array_append(acc["outs"], acc["last"]["out"]), F.lit(2), F.size(acc["outs"]))  # the first is the start's
        return F.struct(acc["last"]["state"].alias("state"), outs.alias("out"))

    return F.aggregate(values, begin, further, ended)


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """An output (of SQL type ``kind``) for each element: ``step(state, element)`` is a struct (state, out), and gives the
    next element its state, of the type of ``start``."""

    def over(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(v), 1, 0))
        return F.flatten(_fold(blocks, start, lambda state, block: _fold(block, state, step, kind), f"array<{kind}>")["out"])

    return let(values, over)


def running_sums(values: Column, kind: str = "int") -> Column:
    """For each number the sum up to and with it."""
    return scan(values, F.lit(0).cast(kind), lambda s, x: let((s + x).cast(kind), lambda t: F.struct(t.alias("state"), t.alias("out"))), kind)


def bisect(n: Column, below: Callable[[Column], Column]) -> Column:
    """How many of the indexes 0 to n - 1 are ``below``, which must hold for none after one that it doesn't hold for."""
    halvings = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n + 1)).cast("int"), F.lit(1)))

    def halved(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = (acc["lo"] < acc["hi"]) & below(mid)
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(up | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")), halved)["lo"]


def runs_at(values: Column, heads: Column) -> Column:
    """``values`` as an array of arrays, one from each of ``heads`` (ascending indexes, the first 0) to the next."""

    def cut(h: Column) -> Column:
        return F.transform(h, lambda at, i: F.slice(values, at + 1, F.coalesce(F.get(h, i + 1), F.size(values)) - at))

    return let(heads, cut)


def heads_where(values: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """Indexes of elements at which ``begins(element, index)`` holds."""
    marked = F.transform(values, lambda x, i: F.when(begins(x, i), i))
    return F.filter(marked, lambda i: i.isNotNull())
