"""Styled spans of a paragraph, and splices of a text."""

from __future__ import annotations

from itertools import pairwise
from re import escape, finditer

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space and delimiters, which end a token by themselves.
ENDS_TOKEN = "\x00\t\n\x0c\r ()<>[]{}/%"


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours of ``spans`` (keys, ord, text, style, inserted, gap, line_break) that share a style, as one span under the
    first one's ord. Inserted and original text stay apart, as do spans with a gap or a forced break. Null styles are equal."""
    order = Window.partitionBy(*keys).orderBy("ord")
    same = F.lit(True)
    for column in ("style", "inserted"):
        same = same & F.lag(column).over(order).eqNullSafe(F.col(column))
    for column in ("gap", "line_break"):
        plain = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) == 0
        same = same & plain & F.lag(plain).over(order)
    begins = F.when(F.row_number().over(order) == 1, True).otherwise(~same)
    marked = spans.withColumn("_part", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))))
    merged = marked.groupBy(*keys, "_part").agg(parts.alias("_parts"), *(F.min_by(c, "ord").alias(c) for c in ("style", "inserted", "gap", "line_break")))
    return merged.select(*keys, F.get("_parts", F.lit(0))["ord"].alias("ord"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"), F.size("_parts").alias("n_spans"), "style", "inserted", "gap", "line_break")


def _spliced(text: str, splices: list[tuple]) -> str | None:
    parts, before = [], 0
    for lo, hi, new in splices:
        if lo < before or hi < lo or hi > len(text):
            return None
        parts += text[before:lo], new
        before = hi
    parts = [p for p in (*parts, text[before:]) if p]
    fuse = (x[-1] not in ENDS_TOKEN and y[0] not in ENDS_TOKEN for x, y in pairwise(parts))
    return "".join(" " + p if f else p for p, f in zip(parts, (False, *fuse), strict=False))


def _all_spliced(texts: pa.Array, splices: pa.Array) -> pa.Array:
    flat = splices.flatten()
    lo, hi, new = (pc.struct_field(flat, name).to_pylist() for name in ("lo", "hi", "new"))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(splices), 0).to_numpy()).tolist()
    out, begin = [], 0
    for text, some, end in zip(texts.to_pylist(), splices.is_valid().to_pylist(), ends, strict=True):
        a, b = lo[begin:end], hi[begin:end]
        whole = text is not None and some and None not in a and None not in b
        out.append(_spliced(text, sorted(zip(a, b, (x or "" for x in new[begin:end]), strict=True))) if whole else None)
        begin = end
    return pa.array(out, pa.string())


def apply_splices(text: Column, splices: Column) -> Column:
    """``text`` with each (lo, hi, new) of ``splices`` replaced; a space goes where two tokens would fuse.

    Null if splices overlap or leave the text. Of abutting splices it is their new texts that are kept apart. A text is cut over
    Arrow batches, where a place is found without counting characters from the text's beginning; Spark doesn't hand expressions
    with lambdas to Python, so ``splices`` must be a column, ``literal_splices`` or another expression without them.
    """
    return F.arrow_udf(_all_spliced, "string")(text, splices)


def literal_splices(text: Column, literal: str, new: str) -> Column:
    """Array of (lo, hi, new) for all hits of a literal that don't overlap, left to right, in words too."""
    size = len(literal)

    def of(texts: pa.Array) -> pa.Array:
        found = [[m.start() for m in finditer(escape(literal), t)] if t is not None else [] for t in texts.to_pylist()]
        lo = np.array([x for one in found for x in one], np.int32)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        splices = pa.StructArray.from_arrays([pa.array(lo), pa.array(lo + np.int32(size)), pa.repeat(pa.scalar(new, pa.string()), len(lo))], ["lo", "hi", "new"])
        return pa.ListArray.from_arrays(pa.array(bounds), splices)

    return F.arrow_udf(of, "array<struct<lo:int,hi:int,new:string>>")(text)
