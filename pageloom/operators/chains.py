"""Runs to chains, lines and paragraphs, inside the row of their page: arrays in, arrays out, no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.folds import bisect, heads_where, let, runs_at, scan
from pageloom.functions.text import HYPHENS, WORD_GAP
from pageloom.sources.tables import page_rows

#: Fixed values, in sizes of type: how far off the baseline, back and ahead of its end a chain goes on; how far down a broken word does.
OFF_BASELINE, BACK, AHEAD, DOWN = 0.3, 0.5, 2.5, 2.5
#: How far baselines of one line, left edges and steps of one paragraph may differ; the least step.
SAME_LINE, SAME_EDGE, SAME_STEP, SAME_SIZE, LEAST_STEP = 0.5, 0.5, 0.5, 0.01, 0.1

CHAINED = "struct<ln:int,wn:int,text:string,sep:string,chain:bigint,lo:int,hi:int,cut:int,joined:boolean,begins:boolean>"
_WORD, _HYPHEN, _WHITE = r"[\p{L}\p{Nd}]", f"[{HYPHENS}]", r"[ \t\n\x0b\f\r\x{a0}]"


def chained(runs: Column) -> Column:
    """An array of CHAINED for an array of runs (ln, wn, text, x, y, width, size, space_w) of one page, in drawing order.

    A chain ends where the next run is off the baseline, goes back or is far ahead; else a gap may read as a space (sep). Where
    it would end, but its text ends in a letter or digit and a hyphen, and the run begins with one and lies lower by DOWN at
    most, the word goes on: the hyphen leaves the chain's text. The run that gave it up has cut 1, the one that goes on is
    joined. lo and hi are places in the chain's text of what is left of a run; chains are numbered from 1. Runs without text
    are no part of a chain; of a size that isn't known, the next run's counts, and without either the chain ends.
    """
    return F.arrow_udf(_chained, f"array<{CHAINED}>")(runs)


def _told(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where pages end among the runs of a batch, where chains begin, and the runs as CHAINED. A run asks only the one before it, and a
    hyphen of its own the letter before that, so all are asked at once."""
    flat = runs.flatten()
    columns = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    some = pc.fill_null(pc.not_equal(columns["text"], ""), False)
    page = pc.list_parent_indices(runs).filter(some).to_numpy()
    columns = {name: c.filter(some) for name, c in columns.items()}
    text, number = columns["text"], {c: columns[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y", "width", "size", "space_w")}
    first = np.ones(len(page), bool)
    first[1:] = page[1:] != page[:-1]

    def before(values: np.ndarray) -> np.ndarray:
        """Those of the run before, on its page."""
        out = np.roll(values, 1)
        out[first] = np.nan if values.dtype == np.float64 else False
        return out

    like = lambda pattern: pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):  # what isn't known is not a number, and no comparison holds
        size = np.where(before(number["size"]) > 0, before(number["size"]), number["size"])
        gap, down = number["x"] - before(number["x"] + number["width"]), number["y"] - before(number["y"])
        near = (size > 0) & (np.abs(down) <= OFF_BASELINE * size) & (gap >= -BACK * size) & (gap <= AHEAD * size)
        space = np.where(before(number["space_w"]) <= 0, 1.0, before(number["space_w"]))
        apart = near & (gap > WORD_GAP * space) & ~before(like(rf"{_WHITE}\z")) & ~like(rf"\A{_WHITE}")
        hyphen = like(rf"{_WORD}{_HYPHEN}\z") | (like(rf"\A{_HYPHEN}\z") & near & ~apart & before(like(rf"{_WORD}\z")))
        joined = ~near & (down > 0) & (down <= DOWN * size) & before(hyphen) & like(rf"\A{_WORD}")
    begins = ~near & ~joined
    length, index = pc.utf8_length(text).to_numpy().astype(np.int64), np.arange(len(page))
    end = np.cumsum(apart + length - joined)
    head = np.maximum.accumulate(np.where(begins, index, 0))
    hi = end - (end - length)[head]
    chain = np.cumsum(begins)
    chain = chain - chain[np.maximum.accumulate(np.where(first, index, 0))] + 1
    cut = np.append(joined[1:], False)[: len(page)]
    out = {
        "ln": columns["ln"].cast(pa.int32()), "wn": columns["wn"].cast(pa.int32()), "text": pc.if_else(cut, pc.utf8_slice_codeunits(text, 0, -1), text), "sep": pc.if_else(apart, " ", ""),
        "chain": chain, "lo": (hi - length).astype(np.int32), "hi": (hi - cut).astype(np.int32), "cut": cut.astype(np.int32), "joined": joined, "begins": begins,
    }
    ends = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=len(runs)))]).astype(np.int32)
    return ends, np.flatnonzero(begins), pa.StructArray.from_arrays([pa.array(c) for c in out.values()], list(out))


def _chained(runs: pa.Array) -> pa.Array:
    ends, _, out = _told(runs)
    return pa.ListArray.from_arrays(ends, out, mask=runs.is_null() if runs.null_count else None)


def _cut_to_chains(runs: pa.Array) -> pa.Array:
    ends, heads, out = _told(runs)
    each = pa.ListArray.from_arrays(np.append(heads, len(out)).astype(np.int32), out)
    return pa.ListArray.from_arrays(np.searchsorted(heads, ends).astype(np.int32), each)


def chains(pages: DataFrame) -> DataFrame:
    """(doc_id, page, chain, runs) of ``pages`` (doc_id, page, runs): a row for each chain, its runs as CHAINED."""
    each = F.arrow_udf(_cut_to_chains, f"array<array<{CHAINED}>>")(F.col("runs"))
    found = pages.select("doc_id", "page", each.alias("runs")).select("doc_id", "page", F.explode("runs").alias("runs"))
    return found.select("doc_id", "page", F.get("runs", F.lit(0))["chain"].alias("chain"), "runs")


def _joined(heads: np.ndarray, each: pa.Array) -> pa.Array:
    """Strings put together, from each of ``heads`` to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(np.append(heads, len(each)).astype(np.int32), each), "")


def _page_of(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, at, side="right") - 1


def _texts(heads: np.ndarray, out: pa.StructArray) -> pa.Array:
    return _joined(heads, pc.binary_join_element_wise(out.field("sep"), out.field("text"), ""))


def _chain_rows(runs: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    ends, heads, out = _told(runs)
    joins = np.concatenate(([0], np.cumsum(out.field("joined").to_numpy(zero_copy_only=False))))
    n_joined = joins[np.append(heads, len(out))[1:]] - joins[heads]
    return _page_of(ends, heads), [out.field("chain").take(pa.array(heads)), _texts(heads, out), pa.array(n_joined.astype(np.int64))]


def chain_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, page, chain, text, n_joined): the chains of texts (doc_id, text) laid out on pages, and how many of their runs go on with
    a broken word."""
    return page_rows(docs, _chain_rows, "chain bigint, text string, n_joined bigint")


def _places(text: str, literal: str) -> list[int]:
    """Where the hits of a literal begin, left to right, none over another."""
    out, at = [], text.find(literal)
    while at >= 0:
        out.append(at)
        at = text.find(literal, at + len(literal))
    return out


def _hit_rows(literal: str):
    """As ``chain_ranges`` for all chains at once: their texts are one axis, on which runs are in order."""

    def of(runs: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        ends, heads, out = _told(runs)
        text = _texts(heads, out)
        hit = np.flatnonzero(pc.match_substring(text, literal).to_numpy(zero_copy_only=False))
        met = [_places(t, literal) for t in text.take(pa.array(hit)).to_pylist()]
        base = np.concatenate(([0], np.cumsum(pc.utf8_length(text).to_numpy()))).astype(np.int64)
        own = base[np.searchsorted(heads, np.arange(len(out)), side="right") - 1]
        begin, end, cut = own + out.field("lo").to_numpy(), own + out.field("hi").to_numpy(), out.field("cut").to_numpy()
        low = np.array([x for one in met for x in one], np.int64) + np.repeat(base[hit], [len(x) for x in met])
        high = low + len(literal)
        first, last = np.searchsorted(end, low, side="right"), np.searchsorted(begin, high)
        n = np.maximum(last - first, 0)
        which = np.repeat(np.arange(len(low)), n)
        run = first[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
        to = np.minimum(high[which], end[run])
        lo, hi = np.maximum(low[which], begin[run]) - begin[run], to - begin[run] + np.where(to == end[run], cut[run], 0)
        some = lo < hi
        run = run[some]
        at = pa.array(run)
        return _page_of(ends, run), [out.field("ln").take(at), out.field("wn").take(at), pa.array(lo[some].astype(np.int32)), pa.array(hi[some].astype(np.int32))]

    return of


def chain_hits(docs: DataFrame, literal: str) -> DataFrame:
    """(doc_id, page, ln, wn, lo, hi): what each hit of ``literal`` in a chain of texts (doc_id, text) laid out on pages covers of its runs,
    as ``chain_ranges`` has it."""
    return page_rows(docs, _hit_rows(literal), "ln int, wn int, lo int, hi int")


def chain_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(r["sep"], r["text"])), "")


def chain_ranges(runs: Column, lo: Column, hi: Column) -> Column:
    """Array of (ln, wn, lo, hi): what [lo, hi) of a chain's text covers of its runs, in their own characters, found by binary
    search. Spaces between runs aren't theirs; a hyphen that left the text goes with the character before it."""
    first = bisect(F.size(runs), lambda i: F.get(runs, i)["hi"] <= lo)
    last = bisect(F.size(runs), lambda i: F.get(runs, i)["lo"] < hi)

    def own(r: Column) -> Column:
        to = F.least(hi, r["hi"])
        return F.struct(r["ln"].alias("ln"), r["wn"].alias("wn"), (F.greatest(lo, r["lo"]) - r["lo"]).alias("lo"), (to - r["lo"] + F.when(to == r["hi"], r["cut"]).otherwise(0)).alias("hi"))

    met = F.transform(F.slice(runs, first + 1, F.greatest(last - first, F.lit(0))), own)
    return F.filter(met, lambda m: m["lo"] < m["hi"])


def page_text(runs: Column) -> Column:
    """A page's text as drawn: a new line where the line changes, a space where the gap calls for one; hyphens stay."""
    drawn = F.filter(runs, lambda r: r["text"] != "")
    sep = lambda a: lambda c, i: F.when((i > 0) & (F.get(a, i - 1)["ln"] != c["ln"]), F.lit("\n")).otherwise(c["sep"])
    return let(chained(runs), lambda a: F.array_join(F.zip_with(F.transform(a, sep(a)), F.transform(drawn, lambda r: r["text"]), lambda x, y: F.concat(x, y)), ""))


def _page_texts(runs: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    ends, _, out = _told(runs)
    drawn, ln = runs.flatten().field("text"), out.field("ln").to_numpy()
    drawn = drawn.filter(pc.fill_null(pc.not_equal(drawn, ""), False))
    heads, some = np.unique(ends[:-1][np.diff(ends) > 0]), np.flatnonzero(np.diff(ends) > 0)
    new = np.append(False, ln[1:] != ln[:-1])[: len(ln)]
    new[heads] = False
    sep = pc.if_else(pa.array(new), "\n", out.field("sep"))
    return some, [_joined(heads, pc.binary_join_element_wise(sep, drawn, ""))]


def page_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text): ``page_text`` of each page with runs of texts (doc_id, text) laid out on pages."""
    return page_rows(docs, _page_texts, "text string")


def line_numbers(runs: Column) -> Column:
    """The line of each of an array of runs (y, ...): a line goes on while the step from its FIRST run is below SAME_LINE."""
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("y"))

    def step(s: Column, r: Column) -> Column:
        new = s["y"].isNull() | (F.abs(r["y"] - s["y"]) >= SAME_LINE)
        line = s["line"] + new.cast("int")
        return F.struct(F.struct(line.alias("line"), F.when(new, r["y"]).otherwise(s["y"]).alias("y")).alias("state"), line.alias("out"))

    return scan(runs, start, step, "int")


def grouped_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, ln, wn, line, place): each run of ``pages`` with its line, and its place from left to right in it."""
    lined = lambda runs: let(line_numbers(runs), lambda n: F.transform(runs, lambda r, i: F.struct(F.get(n, i).alias("line"), r["x"].alias("x"), i.alias("i"), r["ln"].alias("ln"), r["wn"].alias("wn"))))
    # Lines are numbered in order, so sorting by (line, x, order of drawing) sorts each line from left to right.
    ordered = lambda a: let(F.array_sort(a), lambda o: let(heads_where(o, lambda r, i: (i == 0) | (F.get(o, i - 1)["line"] != r["line"])), lambda heads: F.transform(o, lambda r, i: F.struct(r["ln"].alias("ln"), r["wn"].alias("wn"), r["line"].alias("line"), (i - F.get(heads, r["line"])).alias("place")))))
    return pages.select("doc_id", "page", F.inline(let(lined(F.col("runs")), ordered)))


def paragraph_numbers(lines: Column) -> Column:
    """The paragraph of each of an array of lines (x, y, size): one goes on at the same left edge and size as its first line, at
    a step of LEAST_STEP to 2.5 sizes, and, from the third line on, at the step it has had (within SAME_STEP of the last one)."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(-1).alias("para"), none.alias("x"), none.alias("size"), none.alias("y"), none.alias("leading"))

    def step(s: Column, r: Column) -> Column:
        gap = r["y"] - s["y"]
        same = (F.abs(r["x"] - s["x"]) <= SAME_EDGE) & (s["size"] > 0) & (F.abs(r["size"] - s["size"]) <= SAME_SIZE)
        goes_on = F.coalesce(same & (gap > LEAST_STEP) & (gap <= DOWN * s["size"]) & (s["leading"].isNull() | (F.abs(gap - s["leading"]) <= SAME_STEP)), F.lit(False))
        para = s["para"] + (~goes_on).cast("int")
        first = lambda c: F.when(goes_on, s[c]).otherwise(r[c]).alias(c)
        state = F.struct(para.alias("para"), first("x"), first("size"), r["y"].alias("y"), F.when(goes_on, gap).alias("leading"))
        return F.struct(state.alias("state"), para.alias("out"))

    return scan(lines, start, step, "int")


def wrapped(words: Column, width: int) -> Column:
    """Lines of at most ``width`` characters from an array of words, longer words alone: where lines begin, then slices."""
    start = F.lit(-1)

    def step(used: Column, w: Column) -> Column:
        fits = (used >= 0) & (used + 1 + F.length(w) <= width)
        return F.struct(F.when(fits, used + 1 + F.length(w)).otherwise(F.length(w)).alias("state"), (~fits).alias("out"))

    heads = lambda new: F.filter(F.transform(new, lambda n, i: F.when(n, i)), lambda i: i.isNotNull())
    return let(words, lambda v: F.transform(runs_at(v, heads(scan(v, start, step, "boolean"))), lambda line: F.array_join(line, " ")))
