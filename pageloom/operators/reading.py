"""The joined reading of a paragraph of styled spans, the way back from it, and replacement that keeps styles.

A paragraph is an array of spans inside its row. Its reading is its text in which words that a hyphen breaks over lines are
whole: the hyphen and the break are left out. Segments (at, lo, hi) say which stretch of the flat text stands at which place
of the reading; they are sorted both ways, so a place is found in either by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.folds import bisect, let
from pageloom.functions.text import HYPHENS, anywhere_spans, bounded_spans

#: A word and the hyphen that breaks it; how a word goes on.
_BROKEN, _GOES_ON = rf"[\p{{L}}\p{{Nd}}][{HYPHENS}]\z", r"^[\p{L}\p{Nd}]"
#: A reading as a struct.
READING = "struct<flat:string,starts:array<int>,segments:array<struct<at:int,lo:int,hi:int>>,text:string>"
#: Spans that are put together again: the one whose style they have, and what they hold.
REPLACED = "struct<hits:int,spans:array<struct<span:int,text:string,inserted:boolean,line_break:boolean>>>"
#: Spans that are replaced in at a time, those of a longer paragraph alone.
SPANS = 1 << 17


def _text(span: Column) -> Column:
    return F.coalesce(span["text"], F.lit(""))


def _read(texts: pa.Array, breaks: pa.Array) -> pa.Array:
    """Readings of some paragraphs, all spans at once: a break asks the last text before it and the next one, nothing else."""
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
    first = np.cumsum(sizes) - sizes
    own = pc.if_else(pc.is_null(texts.flatten()), "", texts.flatten())  # a copy: its bytes are without gaps
    at = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int32)
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[: at[-1]] if len(own) else np.zeros(0, np.uint8)
    ends = np.concatenate(([0], np.cumsum(pc.utf8_length(own).to_numpy())))  # in characters, over all paragraphs
    begins = np.concatenate((first, [len(own)]))  # where a paragraph's spans begin
    owner = np.repeat(np.arange(len(sizes)), sizes)

    # The last span with text before each one, and the next after it.
    index, some = np.arange(len(own)), np.diff(at) > 0
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(some, index, -1))))[: len(own)]
    after = np.append(np.minimum.accumulate(np.where(some, index, len(own))[::-1])[::-1], len(own))[1:]
    asked = np.flatnonzero(pc.fill_null(breaks.flatten(), False).to_numpy(zero_copy_only=False))
    asked = asked[(before[asked] >= begins[owner[asked]]) & (after[asked] < begins[owner[asked] + 1])]
    broken = pc.match_substring_regex(own.take(pa.array(before[asked])), _BROKEN).to_numpy(zero_copy_only=False)
    goes_on = pc.match_substring_regex(own.take(pa.array(after[asked])), _GOES_ON).to_numpy(zero_copy_only=False)
    joins = asked[broken & goes_on]
    # Breaks without text between the same two texts join them once.
    joins = joins[np.concatenate(([True], ends[joins[1:] + 1] > ends[joins[:-1] + 1]))[: len(joins)]]

    # The hyphen of one to three bytes goes with its break.
    last = data[at[joins] - 1]
    hyphen = np.where(last < 0x80, 1, np.where(data[at[joins] - 2] == 0xC2, 2, 3))
    edges = np.zeros(len(data) + 1, np.int8)
    np.add.at(edges, at[joins] - hyphen, 1)  # a break that has letters of its own may begin where another does
    np.add.at(edges, at[joins + 1], -1)
    kept = np.cumsum(edges[:-1], dtype=np.int8) == 0
    read = np.concatenate(([0], np.cumsum(kept)))[at[begins]].astype(np.int32)

    # Each paragraph has one segment more than it has joins, some of them empty.
    page, base, total = owner[joins], ends[begins], len(sizes) + len(joins)
    lo, hi = np.zeros(total, np.int64), np.zeros(total, np.int64)
    nth = np.arange(len(joins)) + page
    hi[nth], lo[nth + 1] = ends[joins] - 1 - base[page], ends[joins + 1] - base[page]
    n_joins = np.bincount(page, minlength=len(sizes))
    hi[np.cumsum(n_joins + 1) - 1] = np.diff(base)
    page = np.repeat(np.arange(len(sizes)), n_joins + 1)
    full = lo < hi
    lo, hi, page = lo[full], hi[full], page[full]
    place = np.concatenate(([0], np.cumsum(hi - lo)))
    bounds = np.searchsorted(page, np.arange(len(sizes) + 1))
    segments = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (place[:-1] - place[bounds[page]], lo, hi)], ["at", "lo", "hi"])

    string = lambda to, held: pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.ascontiguousarray(to)), pa.py_buffer(np.ascontiguousarray(held)))
    starts = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array((ends[:-1] - base[owner]).astype(np.int32)))
    columns = {"flat": string(at[begins], data), "starts": starts, "segments": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), segments), "text": string(read, data[kept])}
    return pa.StructArray.from_arrays(list(columns.values()), list(columns), mask=pc.is_null(texts))


def joined_reading(spans: Column) -> Column:
    """struct(flat, starts, segments, text) of an array of spans (text, line_break, ...); null of null.

    A break joins if the last span with text before it ends in a letter or digit and a hyphen, and the next one with text begins
    with a letter or digit. A hyphen inside a line stays, as does one that is a span of its own.
    """
    return F.arrow_udf(_read, READING)(spans["text"], spans["line_break"])


def to_flat(segments: Column, place: Column) -> Column:
    """The place in the flat text of a character of the reading."""
    segment = F.get(segments, bisect(F.size(segments), lambda i: F.get(segments, i)["at"] <= place) - 1)
    return segment["lo"] + place - segment["at"]


def to_reading(segments: Column, place: Column) -> Column:
    """The place in the reading of a character of the flat text; of one that was left out, that of the next one read."""
    i = bisect(F.size(segments), lambda k: F.get(segments, k)["lo"] <= place) - 1
    segment = F.get(segments, i)
    return F.when(i < 0, 0).otherwise(segment["at"] + F.least(place, segment["hi"]) - segment["lo"])


def reading_hits(reading: Column, literal: str | Column, bounded: bool = True) -> Column:
    """Array of (lo, hi) in the flat text of the literal's hits in a reading: a broken word's hyphen and break are inside."""
    found = (bounded_spans if bounded else anywhere_spans)(reading["text"], literal)
    back = lambda s: F.struct(to_flat(reading["segments"], s["lo"]).alias("lo"), (to_flat(reading["segments"], s["hi"] - 1) + 1).alias("hi"))
    return F.transform(found, back)


def span_pieces(starts: Column, lo: Column, hi: Column) -> Column:
    """Array of (span, lo, hi): what [lo, hi) of the flat text covers of each span, in its own characters."""
    first = bisect(F.size(starts), lambda i: F.get(starts, i) <= lo) - 1
    last = bisect(F.size(starts), lambda i: F.get(starts, i) < hi) - 1
    end = lambda i: F.least(hi, F.coalesce(F.get(starts, i + 1), hi))
    each = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.struct(i.alias("span"), (F.greatest(lo, F.get(starts, i)) - F.get(starts, i)).alias("lo"), (end(i) - F.get(starts, i)).alias("hi")))
    return F.filter(each, lambda p: p["lo"] < p["hi"])


def _word(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


def _found(text: str, literal: str | None, bounded: bool) -> list[int]:
    """Where the hits of a literal begin, as ``reading_hits`` has them: one that is turned down still uses up its text."""
    if not literal:
        return []
    out, at, n = [], text.find(literal), len(literal)
    while at >= 0:
        if not bounded or not (at and _word(text[at - 1]) or _word(text[at + n : at + n + 1])):
            out.append(at)
        at = text.find(literal, at + n)
    return out


def _placed(r: pa.StructArray, literals: list[str | None], bounded: bool) -> tuple[np.ndarray, ...]:
    """Hits in some readings, a literal for each: places of all paragraphs are one axis, on which segments and spans are in order. Where
    paragraphs and their spans begin on it, each hit's paragraph, and where the hits begin and end."""
    flat, starts, segments, text = (pc.fill_null(x, "") if pa.types.is_string(x.type) else x for x in (r.field(i) for i in range(4)))
    base, read = (np.concatenate(([0], np.cumsum(pc.utf8_length(x).to_numpy()))).astype(np.int64) for x in (flat, text))
    met = [_found(t, literal, bounded) for t, literal in zip(text.to_pylist(), literals, strict=True)]
    n = [len(x) for x in met]
    page = np.repeat(np.arange(len(met)), n)
    place = np.array([x for one in met for x in one], np.int64) + read[page]
    begins, at = (base[:-1].repeat(pc.list_value_length(starts).to_numpy()) + starts.flatten().to_numpy(), read[:-1].repeat(pc.list_value_length(segments).to_numpy()))
    at, lo = at + segments.flatten().field("at").to_numpy(), segments.flatten().field("lo").to_numpy()

    def back(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(at, x, side="right") - 1
        return base[page] + lo[k] + x - at[k]

    size = np.repeat([len(x or "") for x in literals], n).astype(np.int64)
    return base, begins, page, back(place), back(place + size - 1) + 1


def _ranges(literal: str, bounded: bool):
    def of(texts: pa.Array, breaks: pa.Array) -> pa.Array:
        r = _read(texts, breaks)
        base, begins, page, low, high = _placed(r, [literal] * len(r), bounded)
        starts = r.field(1)
        first, last = np.searchsorted(begins, low, side="right") - 1, np.searchsorted(begins, high) - 1
        n = last - first + 1
        hit = np.repeat(np.arange(len(low)), n)
        span = first[hit] + np.arange(len(hit)) - (np.cumsum(n) - n)[hit]
        here = begins[span]
        cut_lo, cut_hi = np.maximum(low[hit], here) - here, np.minimum(high[hit], np.append(begins, base[-1])[span + 1]) - here
        some = cut_lo < cut_hi
        hit, span, cut_lo, cut_hi = hit[some], span[some], cut_lo[some], cut_hi[some]
        own = page[hit]
        bounds = np.searchsorted(own, np.arange(len(r) + 1)).astype(np.int32)
        columns = {"hit": low[hit] - base[own], "span": span - starts.offsets.to_numpy()[own], "lo": cut_lo, "hi": cut_hi}
        return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in columns.values()], list(columns)))

    return of


def hit_ranges(spans: Column, literal: str, bounded: bool = True) -> Column:
    """Array of (hit, span, lo, hi): where each hit of ``reading_hits`` begins in the flat text, and its ``span_pieces``."""
    return F.arrow_udf(_ranges(literal, bounded), "array<struct<hit:int,span:int,lo:int,hi:int>>")(spans["text"], spans["line_break"])


def _codes(styles: pa.Array) -> np.ndarray:
    """A number for each style, equal ones alike and null ones too."""
    if pa.types.is_nested(styles.type):
        styles = pa.array([None if x is None else repr(x) for x in styles.to_pylist()], pa.string())
    return pc.fill_null(styles.dictionary_encode().indices, -1).to_numpy()


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where strings begin in their bytes, and the bytes."""
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(strings).to_numpy()))).astype(np.int64)
    return ends, np.frombuffer("".join(strings.to_pylist()).encode(), np.uint8)


def _rewritten(texts: pa.Array, styles: pa.Array, r: pa.StructArray, tokens: pa.Array, inserted: pa.Array, breaks: pa.Array, placed: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """Of paragraphs with hits the spans as they are afterwards: how many there are up to each paragraph, and their columns. What stays is the
    flat text between the edges of spans and hits, and neighbours of one style become one."""
    base, begins, page, low, high = placed
    n_hits = np.bincount(page, minlength=len(r))
    edges = np.unique(np.concatenate((begins[np.repeat(n_hits > 0, pc.list_value_length(texts).fill_null(0).to_numpy())], low, high, base[1:][n_hits > 0])))
    begin, end = edges[:-1], edges[1:]
    stays = (np.searchsorted(low, begin, side="right") == np.searchsorted(high, begin, side="right")) & (n_hits[np.searchsorted(base, begin, side="right") - 1] > 0)
    begin, end = begin[stays], end[stays]

    flat, data = _bytes(pc.fill_null(r.field("flat"), ""))
    token_at, token_data = _bytes(pc.fill_null(tokens, ""))
    letter = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character begins
    put = token_at[page + 1] > token_at[page]
    page_put, low_put = page[put], low[put]
    # What stays, and what is put in: where it is, and which bytes it has.
    at = np.concatenate((begin, low_put))
    order = np.argsort(at)
    from_byte = np.concatenate((letter[begin], len(data) + token_at[page_put]))[order]
    size = np.concatenate((letter[end] - letter[begin], token_at[page_put + 1] - token_at[page_put]))[order]
    new = (np.arange(len(at)) >= len(begin))[order]
    at, until = at[order], np.concatenate((end, low_put))[order]
    span, own = np.searchsorted(begins, at, side="right") - 1, np.searchsorted(base, at, side="right") - 1
    flag = lambda x: pc.fill_null(x.flatten(), False).to_numpy(zero_copy_only=False)[span]
    put_in = new | flag(inserted)
    breaks_here = ~new & flag(breaks) & (at == base[own]) & (until == np.append(begins, base[-1])[span + 1])
    code = _codes(styles.flatten())[span]
    apart = np.ones(len(at), bool)
    apart[1:] = (own[1:] != own[:-1]) | (code[1:] != code[:-1]) | (put_in[1:] != put_in[:-1]) | breaks_here[1:] | breaks_here[:-1]
    heads = np.flatnonzero(apart)
    held = np.concatenate((data, token_data))[np.repeat(from_byte - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    ends = np.concatenate((np.cumsum(size) - size, [size.sum()]))[np.append(heads, len(at))].astype(np.int32)
    text = pa.StringArray.from_buffers(len(heads), pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(held)))
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(texts).fill_null(0).to_numpy())))
    nth = span[heads] - first[own[heads]]
    return np.searchsorted(own[heads], np.arange(len(r) + 1)), [pa.array(nth.astype(np.int32)), text, pa.array(put_in[heads]), pa.array(breaks_here[heads])]


def _replaced(bounded: bool):
    names = ["span", "text", "inserted", "line_break"]

    def part(texts: pa.Array, breaks: pa.Array, styles: pa.Array, inserted: pa.Array, literals: pa.Array, tokens: pa.Array) -> pa.Array:
        r = _read(texts, breaks)
        placed = _placed(r, literals.to_pylist(), bounded)
        ends, columns = _rewritten(texts, styles, r, tokens, inserted, breaks, placed)
        spans = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(columns, names))
        hits = pa.array(np.bincount(placed[2], minlength=len(r)).astype(np.int32))
        return pa.StructArray.from_arrays([hits, spans], ["hits", "spans"])

    def of(texts: pa.Array, breaks: pa.Array, styles: pa.Array, inserted: pa.Array, literals: pa.Array, tokens: pa.Array) -> pa.Array:
        sizes, lo, out = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy()), 0, []
        while lo < len(texts):
            hi = max(int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SPANS, side="right")), lo + 1)
            # Copies, as lists that are a part of others have their places.
            out.append(part(*(pa.concat_arrays([x.slice(lo, hi - lo)]).take(pa.array(np.arange(hi - lo))) for x in (texts, breaks, styles, inserted, literals, tokens))))
            lo = hi
        return pa.concat_arrays(out) if out else part(texts, breaks, styles, inserted, literals, tokens)

    return of


def replace_in_spans(spans: Column, literal: str | Column, token: str | Column, bounded: bool = True) -> Column:
    """struct(spans, hits): an array of spans (text, style, inserted, line_break, gap) with each hit of the literal in its joined
    reading replaced, and how many there were.

    What stays keeps its style; what is put in takes that of the first character it replaces, and is marked inserted. A hit over
    several spans is replaced whole, with the hyphen and the break of a broken word. Without hits spans stay as they are. With
    hits, spans of one style merge, gaps close, and a break keeps its mark only where it is the first span: paragraphs are
    wrapped anew after a replacement.
    """
    each = [c if isinstance(c, Column) else F.lit(c) for c in (literal, token)]
    told = F.arrow_udf(_replaced(bounded), REPLACED)(spans["text"], spans["line_break"], spans["style"], spans["inserted"], *each)
    none = F.lit(0.0).alias("gap")

    def put_together(k: Column) -> Column:
        new = F.transform(k["told"]["spans"], lambda s: F.struct(s["text"].alias("text"), F.get(k["spans"], s["span"])["style"].alias("style"), s["inserted"].alias("inserted"), s["line_break"].alias("line_break"), none))
        kept = F.transform(k["spans"], lambda s: F.struct(s["text"].alias("text"), s["style"].alias("style"), s["inserted"].alias("inserted"), s["line_break"].alias("line_break"), s["gap"].cast("double").alias("gap")))
        return F.struct(F.when(k["told"]["hits"] > 0, new).otherwise(kept).alias("spans"), k["told"]["hits"].alias("hits"))

    return let(F.struct(spans.alias("spans"), told.alias("told")), put_together)
