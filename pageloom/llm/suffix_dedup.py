"""Suffix-array dedup of byte strings (operator 8).

A byte goes if a LENGTH-byte window that covers it also starts in a document with a smaller doc_id; windows are judged
on the input and never cross documents.

Which windows could meet is found first. Every window has an anchor: of the GRAM-byte strings in it, the leftmost of
least hash. Equal windows have equal anchors. The windows around one occurrence of an anchor form a context, of at most
2 * LENGTH - GRAM bytes. Contexts meet by anchor and come in order of (anchor, context hash, document), so a stream tells
copies (the context is in a smaller document), and contexts that differ but share their anchor. A task sends only one
of the equal contexts it has read, so a passage in a third of all texts costs one row a task.

Contexts that differ but share an anchor go to a shard, once each: the shard's suffix array is sorted by Larsson-Sadakane
doubling (only groups that aren't told apart are sorted again), common prefixes of neighbours come from Kasai's rule, and
runs of suffixes that share LENGTH bytes name the smallest document that holds them. An anchor with more than
CONTEXTS_PER_SHARD contexts is many shards; their sorted windows are merged by binary search, dealt by window, so no
shard and no merge holds a whole hot anchor. A task works off one shard after the other.

Copies join to spans, each with the place in the smaller document that it repeats. Their bytes are read there, and are
compared with the span's before it goes: hashes only propose, no byte is removed that wasn't compared.

Nulls are empty texts; texts shorter than LENGTH lose nothing. A null doc_id counts as the largest; ids are integers. Rows
of one doc_id don't remove from each other; where they have different texts, a hash of the text (``part``, else 0) tells them
apart, so spans stay with the row they were found in. Equal texts of larger ids lose all. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, partitions, read_table, small_batches, streamed, written
from .shingles import _BASE, _INVERSE, _powers, _table, mix, slices

LENGTH = 50
GRAM = 16
#: Bounds of what one task holds at a time: contexts of a shard, bytes of neighbouring shards, contexts read, bytes cut from one text.
CONTEXTS_PER_SHARD = 8_192
SHARD_BYTES = 1 << 19
TOGETHER = 1 << 18
CUT_BYTES = 1 << 20
_LAST = (1 << 63) - 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """For each anchor of texts in one buffer: its text, place, first and last window start, value and context hash."""
    n, width = len(data), length - gram + 1
    none = {k: np.zeros(0, np.int64) for k in ("text", "at", "lo", "hi", "value", "context")}
    if n < length:
        return none
    words = np.lib.stride_tricks.as_strided(data, (n - 7, 8), (1, 1)).copy().view("<u8").ravel()
    value = mix(words[: n - gram + 1] * np.uint64(_BASE) + mix(words[gram - 8 : n - 7]))
    place = np.arange(len(value), dtype=np.uint64)
    found = sliding_least((value & np.uint64(0xFFFFFFFF00000000)) | place, width) & np.uint64(0xFFFFFFFF)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(found)]
    starts = np.flatnonzero(np.arange(len(found)) + length <= offsets[1:][text])
    if not len(starts):
        return none
    at, text = found[starts].astype(np.int64), text[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    lo, hi = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_table[data] * _powers(_BASE, n), out=sums[1:])
    shape = ((hi - lo) * 256 + (at[new] - lo)).astype(np.uint64)
    context = mix((sums[hi + length] - sums[lo]) * _powers(_INVERSE, n)[lo] + mix(shape))
    return {"text": text[new], "at": at[new], "lo": lo, "hi": hi, "value": value[at[new]].astype(np.int64), "context": context.astype(np.int64)}


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least (zeros follow the end): Larsson-Sadakane doubling."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    keys = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    order = np.argsort(keys)
    head = np.ones(n + 1, bool)  # whether a place in the order begins a group that isn't told apart yet
    head[1:n] = keys[order[1:]] != keys[order[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    h = 8
    while h < depth:
        slots = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(slots):
            break
        some = order[slots]
        pair = rank[some] * (n + 1) + rank[np.minimum(some + h, n)] + 1
        by = np.argsort(pair)
        some, pair = some[by], pair[by]
        order[slots] = some
        split = np.ones(len(slots), bool)
        split[1:] = pair[1:] != pair[:-1]
        head[slots[split]] = True
        rank[some] = np.maximum.accumulate(np.where(split, slots, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, fixed: np.ndarray, most: int) -> np.ndarray:
    """Bytes each suffix shares with the one before it in ``order``, to at least min(the truth, ``most``) at ``fixed`` places.

    Kasai: a suffix whose predecessor is the successor, in the text, of its left neighbour's predecessor shares one byte
    less than that neighbour. Only suffixes where that chain starts are compared byte by byte; chains restart at ``fixed``.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    head[fixed] = True
    shared = np.zeros(n, np.int64)

    def compare(places: np.ndarray) -> None:
        live = places[before[places] >= 0]
        for step in range(most):
            live = live[(np.maximum(live, before[live]) + step < n)]
            live = live[data[live + step] == data[before[live] + step]]
            if not len(live):
                break
            shared[live] += 1

    compare(np.flatnonzero(head))
    chain = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    out = shared[chain] - (np.arange(n) - chain)
    again = np.flatnonzero((out <= 0) & ~head)
    shared[again] = 0
    compare(again)
    out[again] = shared[again]
    return out


def window_classes(data: np.ndarray, begins: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, context, start) of each window of contexts in one buffer, equal windows having equal classes that ascend with
    their bytes."""
    sizes = np.diff(begins)
    order = suffix_array(data, length)
    shared = common_prefixes(data, order, begins[:-1][sizes > 0], 2 * length)
    run = np.empty(len(data), np.int64)
    run[order] = np.cumsum(shared[order] < length)
    home = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(data)) - begins[home]
    windows = np.flatnonzero(start + length <= sizes[home])
    return run[windows], home[windows], start[windows]


_CONTEXTS = "value long, context long, doc long, part long, begin long, end long, src_doc long, src_part long, src_begin long"
_MARKED = f"{_CONTEXTS}, lead boolean"


def _batch(columns: dict[str, np.ndarray], known: np.ndarray | None = None) -> pa.RecordBatch:
    """Columns of numbers; those named src_ are null where ``known`` is false."""
    nil = lambda k: ~known if known is not None and k.startswith("src_") else None
    return pa.RecordBatch.from_arrays([pa.array(v, mask=nil(k)) for k, v in columns.items()], names=list(columns))


def joined_copies(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Copies (doc, part, begin, end, src_doc, src_part, src_begin), those that overlap and repeat one stretch as one."""
    order = np.lexsort((c["begin"], c["src_begin"] - c["begin"], c["src_part"], c["src_doc"], c["part"], c["doc"]))
    c = {k: v[order] for k, v in c.items()}
    if not len(order):
        return c
    new = np.ones(len(order), bool)
    shift = c["src_begin"] - c["begin"]
    new[1:] = c["begin"][1:] > c["end"][:-1]
    for x in (c["doc"], c["part"], c["src_doc"], c["src_part"], shift):
        new[1:] |= x[1:] != x[:-1]
    heads = np.flatnonzero(new)
    ends = np.maximum.reduceat(c["end"], heads)
    return {k: (ends if k == "end" else v[heads]) for k, v in c.items()}


def _met(waiting: list[tuple]) -> pa.RecordBatch:
    """Contexts read by one task: of equal ones those of the least document, and the others as copies of it."""
    names = ("value", "context", "doc", "part", "begin", "end")
    c = {k: np.concatenate(v) for k, v in zip(names, zip(*waiting, strict=True), strict=True)}
    order = np.argsort(mix(c["value"].view(np.uint64) + mix(c["context"].view(np.uint64))))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["value"][1:] != c["value"][:-1]) | (c["context"][1:] != c["context"][:-1])
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    least = np.minimum.reduceat(c["doc"], heads)[group]
    place = np.arange(len(order))
    source = np.minimum.reduceat(np.where(c["doc"] == least, place, len(order)), heads)[group]
    copy = c["doc"] > least
    own = {k: v[~copy] for k, v in c.items()}
    source = source[copy]
    copies = joined_copies({k: c[k][copy] for k in names[2:]} | {"src_doc": c["doc"][source], "src_part": c["part"][source], "src_begin": c["begin"][source]})
    spread = mix(copies["doc"].view(np.uint64) ^ mix(copies["begin"].view(np.uint64))).view(np.int64)
    n, m = len(own["doc"]), len(spread)
    whole = {"value": np.concatenate((own["value"], spread)), "context": np.concatenate((own["context"], np.zeros(m, np.int64)))}
    whole |= {k: np.concatenate((own[k], copies[k])) for k in names[2:]}
    whole |= {k: np.concatenate((np.zeros(n, np.int64), copies[k])) for k in ("src_doc", "src_part", "src_begin")}
    return _batch(whole, np.arange(n + m) >= n)


def _contexts(length: int, gram: int, together: int):
    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "part"))
            for first, _, data, offsets in slices(batch.column("text")):
                x = anchors(data, offsets, length, gram)
                if len(x["text"]):
                    base, row = offsets[x["text"]], first + x["text"]
                    waiting.append((x["value"], x["context"], ids[row], parts[row], x["lo"] - base, x["hi"] + length - base))
                    held += len(row)
                if held >= together:
                    yield _met(waiting)
                    waiting, held = [], 0
        if waiting:
            yield _met(waiting)

    return run


def _classes(batches):
    """Contexts in order of (value, context, doc, part, begin): copies with their source, and, of values that have several
    contexts and documents, the rows of each context's least document, the first of them as ``lead``."""
    names = ("value", "context", "doc", "part", "begin", "end")
    last: dict | None = None  # the value and context that the last batch ended in
    for batch in batches:
        known = batch.column("src_doc").is_valid().to_numpy(zero_copy_only=False)
        if known.any():
            done = pa.Table.from_batches([batch.filter(pa.array(known))])
            yield from done.append_column("lead", pa.array(np.zeros(len(done), bool))).to_batches()
        c = {k: batch.column(k).to_numpy(zero_copy_only=False)[~known] for k in names}
        n = len(c["value"])
        if not n:
            continue
        on = last is not None and last["value"] == c["value"][0]
        again = on and last["context"] == c["context"][0]
        new_value, lead = np.ones(n, bool), np.ones(n, bool)
        new_value[1:] = c["value"][1:] != c["value"][:-1]
        lead[1:] = new_value[1:] | (c["context"][1:] != c["context"][:-1])
        lead[0] = not again
        heads = np.flatnonzero(lead)
        first = {k: np.concatenate((last["first"][k], c[k][heads])) if again else c[k][heads] for k in ("doc", "part", "begin")}
        kind = np.cumsum(lead) - (0 if again else 1)
        runs, run = np.flatnonzero(new_value), np.cumsum(new_value) - 1
        low, high, kinds = np.minimum.reduceat(c["doc"], runs), np.maximum.reduceat(c["doc"], runs), np.add.reduceat(lead.astype(np.int64), runs)
        if on:
            low[0], high[0], kinds[0] = min(low[0], last["low"]), max(high[0], last["high"]), kinds[0] + last["kinds"]
        copy = c["doc"] > first["doc"][kind]
        several = (low < high) & (kinds > 1)
        edge = ~copy & several[run]
        take = copy | edge
        source = {f"src_{k}": first[k][kind[take]] for k in first}
        yield _batch({k: v[take] for k, v in c.items()} | source | {"lead": lead[take] & ~copy[take]}, copy[take])
        held = last["held"] if on else []
        if on and several[0]:
            yield from held
            held = []
        elif on and len(runs) > 1:
            held = []
        if len(runs) > 1:
            held = []
        if not several[-1]:  # these rows are all of one document
            rest = ~copy & (run == len(runs) - 1)
            held = [*held, _batch({k: v[rest] for k, v in c.items()} | {f"src_{k}": np.zeros(int(rest.sum()), np.int64) for k in first} | {"lead": lead[rest]}, np.zeros(int(rest.sum()), bool))]
        last = {"value": c["value"][-1], "context": c["context"][-1], "low": low[-1], "high": high[-1], "kinds": kinds[-1], "held": held, "first": {k: v[-1:] for k, v in first.items()}}


def _joined(batches):
    """Copies in order of (doc, part): joined where they overlap and repeat one stretch."""
    for batch in batches:
        names = batch.schema.names
        yield _batch(joined_copies({k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}))


def gathered(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of stretches of one buffer."""
    sizes = ends - begins
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[place])])


def _cut(batches):
    """Bytes of wanted stretches, those of few texts at a time."""
    names = ["value", "context", "shard", "doc", "part", "begin"]
    for batch in batches:
        lists = batch.column("wanted")
        for first, last, data, offsets in slices(batch.column("text")):
            some = lists.slice(first, last - first)
            rows = some.flatten()
            base = np.repeat(offsets[:-1], some.value_lengths().to_numpy())
            begins, ends = (rows.field(k).to_numpy(zero_copy_only=False) + base for k in ("at", "to"))
            turn = np.cumsum(ends - begins) // CUT_BYTES
            edges = np.flatnonzero(np.diff(turn, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield pa.RecordBatch.from_arrays([*(rows.field(k).slice(a, b - a) for k in names), gathered(data, begins[a:b], ends[a:b])], names=[*names, "bytes"])


def _worked_off(table: pa.Table, length: int) -> pa.RecordBatch:
    """Neighbouring shards: stretches of each context to remove, and for the merge the windows of split anchors
    (shard >= 0) that stay: the first documents' of each kind, so common passages send one window a shard."""
    table = table.combine_chunks()
    value, context, shard, doc = (table.column(c).to_numpy() for c in ("value", "context", "shard", "doc"))
    column = table.column("bytes").chunk(0)
    begins = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, begins = np.frombuffer(column.buffers()[2], np.uint8)[begins[0] : begins[-1]], begins - begins[0]
    kind, home, start = window_classes(data, begins, length)
    least = np.full(int(kind.max(initial=0)) + 1, _LAST, np.int64)
    np.minimum.at(least, kind, doc[home])
    gone = least[kind] < doc[home]
    hit, at = home[gone], start[gone]
    new = np.ones(len(hit), bool)  # a stretch ends where no window begins in it
    new[1:] = (hit[1:] != hit[:-1]) | (at[1:] > at[:-1] + length)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(hit)) - 1 if len(heads) else heads
    split = np.flatnonzero((shard[home] >= 0) & ~gone)  # one that goes already has no say in the merge: a smaller document's does
    row = np.concatenate((hit[heads], home[split]))
    begin = np.concatenate((at[heads], start[split]))
    end = np.concatenate((at[tails], start[split])) + length
    windows = gathered(data, begins[home[split]] + start[split], begins[home[split]] + start[split] + length)
    windows = pa.concat_arrays([pa.nulls(len(heads), pa.binary()), windows])
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (value[row], context[row], begin, end, doc[row])), windows], names=["value", "context", "begin", "end", "doc", "window"])


def _shards(length: int, most: int):
    """Contexts in order of (value, shard): whole shards are worked off when they have ``most`` bytes together."""

    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.column("bytes").nbytes
            if held < most:
                continue
            table = pa.Table.from_batches(waiting)
            value, shard = (table.column(c).to_numpy() for c in ("value", "shard"))
            cuts = np.flatnonzero((value[1:] != value[:-1]) | (shard[1:] != shard[:-1]))
            if len(cuts):
                yield _worked_off(table.slice(0, int(cuts[-1]) + 1), length)
                waiting = table.slice(int(cuts[-1]) + 1).to_batches()
                held = sum(x.column("bytes").nbytes for x in waiting)
        if any(x.num_rows for x in waiting):
            yield _worked_off(pa.Table.from_batches(waiting), length)

    return run


def _merge(batches):
    """Windows of many shards, in order of (window, doc): each is looked up among the first of their kind by binary search."""
    known, least = np.zeros(0, "S1"), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        windows = np.array([w + b"\1" for w in batch.column("window").to_pylist()], dtype=np.bytes_)
        docs = batch.column("doc").to_numpy()
        first = np.concatenate(([True], windows[1:] != windows[:-1]))
        first[0] = not len(known) or known[-1] != windows[0]
        known = np.concatenate((known[-1:].astype(windows.dtype), windows[first]))
        least = np.concatenate((least[-1:], docs[first]))
        gone = least[np.searchsorted(known, windows)] < docs
        yield batch.select(["value", "context", "begin", "end"]).filter(pa.array(gone))


def _remove(batches):
    """Cuts a text's spans. A span that is said to repeat other bytes goes only if it does."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data, kept, at, removed, runs = (text.as_py() or "").encode("utf-8", "surrogatepass"), [], 0, 0, 0
            end = -1
            for begin, stop in sorted((x["begin"], x["end"]) for x in spans.as_py() or () if x["bytes"] is None or x["bytes"] == data[x["begin"] : x["end"]]):
                if begin > end:
                    runs += 1
                    kept.append(data[at:begin])
                    at = begin
                removed += max(0, stop - max(end, begin))
                end = max(end, stop)
                at = end
            kept.append(data[at:])
            for column, v in zip(out, (len(data), removed, runs, b"".join(kept)), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array([hashlib.sha256(x).hexdigest() for x in out[3]])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with doc, a null doc_id being the largest number, and part, which tells texts of one doc apart."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"))
    own = F.xxhash64("text")
    several = rows.groupBy("doc").agg(F.min(own).alias("x"), F.max(own).alias("y")).filter("x <> y").select("doc", F.lit(True).alias("several"))
    # Written, so that its size is known: most often no doc has several texts, and the join moves none.
    return rows.join(written(several, "several-texts"), "doc", "left").withColumn("part", F.when(F.col("several"), own).otherwise(F.lit(0).cast("long"))).drop("several")


def repeated_spans(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, contexts_per_shard: int = CONTEXTS_PER_SHARD, shard_bytes: int = SHARD_BYTES, together: int = TOGETHER, cut_bytes: int = CUT_BYTES) -> DataFrame:
    """(doc, part, begin, end, bytes): what to remove of ``keyed`` rows, overlaps possible; ``bytes``, where not null, are
    those of a smaller document that the span is said to repeat."""
    spark = rows.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    found = rows.select("doc", "part", "text").mapInArrow(_contexts(length, gram, together), _CONTEXTS)
    found = found.repartition(parts, "value").sortWithinPartitions("value", "context", "doc", "part", "begin")
    marked = written(found.mapInArrow(_classes, _MARKED), "contexts")
    span = "doc long, part long, begin long, end long, src_doc long, src_part long, src_begin long"
    copies = marked.filter("src_doc is not null").select("doc", "part", "begin", "end", "src_doc", "src_part", "src_begin")
    copies = streamed(copies.repartition(parts, "doc", "part").sortWithinPartitions("doc", "part", "begin").mapInArrow(_joined, span), "copies")
    edges = marked.filter("src_doc is null")
    pieces = _pieces(rows, edges, copies, contexts_per_shard, cut_bytes)
    partly = _partly_covered(edges, pieces.filter("value is not null"), length, shard_bytes)
    dropped(marked, copies)
    none = F.lit(None).cast("binary").alias("bytes")
    repeated = pieces.filter("value is null").select("doc", "part", "begin", (F.col("begin") + F.length("bytes")).alias("end"), "bytes")
    return partly.select("doc", "part", "begin", "end", none).union(repeated)


def _pieces(rows: DataFrame, edges: DataFrame, copies: DataFrame, contexts_per_shard: int, cut_bytes: int) -> DataFrame:
    """Bytes of contexts for the shards (value, context, shard, doc), and of what copies repeat (doc, part, begin): each
    text is read for both at once, in turns of about ``cut_bytes``."""
    firsts = edges.filter("lead")
    crowd = firsts.groupBy("value").count().filter(F.col("count") > contexts_per_shard).select("value", F.ceil(F.col("count") / contexts_per_shard).alias("shards"))
    shard = F.when(F.col("shards").isNull(), -1).otherwise(F.pmod(F.xxhash64("context"), F.col("shards"))).cast("long")
    dealt = firsts.join(written(crowd, "crowded-anchors"), "value", "left")
    nil = F.lit(None).cast("long")
    wanted = dealt.select(F.col("doc").alias("of"), F.col("part").alias("in"), F.struct("value", "context", shard.alias("shard"), "doc", nil.alias("part"), nil.alias("begin"), F.col("begin").alias("at"), F.col("end").alias("to")).alias("w"))
    to = (F.col("src_begin") + F.col("end") - F.col("begin")).alias("to")
    repeated = copies.select(F.col("src_doc").alias("of"), F.col("src_part").alias("in"), F.struct(nil.alias("value"), nil.alias("context"), nil.alias("shard"), "doc", "part", "begin", F.col("src_begin").alias("at"), to).alias("w"))
    wanted = wanted.union(repeated)
    often = wanted.groupBy("of", "in").agg(F.sum(F.col("w.to") - F.col("w.at")).alias("n")).select("of", "in", F.ceil(F.col("n") / cut_bytes).alias("turns")).filter("turns > 1")
    turn = F.pmod(F.xxhash64("w.context", "w.doc", "w.begin"), F.coalesce("turns", F.lit(1)))
    lists = wanted.join(written(often, "often-cut"), ["of", "in"], "left").withColumn("turn", turn).groupBy("of", "in", "turn").agg(F.collect_list("w").alias("wanted"))
    lists = lists.select(F.col("of").alias("doc"), F.col("in").alias("part"), "wanted")
    cut = rows.select("doc", "part", "text").dropDuplicates(["doc", "part"]) if _repeats(rows) else rows.select("doc", "part", "text")
    return written(cut.join(lists, ["doc", "part"]).mapInArrow(_cut, "value long, context long, shard long, doc long, part long, begin long, bytes binary"), "pieces")


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc", "part").count().filter("count > 1").isEmpty()


def _partly_covered(edges: DataFrame, pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(doc, part, begin, end) of what contexts share with others of their anchor, by suffix arrays."""
    parts = partitions(edges.sparkSession)
    dealt = pieces.select("value", "context", "shard", "doc", "bytes").repartition(parts, "value", "shard").sortWithinPartitions("value", "shard")
    shards = streamed(dealt.mapInArrow(_shards(length, shard_bytes), "value long, context long, begin long, end long, doc long, window binary"), "shards")
    windows = shards.filter("window is not null").repartition(parts, "window").sortWithinPartitions("window", "doc")
    merged = windows.mapInArrow(_merge, "value long, context long, begin long, end long")
    inner = shards.filter("window is null").select("value", "context", F.col("begin").alias("x"), F.col("end").alias("y")).union(merged)
    own = edges.select("value", "context", "doc", "part", "begin")
    partly = own.join(inner, ["value", "context"]).select("doc", "part", (F.col("begin") + F.col("y")).alias("end"), (F.col("begin") + F.col("x")).alias("begin"))
    return written(partly.select("doc", "part", "begin", "end"), "partly")


def removed(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    rows = keyed(docs)
    spans = repeated_spans(rows, **how).groupBy("doc", "part").agg(F.collect_list(F.struct("begin", "end", "bytes")).alias("spans"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, ["doc", "part"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(read_table(spark, sf_dir, "documents"))
