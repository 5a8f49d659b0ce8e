"""Benchmark decontamination by an FM-index per training shard (operator 11).

Texts are words: A-Z lowered, then what isn't ASCII and neither letter nor digit excepted. A window is ``window`` neighbouring
words of a benchmark item, or all words of a shorter item; a word of a text inside any occurrence of a window is hit.

A task gathers texts to shards of about SHARD_BYTES. A shard's words become numbers by an exact dictionary, its texts one
sequence, of which an FM-index is built: suffixes sorted by doubling, their preceding words in a wavelet matrix, every
SAMPLE-th place kept. Shards are written once, as rows. Items are searched in blocks of about BLOCK words: a shard looks the
block's words up in its dictionary, all windows step backwards through the wavelet matrix together, and their occurrences
are located by walking to a kept place. Spans are merged per text. So a benchmark of any size needs one index, and no more of
it is held at once than a block; documents are not shuffled, only a row of numbers for each.

Equal texts of an Arrow batch are indexed once, so copies cost one text. A text of more than PIECE_BYTES is several
pieces, which share ``window`` - 1 words, and may lie in several shards, so a task's memory doesn't grow with texts (one
word is never cut). Words are compared whole, so hits are exact. Nulls and empty texts have no words. Null and repeated
doc_ids are kept apart row by row; equal item_ids are one item, a null one is the empty string. Items without words are
passed over. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.redact import merge_ranges

from .fm_index import FMIndex
from .scratch import read_table, shield, small_batches, streamed, written
from .shingles import column_bytes

WINDOW = 10
SHARD_BYTES = 1 << 22
PIECE_BYTES = 1 << 21
BLOCK = 100_000

_LOWER = np.zeros(256, np.uint8)  # what a byte of a word becomes; 0 ends words
_LOWER[0x30:0x3A], _LOWER[0x61:0x7B], _LOWER[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The end of a shard's sequence, the end of a piece; words follow.
_END, _BREAK, _WORDS = 0, 1, 2


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all words of texts in one buffer, where each text's begin)."""
    low = _LOWER[data]
    inside = low != 0
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    counted = np.concatenate(([0], np.cumsum(inside)))
    places = np.append(counted[starts], counted[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(low[inside])])
    return words, np.searchsorted(starts, offsets)


def chunks(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A text cut between words to stretches of at least ``size`` bytes."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data):
            rest = np.flatnonzero(_LOWER[data[end : end + 65_536]] == 0)
            if len(rest):
                end += int(rest[0])
                break
            end = min(len(data), end + 65_536)
        yield data[at:end]
        at = end


class _Shard:
    """Pieces gathered by one task: their words, and for each the text, its first word's number and how many words it has."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.pieces: list[np.ndarray] = []
        self.bytes = 0

    def add(self, words: pa.Array, text: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        some = n > 0
        self.words.append(words)
        self.pieces.append(np.stack((text, first, n))[:, some])
        self.bytes += words.nbytes

    def row(self) -> dict:
        text, first, n = np.concatenate(self.pieces, axis=1)
        named = pa.concat_arrays(self.words).dictionary_encode()
        ends = np.cumsum(n + 1)
        begins = ends - n - 1
        seq = np.full(int(ends[-1]) + 1, _BREAK, np.int32)
        seq[-1] = _END
        inside = np.ones(len(seq), bool)
        inside[ends - 1] = inside[-1] = False
        seq[inside] = named.indices.to_numpy() + _WORDS
        index = FMIndex.built(seq, len(named.dictionary) + _WORDS, begins)
        return {"words": named.dictionary, "texts": text, "firsts": first, "begins": begins} | index.parts


_INDEX = {"levels": np.uint64, "counts": np.int64, "marks": np.uint64, "places": np.int32, "texts": np.int64, "firsts": np.int64, "begins": np.int64}


def _indexed(window: int, shard_bytes: int, piece_bytes: int, names: list[str]):
    """Rows (names..., text, n_words) of all texts, and shards (words, depth, arrays as bytes)."""

    def shard_row(shard: _Shard, schema: pa.Schema) -> pa.RecordBatch:
        row = shard.row()
        values = {"words": [row["words"].to_pylist()], "depth": [len(row["levels"])]} | {k: [np.ascontiguousarray(row[k].astype(t)).tobytes()] for k, t in _INDEX.items()}
        return pa.RecordBatch.from_arrays([pa.array(values.get(f.name, [None]), f.type) for f in schema], schema=schema)

    def run(batches):
        context, number = TaskContext.get(), 0
        base = context.partitionId() << 40
        shard, schema = _Shard(), None
        for batch in batches:
            if schema is None:
                kept = [pa.field(c, batch.schema.field(c).type) for c in names]
                schema = pa.schema([*kept, ("text", pa.int64()), ("n_words", pa.int64()), ("words", pa.list_(pa.binary())), ("depth", pa.int32()), *((k, pa.binary()) for k in _INDEX)])
            column = batch.column("text").fill_null("").dictionary_encode()
            data, offsets = column_bytes(column.dictionary)
            counts = np.zeros(len(column.dictionary), np.int64)
            first = 0
            while first < len(counts):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + piece_bytes, "right")) - 1)
                some = data[offsets[first] : offsets[last]]
                if last > first + 1 or len(some) <= piece_bytes:
                    words, begins = words_of(some, offsets[first : last + 1] - offsets[first])
                    counts[first:last] = np.diff(begins)
                    shard.add(words, base + number + np.arange(first, last), np.zeros(last - first, np.int64), counts[first:last])
                else:
                    carried = None
                    for chunk in chunks(some, piece_bytes):
                        words, _ = words_of(chunk, np.array([0, len(chunk)]))
                        carry = 0 if carried is None else len(carried)
                        whole = words if carried is None else pa.concat_arrays([carried, words])
                        shard.add(whole, np.array([base + number + first]), counts[first : first + 1] - carry, np.array([len(whole)]))
                        counts[first] += len(words)
                        carried = whole.slice(max(0, len(whole) - window + 1))
                        if shard.bytes >= shard_bytes:
                            yield shard_row(shard, schema)
                            shard = _Shard()
                if shard.bytes >= shard_bytes:
                    yield shard_row(shard, schema)
                    shard = _Shard()
                first = last
            kind = column.indices.to_numpy().astype(np.int64)
            own = {c: batch.column(c) for c in names} | {"text": pa.array(base + number + kind), "n_words": pa.array(counts[kind])}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(len(kind), f.type) for f in schema], schema=schema)
            number += len(counts)
        if shard.bytes:
            yield shard_row(shard, schema)

    return run


def index_shards(docs: DataFrame, *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The FM-indexes of ``docs`` (text, ...), written: rows of shards (depth not null), and rows of documents (their other
    columns, text, a number, and n_words). Serves windows of up to ``window`` words."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    schema = f"{own}, text long, n_words long, words array<binary>, depth int, {', '.join(f'{k} binary' for k in _INDEX)}"
    return written(docs.mapInArrow(_indexed(window, shard_bytes, piece_bytes, names), schema), "shards")


class Phrases:
    """Windows of a block of items, each once: numbers of their words (``vocabulary``), and the items that hold them."""

    def __init__(self, chunks: list[tuple[str, list[str]]], window: int):
        names = sorted({item for item, _ in chunks})
        held: dict[tuple, set] = {}
        for item, words in chunks:
            for i in range(max(1, len(words) - window + 1)):
                held.setdefault(tuple(words[i : i + window]), set()).add(item)
        words = sorted({w for phrase in held for w in phrase})
        number, place = {w: i for i, w in enumerate(words)}, {n: i for i, n in enumerate(names)}
        self.vocabulary = pa.array([w.encode() for w in words], pa.binary())
        self.items = names
        self.lengths = np.array([len(p) for p in held], np.int64)
        self.symbols = np.full((len(held), window), -1, np.int64)
        for i, phrase in enumerate(held):
            self.symbols[i, : len(phrase)] = [number[w] for w in phrase]
        self.owners = np.concatenate([np.array(sorted(place[x] for x in items), np.int64) for items in held.values()])
        self.owned = np.cumsum([0] + [len(items) for items in held.values()])

    def found(self, words: pa.Array, index: FMIndex) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place in the sequence) of all occurrences in one shard."""
        known = pc.index_in(self.vocabulary, value_set=words).fill_null(-1 - _WORDS).to_numpy().astype(np.int64) + _WORDS
        symbols = np.where(self.symbols >= 0, np.append(known, 0)[self.symbols], 0)
        some = np.flatnonzero((symbols >= 0).all(axis=1))
        low, high = index.search(symbols[some], self.lengths[some])
        n = high - low
        hit = np.repeat(np.arange(len(some)), n)
        rows = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + low[hit]
        return some[hit], index.locate(rows)


def _stretches(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (key, begin, end) that overlap or touch as one."""
    order = np.lexsort((begin, key))
    key, begin, end = key[order], begin[order], end[order]
    step = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(end + np.unique(key, return_inverse=True)[1] * step) if len(key) else end
    heads = np.ones(len(key), bool)
    heads[1:] = begin[1:] + np.unique(key, return_inverse=True)[1][1:] * step > reach[:-1]
    first = np.flatnonzero(heads)
    return key[first], begin[first], np.maximum.reduceat(end, first) if len(first) else end[:0]


def _searched(phrases: Phrases):
    """(text, lo, hi, item): merged spans of hit words with a null item, and a row of each item that occurs."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                part = {k: np.frombuffer(batch.column(k)[r].as_buffer(), t) for k, t in _INDEX.items()}
                depth = batch.column("depth")[r].as_py()
                index = FMIndex(part["levels"].reshape(depth, -1), part["counts"], part["marks"], part["places"])
                phrase, place = phrases.found(batch.column("words")[r].values, index)
                piece = np.searchsorted(part["begins"], place, "right") - 1
                begin = part["firsts"][piece] + place - part["begins"][piece]
                text = part["texts"][piece]
                key, lo, hi = _stretches(text, begin, begin + phrases.lengths[phrase])
                pairs = np.unique(np.stack((text, phrase)), axis=1)
                n = np.diff(phrases.owned)[pairs[1]]
                owner = phrases.owners[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.owned[pairs[1]], n)]
                pairs = np.unique(np.stack((np.repeat(pairs[0], n), owner)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lo), pa.array(hi), pa.nulls(len(key), pa.string())], names=["text", "lo", "hi", "item"])
                nothing = pa.nulls(pairs.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), nothing, nothing, pa.array(phrases.items, pa.string()).take(pa.array(pairs[1]))], names=["text", "lo", "hi", "item"])

    return run


def item_chunks(items: DataFrame, window: int, most: int = 1000) -> DataFrame:
    """(item, words) of ``items`` (item_id, text): words of an item, ``most`` at a time and ``window`` - 1 of the next."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(most))
    return rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(most + window - 1)).alias("words"))


def search(index: DataFrame, items: DataFrame, *, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(text, lo, hi, item) of ``items`` (item_id, text) in written shards: spans (item is null), and items that occur."""
    spark = index.sparkSession
    parts = written(item_chunks(items, window), "item-chunks")
    total = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    dealt = parts.withColumn("_block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    shards = index.filter("depth is not null").select("words", "depth", *_INDEX)
    out = None
    for number in range(blocks):
        chunk = [(r.item, r.words) for r in dealt.filter(F.col("_block") == number).select("item", "words").collect()]  # about ``block`` words
        if chunk:
            found = streamed(shards.mapInArrow(_searched(Phrases(chunk, window)), "text long, lo long, hi long, item string"), "found", rows=2)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "text long, lo long, hi long, item string") if out is None else out


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block: int = BLOCK, shard_bytes: int = SHARD_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``docs``' columns but text, with n_words, n_hit, spans (lo, hi: words from 0, end exclusive, merged, in order) and
    items (ids whose windows occur, as strings, sorted). These take the place of input columns of their names."""
    new = ("n_words", "n_hit", "spans", "items")
    docs = docs.drop(*(c for c in docs.columns if c in new))
    hidden, restore = shield(docs, ("text",))
    kept = [c for c in hidden.columns if c != "text"]
    index = index_shards(hidden, window=window, shard_bytes=shard_bytes, piece_bytes=piece_bytes)
    found = search(index, items, window=window, block=block)
    spans = merge_ranges(found.filter("item is null").select("text", "lo", "hi"), ["text"])
    spans = spans.groupBy("text").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    named = found.filter("item is not null").groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = index.filter("depth is null").select(*kept, "text", "n_words")
    out = rows.join(spans.join(named, "text"), "text", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "spans": F.coalesce("spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return restore(out, *new).drop("text")


def _without(batches):
    """Texts without the words of their spans: each span goes from its first word's first byte to its last word's last."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text"), batch.column("_spans"), strict=True):
            if not spans.is_valid or not len(spans):
                texts.append(text.as_py())
                continue
            raw = text.as_py().encode("utf-8", "surrogatepass")
            inside = np.concatenate(([False], _LOWER[np.frombuffer(raw, np.uint8)] != 0, [False]))
            starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
            kept, at = [], 0
            for span in spans.as_py():
                kept.append(raw[at : starts[span["lo"]]])
                at = int(stops[span["hi"] - 1])
            texts.append(b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
        names = [n for n in batch.schema.names if n != "_spans"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names], names=names)


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` (text, ...) whose texts have lost the words of their spans; the same columns, all rows. Rows are numbered in
    a written table, so the spans, found in a second reading, meet their own row."""
    hidden, restore = shield(docs, ("text",))
    rows = written(hidden.withColumn("_row", F.monotonically_increasing_id()), "rows")
    spans = contamination(rows.select("_row", "text"), items, **how).filter("n_hit > 0").select("_row", F.col("spans").alias("_spans"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hidden.schema)
    return restore(rows.join(spans, "_row", "left").drop("_row").mapInArrow(_without, types))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _words_sql(table: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({lower}, '{WORD}') AS w FROM {table}"


ORACLE = f"""WITH d AS ({_words_sql('documents', 'doc_id')}), b AS ({_words_sql('benchmark', 'item_id')}),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS s FROM b, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS u(i) WHERE len(w) > 0),
t AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS s FROM d, (SELECT DISTINCT n FROM g) k, unnest(range(len(w) - n + 1)) AS u(i)),
o AS (SELECT t.doc_id, t.i, t.n, g.item_id FROM t JOIN g ON t.n = g.n AND t.s = g.s),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM o, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)"""
