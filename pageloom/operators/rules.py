"""Rules as a table, met with texts by hashes of their bytes: thousands of literals in two scans, whatever their number.

A literal's key is a hash of its first bytes, KEY of them at most, so texts and literals that share a key share a literal but
for longer ones and chance. Hashes of all windows of a text follow from running sums. A window that begins like some literal
(a bit of a table of 2^SLOTS says so, over the longest of WINDOWS that fits into the literal) is looked up at the length of
every literal that may begin so; texts join literals on the keys that are left, and only those are looked for, with the
leftmost rule of each literal on its own. Nothing of the rules is in the plan, and two bit tables and the lengths of keys are
all of them that tasks hold, so their number grows neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import anywhere_spans, bounded_spans
from pageloom.operators.redact import expand_variants
from pageloom.sources.scratch import written

#: Bytes of a key, bytes of which it is first asked whether a literal begins so, bits of a table's slots, bytes of texts hashed at a time.
KEY, WINDOWS, SLOTS, PART = 64, (1, 2, 4, 8, 16), 22, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes:
    """Hashes of windows of bytes: differences of running sums of byte times power, brought to the window's begin. Numbers wrap."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def read(self, data: np.ndarray) -> None:
        if len(data) >= len(self.powers):
            power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(data), PART), x, np.uint64)]))
            self.powers, self.inverse = power(_BASE), power(pow(_BASE, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * self.powers[: len(data)])])

    def of(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        return ((self.sums[at + n] - self.sums[at]) * self.inverse[at] + np.asarray(n).astype(np.uint64)) * _MIX

    def of_all(self, n: int) -> np.ndarray:
        """Of each window of n bytes."""
        count = max(len(self.sums) - n, 0)
        return ((self.sums[n:] - self.sums[:count]) * self.inverse[:count] + np.uint64(n)) * _MIX


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, and where each begins and the last ends; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Literals with their keys, the slots of the windows that they begin with and of the keys."""
    hashes = _Hashes()
    for batch in batches:
        data, ends = _bytes(batch.column("spelling"))
        hashes.read(data[ends[0] : ends[-1]])
        at, n = ends[:-1] - ends[0], np.minimum(np.diff(ends), KEY)
        window = np.array(WINDOWS)[np.searchsorted(WINDOWS, n, side="right") - 1]
        key = hashes.of(at, n)
        columns = {"key": key.view(np.int64), "n": n, "window": window, "head": _slots(hashes.of(at, window)), "slot": _slots(key)}
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int64)) for c in columns.values())], [*batch.schema.names, *columns])


def _parts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of some PART bytes at a time, longer texts alone."""
    lo = 0
    while lo < len(ends) - 1:
        hi = max(int(np.searchsorted(ends, ends[lo] + PART, side="right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def _met(heads: bytes, keys: bytes, lengths: dict[int, list[int]]):
    """(doc_id, key) of keys that stand in a text, and of some by chance: once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, whole = (np.unpackbits(np.frombuffer(b, np.uint8)).view(bool) for b in (heads, keys))
        hashes = _Hashes()
        for batch in batches:
            data, ends = _bytes(batch.column("text"))
            for lo, hi in _parts(ends):
                base = ends[lo]
                hashes.read(data[base : ends[hi]])
                rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for window, some in lengths.items():
                    at = np.flatnonzero(begins[_slots(hashes.of_all(window))])
                    row = np.searchsorted(ends, at + base, side="right") - 1
                    left = ends[row + 1] - base - at
                    for n in some:
                        fits = left >= n
                        key = hashes.of(at[fits], n)
                        hit = whole[_slots(key)]
                        rows.append(row[fits][hit])
                        found.append(key[hit].view(np.int64))
                row, key = np.concatenate(rows), np.concatenate(found)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[first])), pa.array(key[first])], ["doc_id", "key"])

    return run


def spelled(rules: DataFrame, variants: bool = True) -> DataFrame:
    """(rule_id, spelling) of ``rules`` (rule_id, literal): empty literals have none; a spelling is the first rule's."""
    rules = rules.filter("literal <> ''").select("rule_id", "literal")
    return expand_variants(rules).select("rule_id", "spelling") if variants else rules.groupBy(F.col("literal").alias("spelling")).agg(F.min("rule_id").alias("rule_id")).select("rule_id", "spelling")


def _table(slots: DataFrame) -> bytes:
    bits = np.zeros(1 << SLOTS, bool)
    bits[slots.distinct().toArrow().column(0).to_numpy()] = True  # at most 2^SLOTS numbers
    return np.packbits(bits).tobytes()


def waiting(texts: DataFrame, spellings: DataFrame) -> DataFrame:
    """(doc_id, rule_id, spelling) of literals that may stand in a text: it holds their first KEY bytes, but for chance."""
    rule = spellings.schema["rule_id"].dataType.simpleString()
    own = spellings.select("rule_id", "spelling").mapInArrow(_keyed, f"rule_id {rule}, spelling string, key long, n long, window long, head long, slot long")
    own = written(own, "rule-keys")
    lengths: dict[int, list[int]] = {}
    for window, n in own.select("window", "n").distinct().orderBy("window", "n").collect():  # at most KEY
        lengths.setdefault(window, []).append(n)
    document = texts.schema["doc_id"].dataType.simpleString()
    met = texts.select("doc_id", "text").mapInArrow(_met(_table(own.select("head")), _table(own.select("slot")), lengths), f"doc_id {document}, key long")
    return met.join(own.select("key", "rule_id", "spelling"), "key").select("doc_id", "rule_id", "spelling")


def rule_spans(texts: DataFrame, rules: DataFrame, *, bounded: bool = True, variants: bool = True) -> DataFrame:
    """(doc_id, rule_id, spelling, lo, hi) of all hits of ``rules`` (rule_id, literal) in ``texts`` (doc_id, text).

    Each spelling has its own non-overlapping leftmost hits; a hit that the word rule turns down still uses up its text. Ids of
    texts are distinct; texts and literals that are null have no hits.
    """
    spellings = written(spelled(rules, variants), "spellings")
    candidates = waiting(texts, spellings).groupBy("doc_id").agg(F.collect_set(F.struct("rule_id", "spelling")).alias("wanted"))
    find = bounded_spans if bounded else anywhere_spans
    each = F.transform("wanted", lambda w: F.transform(find(F.col("text"), w["spelling"]), lambda s: F.struct(w["rule_id"].alias("rule_id"), w["spelling"].alias("spelling"), s["lo"].alias("lo"), s["hi"].alias("hi"))))
    return texts.select("doc_id", "text").join(candidates, "doc_id").select("doc_id", F.inline(F.flatten(each)))


def redacted(texts: DataFrame, spans: DataFrame, token: str = "") -> DataFrame:
    """``texts`` (doc_id, text, ...) without what ``spans`` (doc_id, lo, hi) cover; overlapping and touching ones are one, which
    ``token`` takes the place of."""
    from pageloom.operators.redact import merge_ranges

    cuts = merge_ranges(spans.select("doc_id", "lo", "hi"), ["doc_id"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_cuts"))
    before = lambda i: F.coalesce(F.get("_cuts", i - 1)["hi"], F.lit(0))
    kept = F.transform("_cuts", lambda c, i: F.substring(F.col("text"), before(i) + 1, c["lo"] - before(i)))
    tail = F.substring(F.col("text"), before(F.size("_cuts")) + 1, F.length("text"))
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(F.concat(kept, F.array(tail)), token))
    return texts.join(cuts, "doc_id", "left").withColumn("text", text).drop("_cuts")
