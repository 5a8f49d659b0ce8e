"""Fill-in-middle transformation over a Roaring-style boundary set (operator 13).

A text's units are words of ASCII letters and single other code points. The offsets at which units may be cut (0, every
unit's end) are a sorted set of integers: offsets that share their upper bits, 2^16 each, are one container, which is an
array of offsets, a bitmap or a list of runs, whichever is least; cumulative cardinalities say how many offsets lie before
each container. The i-th cut is found by a binary search for its container and a select inside it, so both cuts of a text
cost no pass over its units. Containers are built from 2^16 code points at a time.

Each row's text is transformed in its own task, without a shuffle. The cuts and the form follow from the id alone: SHA-256
of ``seed:doc_id``, so reruns and repeated rows agree; a null id is an empty string there. Null texts are empty; empty texts,
and texts that hold a sentinel, stay plain. New columns take the place of input columns of their names. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import read_table, shield, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths of texts that are transformed, and of those, hundredths in suffix-prefix-middle order.
RATE, SPM_RATE = 90, 20
SEED = "1"
BITS = 16
#: Bytes of output that are sent on at once.
OUT_BYTES = 1 << 23


class Container:
    """Offsets below 2^16, sorted: ``array`` (the offsets), ``bitmap`` (words of 64), or ``run`` (starts, cumulative lengths)."""

    __slots__ = ("counts", "data", "kind")

    def __init__(self, low: np.ndarray, kind: str | None = None):
        heads = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        cost = {"array": 2 * len(low), "bitmap": (1 << BITS) // 8, "run": 4 * len(heads)}
        self.kind = kind or min(cost, key=cost.get)
        if self.kind == "array":
            self.data, self.counts = low.astype(np.uint16), None
        elif self.kind == "run":
            self.data, self.counts = low[heads].astype(np.uint16), np.append(heads[1:], len(low))
        else:
            bits = np.zeros(1 << BITS, np.uint8)
            bits[low] = 1
            self.data = np.packbits(bits, bitorder="little").view(np.uint64)
            self.counts = np.cumsum(np.bitwise_count(self.data), dtype=np.int64)

    def select(self, i: int) -> int:
        """The i-th offset, from 0."""
        if self.kind == "array":
            return int(self.data[i])
        at = int(np.searchsorted(self.counts, i, "right"))
        i -= int(self.counts[at - 1]) if at else 0
        if self.kind == "run":
            return int(self.data[at]) + i
        word = int(self.data[at])
        for _ in range(i):  # at most 63 lower bits to clear
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class BoundarySet:
    """Offsets of a text's cuts, containers by their upper bits."""

    def __init__(self, text: str, size: int = 1 << BITS):
        self.containers: list[Container] = []
        self.keys: list[int] = []
        self.before: list[int] = []
        self.cardinality, inside, n = 0, False, len(text)
        for begin in range(0, n + 1, size):
            points = np.frombuffer(text[begin : begin + size].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = (points | np.uint32(32)) - np.uint32(97) < 26
            joined = letter.copy()  # whether an offset lies inside a word
            joined[1:] &= letter[:-1]
            joined[:1] &= inside
            low = np.flatnonzero(~joined)
            if len(letter) < size:
                low = np.append(low, len(letter))  # the text's end
            inside = bool(letter[-1]) if len(letter) else False
            if len(low):
                self.keys.append(begin)
                self.before.append(self.cardinality)
                self.containers.append(Container(low))
                self.cardinality += len(low)

    def select(self, i: int) -> int:
        at = bisect_right(self.before, i) - 1
        return self.keys[at] + self.containers[at].select(i - self.before[at])


def draws(doc_id, seed: str = SEED) -> list[int]:
    """Four 32-bit numbers of an id."""
    name = "" if doc_id is None else doc_id
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def transform(doc_id, text: str | None, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> tuple:
    """(units, form, code points before the middle, in the middle, output) of one text."""
    text = text or ""
    boundaries = BoundarySet(text)
    n = boundaries.cardinality - 1
    a, b, share, order = draws(doc_id, seed)
    if not text or share % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = (boundaries.select(i) for i in sorted((a % (n + 1), b % (n + 1))))
    before, middle, after = text[:first], text[first:second], text[second:]
    if order % 100 < spm_rate:
        return n, "spm", first, second - first, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


_TYPES = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
NEW = "n long, form string, prefix_chars long, middle_chars long, output string"


def _transformed(rate: int, spm_rate: int, seed: str):
    def send(batch, first: int, rows: list[tuple]):
        own = batch.slice(first, len(rows))
        new = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), _TYPES.values(), strict=True)]
        return pa.RecordBatch.from_arrays([*own.columns, *new], names=[*own.schema.names, *_TYPES])

    def run(batches):
        for batch in batches:
            first, rows, held = 0, [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                rows.append(transform(doc_id.as_py(), text.as_py(), rate, spm_rate, seed))
                held += len(rows[-1][-1])
                if held >= OUT_BYTES:
                    yield send(batch, first, rows)
                    first, rows, held = first + len(rows), [], 0
            if rows:
                yield send(batch, first, rows)

    return run


def fill_in_middle(docs: DataFrame, *, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points, null if
    plain) and output."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c in _TYPES))
    hidden, restore = shield(docs, ("doc_id", "text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hidden.schema)
    return restore(hidden.mapInArrow(_transformed(rate, spm_rate, seed), f"{types}, {NEW}"), *_TYPES)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Sentinels can't overlap, and no text with one is transformed, so the first of
    each kind is the one that was put in."""
    at = lambda mark: F.instr(output, F.lit(mark))
    part = lambda a, b: F.substring(output, at(a) + 3, at(b) - at(a) - 3)
    middle = F.substring(output, at(MIDDLE) + 3, F.length(output))
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


_H = "CAST('0x' || substr(h, {0}, 8) AS UBIGINT)"
ORACLE = f"""WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), c AS (
  SELECT doc_id, text, u, len(u) AS n, CAST(least({_H.format(1)} % (len(u) + 1), {_H.format(9)} % (len(u) + 1)) AS BIGINT) AS a, CAST(greatest({_H.format(1)} % (len(u) + 1), {_H.format(9)} % (len(u) + 1)) AS BIGINT) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_H.format(17)} % 100 >= 90 THEN 'plain' WHEN {_H.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE x || m || s END) AS restored_sha256 FROM p"""
