"""Exact dedup by composable polynomial fingerprints (operator 5).

A text is hashed in chunks, H(chunk) = sum of byte * BASE^(bytes after it) modulo a prime, for two bases. Chunks
combine by shifting: H(ab) = H(a) * BASE^len(b) + H(b), so chunk hashes made anywhere in any grouping give the
fingerprint of the whole text. A text of several chunks is rows of chunks, which are hashed in tasks of their own and
combined in order; a text has 2^31 bytes at most, so 32,768 hashes. Rows of equal fingerprint and length are then
compared byte by byte, chunk with chunk, with the first row of their group; rows of which a chunk differs form a new
group and are compared again, until none is left. Groups are split over salts for the comparison, each with a copy of
the first row's chunks, so that a text with a third of all rows is many tasks, and no task holds more than a chunk of
each side at a time.

Nulls count as empty texts and empty texts are equal. A null doc_id sorts last. A row that repeats a doc_id with an
equal text is a copy too: only one of them is kept. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ngram_join import row_key
from .scratch import read_table, small_batches, written

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_017)
CHUNK = 1 << 16
ROWS_PER_SALT = 256

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUNS = re.compile(b"  +")
_powers: dict[int, list[np.ndarray]] = {}


def normalised(text: str | None) -> bytes:
    return _RUNS.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(_SPACES))


def powers(n: int = CHUNK) -> list[np.ndarray]:
    """For each base, BASE^(n-1) ... BASE^0 modulo PRIME."""
    if n not in _powers:
        tables = []
        for base in BASES:
            out, x = np.empty(n, dtype=np.uint64), 1
            for i in range(n - 1, -1, -1):
                out[i] = x
                x = x * base % PRIME
            tables.append(out)
        _powers[n] = tables
    return _powers[n]


def chunk_hash(chunk) -> tuple[int, int, int]:
    """(hash by base 0, hash by base 1, bytes) of at most CHUNK bytes: sums stay below 2^55."""
    data = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64)
    n = len(data)
    a, b = (int(data @ table[CHUNK - n :]) % PRIME for table in powers())
    return a, b, n


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Associative: the hash of two neighbouring parts from theirs."""
    a, b = ((x * pow(base, right[2], PRIME) + y) % PRIME for x, y, base in zip(left, right, BASES, strict=False))
    return a, b, left[2] + right[2]


def chunks(data: bytes) -> list[memoryview]:
    """Neighbouring parts of CHUNK bytes, the last one shorter; an empty text is one empty chunk."""
    view = memoryview(data)
    return [view[at : at + CHUNK] for at in range(0, max(len(data), 1), CHUNK)]


def whole(parts) -> tuple[int, int]:
    """(62-bit fingerprint, bytes) of the text whose chunks have the hashes ``parts``, in order."""
    a, b, n = reduce(combine, parts, (0, 0, 0))
    return a << 31 | b, n


def _headed(batches):
    """For each row its number of bytes and SHA-256, and its fingerprint if it is one chunk; else a row for each chunk too."""
    for batch in batches:
        at, fps, sizes, shas, numbers, parts = [], [], [], [], [], []

        def add(i, fp, size, sha, number, part):
            at.append(i), fps.append(fp), sizes.append(size), shas.append(sha), numbers.append(number), parts.append(part)

        for i, text in enumerate(batch.column("text")):
            data = normalised(text.as_py())
            own = chunks(data)
            add(i, whole([chunk_hash(data)])[0] if len(own) == 1 else None, len(data), hashlib.sha256(data).hexdigest(), None, None)
            for number, part in enumerate(own if len(own) > 1 else ()):
                add(i, None, None, None, number, bytes(part))
        rows = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("row_key").take(rows), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())],
            names=["doc_id", "row_key", "fp", "n_bytes", "text_sha256", "chunk", "bytes"],
        )


def _hashed(batches):
    """Hashes of chunks."""
    for batch in batches:
        found = [chunk_hash(part.as_buffer()) for part in batch.column("bytes")]
        columns = [pa.array([h[k] for h in found], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("chunk"), *columns], names=["row_key", "chunk", "a", "b", "n"])


def _combined(batches):
    """Fingerprints of rows from their chunks' hashes, in order."""
    for batch in batches:
        fps = [whole((h["a"], h["b"], h["n"]) for h in parts.as_py())[0] for parts in batch.column("parts")]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(fps, pa.int64())], names=["row_key", "combined"])


def _cut(batches):
    """Chunks of normalised texts, one row each."""
    for batch in batches:
        for i, text in enumerate(batch.column("text")):
            parts = [bytes(part) for part in chunks(normalised(text.as_py()))]
            rows = pa.array([i] * len(parts), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("row_key", "rep_key", "salts")), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["row_key", "rep_key", "salts", "chunk", "bytes"])


def fingerprints(rows: DataFrame, bits: int = 62) -> DataFrame:
    """(doc_id, row_key, fp, n_bytes, text_sha256) of ``rows`` (doc_id, row_key, text)."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    headed = written(rows.mapInArrow(_headed, f"doc_id {id_type}, row_key binary, fp long, n_bytes long, text_sha256 string, chunk int, bytes binary"), "exact-heads")
    heads = headed.filter("chunk is null").drop("chunk", "bytes")
    # Equal rows have equal keys, and equal chunks under them.
    parts = headed.filter("chunk is not null").select("row_key", "chunk", "bytes").repartition("row_key", "chunk")
    hashed = parts.mapInArrow(_hashed, "row_key binary, chunk int, a long, b long, n long").distinct()
    listed = hashed.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("chunk", "a", "b", "n"))).alias("parts"))
    combined = written(listed.mapInArrow(_combined, "row_key binary, combined long"), "exact-combined")
    long = heads.filter("fp is null").join(combined, "row_key").withColumn("fp", F.col("combined")).select(*heads.columns)
    return heads.filter("fp is not null").union(long).withColumn("fp", F.col("fp").bitwiseAND(F.lit((1 << bits) - 1)))


def exact_groups(docs: DataFrame, *, bits: int = 62, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``bits`` keeps so many bits of a fingerprint (tests lower it to force collisions).
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", row_key("doc_id", "text").alias("row_key"))
    prints = written(fingerprints(rows, bits), "exact-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row_key"))
    classes, todo, turn = prints.withColumn("turn", F.lit(0)), prints, 0
    while True:
        groups = written(todo.groupBy("fp", "n_bytes").agg(first.alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "exact-groups")
        members = (
            todo.join(groups, ["fp", "n_bytes"])
            .groupBy("row_key", F.col("rep.row_key").alias("rep_key"))
            .agg(F.max("n").alias("n"))
            .withColumn("salts", F.ceil(F.col("n") / rows_per_salt).cast("int"))
        )
        texts = rows.select("row_key", "text").join(members, "row_key").select("row_key", "rep_key", "salts", "text")
        parts = texts.mapInArrow(_cut, "row_key binary, rep_key binary, salts int, chunk int, bytes binary")
        leads = F.col("row_key") == F.col("rep_key")
        salt = F.when(leads, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row_key"), F.col("salts")).cast("int")))
        dealt = parts.withColumn("salt", F.explode(salt)).select("rep_key", "salt", "chunk", "row_key", "bytes")
        order = Window.partitionBy("rep_key", "salt", "chunk").orderBy((~leads).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
        differ = dealt.withColumn("lead", F.first("bytes").over(order)).filter(~leads & (F.col("bytes") != F.col("lead")))
        differ = written(differ.select("row_key").distinct(), "exact-differ")
        if differ.isEmpty():
            break
        turn += 1
        todo = written(todo.join(differ, "row_key", "left_semi"), "exact-todo")
        moved = differ.withColumn("moved", F.lit(turn))
        classes = written(classes.join(moved, "row_key", "left").withColumn("turn", F.coalesce("moved", "turn")).drop("moved"), "exact-classes")
    key = ["fp", "n_bytes", "turn"]
    sizes = written(classes.groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id")).alias("first"), F.count(F.lit(1)).alias("group_size")), "exact-sizes")
    again = F.row_number().over(Window.partitionBy("doc_id", *key).orderBy("row_key"))
    return (
        classes.withColumn("again", again)
        .join(sizes, key)
        .select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            F.col("group_size").cast("long"),
            (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("again") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
