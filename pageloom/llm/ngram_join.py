"""N-gram Jaccard join (operator 6): set-similarity join on word shingles with prefix filtering.

Equal sets are one class. Shingles are ordered rare first, by how often they occur in the whole corpus (counters over
all texts, a table whose size is fixed; any fixed order gives right results, so a shared counter costs time only). Two
sets that reach the threshold share a shingle among their first |x| - ceil(t |x|) + 1; classes meet on those. Length and
positional filters are conditions of that join, the suffix filter bounds the overlap by counts of both sets in RANGES equal
hash ranges before whole sets are sent, and what is left is verified once per pair on whole sets. ``linked`` keeps near-copy groups from making all
pairs; the classes' components are formed by joins.

A text without words, or a null one, has an empty set and links with nothing. Repeated rows are one class. A null
doc_id sorts last. Rows that repeat a doc_id are told apart by their texts. No rows give no rows. Shingles are 64-bit
hashes; rows and sets are named by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, linked
from .scratch import BATCH_BYTES, partitions, read_table, shield, small_batches, written
from .shingles import mix, shingle_sets

#: Counters for shingle frequencies: 2^22 of 4 bytes, whatever the corpus size. Broadcast, 16 MB.
LOG2_COUNTERS = 22
RANGES = 16
_BLOCK = 1 << 16


def shingle_counters(docs: DataFrame, n: int, log2: int = LOG2_COUNTERS) -> np.ndarray:
    """How many texts hold a shingle of each counter (the top ``log2`` bits of its hash), over all of ``docs``."""
    blocks = (1 << log2) // _BLOCK or 1
    shift = np.uint64(64 - log2)

    def count(batches):
        total, waiting, held = np.zeros(1 << log2, np.int64), [], 0
        for batch in batches:
            for hashes in shingle_sets(batch.column(0), n):
                waiting.append(hashes >> shift)
                held += len(hashes)
                if held > 1 << log2:
                    total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=1 << log2)
                    waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=1 << log2)
        salt = int(np.random.default_rng(int(total.sum())).integers(16))
        for i, part in enumerate(np.split(total, blocks)):
            if part.any():
                small = part.astype(np.min_scalar_type(int(part.max())))
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "salt": pa.array([salt], pa.int32()), "width": pa.array([small.itemsize], pa.int32()), "counts": pa.array([small.tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, width, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "width", "counts")), strict=True):
                part = np.frombuffer(counts, dtype=f"u{width}")
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        for block, part in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([0], pa.int32()), "width": pa.array([4], pa.int32()), "counts": pa.array([np.minimum(part, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})

    schema = "block int, salt int, width int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    salted = parts.repartition(partitions(docs.sparkSession), "block", "salt").mapInArrow(add, schema)
    rows = salted.repartition(min(blocks, partitions(docs.sparkSession)), "block").mapInArrow(add, schema).collect()  # at most 2^log2 counters
    out = np.zeros((blocks, (1 << log2) // blocks), np.uint32)
    for row in rows:
        out[row["block"]] = np.frombuffer(row["counts"], dtype=np.uint32)
    return out.ravel()


def row_key(doc_id: str, text: str) -> Column:
    """16 bytes that name a row by its id and text."""
    own = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(F.length(own).cast("string"), own, F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("-")))))


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def range_counts(hashes: np.ndarray, pieces: int = RANGES) -> np.ndarray:
    """Members of a sorted set in each of ``pieces`` equal hash ranges."""
    edges = np.arange(1, pieces, dtype=np.uint64) * np.uint64((1 << 64) // pieces)
    return np.diff(np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)])))


def set_id(hashes: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _prefixes(n: int, percent: int, log2: int, counters):
    shift = np.uint64(64 - log2)

    def run(batches):
        table = counters.value
        for batch in batches:
            sizes, names, prefixes, ranges = [], [], [], []
            for hashes in shingle_sets(batch.column("text"), n):
                size = len(hashes)
                sizes.append(size)
                names.append(set_id(hashes))
                rare = np.minimum(table[(hashes >> shift).astype(np.int64)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24)
                order = np.argsort(rare, kind="stable")[: prefix_size(size, percent)] if size else []
                prefixes.append(hashes[order].astype(np.int64) if size else np.zeros(0, np.int64))
                ranges.append(range_counts(hashes).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int32()))],
                names=["doc_id", "row_key", "n_shingles", "set_id", "prefix", "ranges"],
            )

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array([x.tobytes() for x in shingle_sets(batch.column("text"), n)], pa.binary())], names=["set_id", "hashes"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, for sorted distinct arrays."""
    total = len(a) + len(b)
    enough = lambda common: 100 * common >= percent * (total - common)
    if not enough(min(len(a), len(b))):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return enough(int((b[at] == a).sum()))


def _similar_pairs(percent: int):
    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similarity_classes(docs: DataFrame, *, n: int = 5, percent: int = 80, log2_counters: int = LOG2_COUNTERS) -> DataFrame:
    """Per row of ``docs``: doc_id, row_key (hash of id and text), n_shingles, set_id, component_id."""
    spark = docs.sparkSession
    small_batches(spark, most_bytes=BATCH_BYTES)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    counters = spark.sparkContext.broadcast(shingle_counters(rows, n, log2_counters))
    schema = f"doc_id {id_type}, row_key binary, n_shingles long, set_id binary, prefix array<long>, ranges array<int>"
    prints = written(rows.mapInArrow(_prefixes(n, percent, log2_counters, counters), schema), "ngram-prefixes")
    counters.destroy()
    filled = prints.filter("set_id is not null")
    classes = written(filled.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row_key")).alias("first")), "ngram-classes")
    firsts = filled.join(classes.select(F.col("first.row_key").alias("row_key"), "set_id"), ["row_key", "set_id"], "left_semi")
    members = firsts.select("set_id", "n_shingles", F.posexplode("prefix").alias("place", "key")).select("key", F.col("set_id").alias("id"), "n_shingles", "place")

    def may_link(x: str, y: str):
        size, other = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
        overlap = F.least(size - F.col(f"{x}.place"), other - F.col(f"{y}.place"))
        return (100 * F.least(size, other) >= percent * F.greatest(size, other)) & ((100 + percent) * overlap >= percent * (size + other))

    def surely(x: str, y: str):
        most = F.aggregate(F.zip_with(f"{x}.ranges", f"{y}.ranges", lambda p, q: F.least(p, q)), F.lit(0), lambda acc, k: acc + k)
        return (100 + percent) * most >= percent * (F.aggregate(f"{x}.ranges", F.lit(0), lambda acc, k: acc + k) + F.aggregate(f"{y}.ranges", F.lit(0), lambda acc, k: acc + k))

    def ranges(ids: DataFrame) -> DataFrame:
        return filled.select(F.col("set_id").alias("id"), "ranges").join(ids, "id", "left_semi").dropDuplicates(["id"])

    def verify(pairs: DataFrame) -> DataFrame:
        own = ranges(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        near = pairs.join(own.select(F.col("id").alias("a"), F.struct("ranges").alias("l")), "a").join(own.select(F.col("id").alias("b"), F.struct("ranges").alias("r")), "b")
        near = written(near.filter(surely("l", "r")).select("a", "b"), "near-pairs")
        needed = near.select(F.col("a").alias("set_id")).union(near.select(F.col("b").alias("set_id"))).distinct()
        chosen = classes.join(needed, "set_id").select("set_id", F.col("first.row_key").alias("row_key"))
        sets = written(rows.select("row_key", "text").join(chosen, "row_key").dropDuplicates(["set_id"]).select("set_id", "text").mapInArrow(_sets(n), "set_id binary, hashes binary"), "ngram-sets")
        both = near.join(sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_similar_pairs(percent), "a binary, b binary")

    links = linked(members, may_link, verify, ranges, surely, rounds=2)
    labels = components(links)
    named = classes.join(labels, classes["set_id"] == labels["id"]).select("set_id", "label", "first")
    least = named.groupBy("label").agg(F.min(F.struct("first.nil", "first.doc_id")).alias("least"))
    component = named.join(least, "label").select("set_id", F.col("least.doc_id").alias("linked_id"), F.lit(True).alias("linked"))
    own = classes.join(component, "set_id", "left").select("set_id", F.when(F.col("linked"), F.col("linked_id")).otherwise(F.col("first.doc_id")).alias("component_id"))
    whole = prints.drop("prefix", "ranges").join(own, "set_id", "left")
    return whole.select("doc_id", "row_key", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id. Documents without words all stay."""
    found = similarity_classes(docs, n=n, percent=percent)
    twice = found.filter("set_id is not null").groupBy("doc_id", "row_key").count().withColumn("again", F.col("count") > 1)
    gone = found.filter("set_id is not null and not (doc_id <=> component_id)").select("row_key").distinct()
    shielded, restore = shield(docs, ("doc_id", "text"))
    left = shielded.withColumn("row_key", row_key("doc_id", "text")).join(gone, "row_key", "left_anti")
    return restore(left if twice.filter("again").isEmpty() else left.dropDuplicates(["row_key"]))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return similarity_classes(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id")
