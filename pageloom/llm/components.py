"""Links among members of buckets, and their connected components.

``linked`` finds links of the members of a bucket without making all pairs. Buckets with one member go in a stream of
sorted rows, which also names a lead of each bucket, its smallest id. Every member is compared with its lead, and
components of what is linked so far are formed; further leads, those that share most buckets, may follow. Then only
members outside their first lead's component are compared with the others of their bucket, in blocks of bounded size, if
they are in different components; buckets whose members beside the leads are in one component are done. What a lead gathers costs its
size, not the square, and no link that joins two components is missed. ``packed`` and ``packed_buckets`` do the first part
for many short rows: keys and ids travel as one string of bytes for each shard.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, partitions, streamed, written

#: Members of a bucket that meet one row in a task.
BLOCK = 512
#: Bytes of the ids of packed members, and rows (a key and an id) of a shard that are held before crowded keys hand out theirs.
ID_BYTES = 16
MOST_HELD = 1 << 21


def components(links: DataFrame) -> DataFrame:
    """(id, label) for each end of ``links`` (a, b): label is the smallest id reachable. Large-star and small-star steps.

    Each step sends a node's neighbours to the smallest of them, until all nodes point at one that points nowhere: their
    component's smallest id. Nulls and loops are ignored.
    """
    pointers = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        ends = pointers.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(pointers.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.filter("out > 1 or out + into > 1").agg(F.count(F.lit(1))).first()[0] == 0:
            break
        both = pointers.union(pointers.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pointers = written(moved.union(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
    roots = pointers.select(F.col("v").alias("id")).distinct()
    return pointers.select(F.col("u").alias("id"), F.col("v").alias("label")).union(roots.select("id", F.col("id").alias("label")))


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    if pa.types.is_binary(column.type):  # ids of one width
        width = len(column[0].as_py())
        data = np.frombuffer(column.buffers()[2], np.uint8)[: (column.offset + len(column)) * width]
        rows = data.reshape(-1, width)[column.offset :]
        return (rows[1:] != rows[:-1]).any(axis=1)
    x = column.to_numpy(zero_copy_only=False)
    return x[1:] != x[:-1]


def _shared(extra: list[str]):
    """Rows (key, id, ...) in order of key and id: those whose key has several ids, each id once, with their key's lead."""

    def run(batches):
        before = None  # the last row so far, and whether it is known to be shared
        lead = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            known = False
            if before is not None:
                table, known = pa.concat_tables([before[0], table]), before[1]
            table = table.combine_chunks()
            key, own = (table.column(c).chunk(0) for c in ("key", "id"))
            new_key = _differs(key)
            keep = np.concatenate(([True], new_key | _differs(own)))
            if not keep.all():
                table = table.filter(pa.array(keep)).combine_chunks()
                new_key = _differs(table.column("key").chunk(0))
            n = len(table)
            first = np.concatenate(([True], new_key))
            shared = np.zeros(n, bool)
            shared[1:] |= ~new_key
            shared[:-1] |= ~new_key
            shared[0] |= known
            heads = np.flatnonzero(first)
            at = heads[np.cumsum(first) - 1]
            leads = table.select(["id", *extra])
            if known or (before is not None and lead is not None):
                leads = pa.concat_tables([lead, leads])  # the first row goes on with its own lead
                at = np.where(at == 0, 0, at + 1)
            out = table
            for c in ("id", *extra):
                out = out.append_column(f"lead_{c}", leads.column(c).take(pa.array(at)).combine_chunks())
            done = shared.copy()
            done[-1] = False
            yield from out.filter(pa.array(done)).to_batches()
            before = (table.slice(n - 1), bool(shared[-1]))
            lead = leads.slice(int(at[-1]), 1)
        if before is not None and before[1]:
            out = before[0]
            for c in ("id", *extra):
                out = out.append_column(f"lead_{c}", lead.column(c))
            yield from out.combine_chunks().to_batches()

    return run


def packed(names: list[bytes], keys: np.ndarray, shards: int) -> pa.RecordBatch:
    """(shard, keys, ids) of members that have a row of ``keys`` each: a row for each shard, all of its members' keys in one
    string of bytes and their ids, of ``ID_BYTES``, in another."""
    width = keys.shape[1]
    flat = keys.ravel()
    shard = (flat % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    own = np.frombuffer(b"".join(names), f"V{ID_BYTES}")[order // width].tobytes()
    flat = flat[order].tobytes()
    full = np.flatnonzero(np.diff(ends, prepend=0))
    spans = [(int(ends[k - 1]) if k else 0, int(ends[k])) for k in full]
    columns = [pa.array(full, pa.int32()), pa.array([flat[8 * a : 8 * b] for a, b in spans], pa.binary()), pa.array([own[ID_BYTES * a : ID_BYTES * b] for a, b in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "ids"])


class _Buckets:
    """Members of a shard as they come. A key that has three ids hands its members out and keeps its lead only, so what is held
    are two rows a key at most."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: bytes, ids: bytes) -> None:
        own = np.frombuffer(keys, np.uint64), np.frombuffer(ids, ">u8").astype(np.uint64).reshape(-1, 2)
        self.parts.append((*own, np.zeros(len(own[0]), bool)))
        self.held += len(own[0])

    def shared(self, last: bool):
        """(key, id, lead, more) of the members whose key is known to be shared; ``more``: by three ids at least. All others stay."""
        if not self.parts:
            return None
        keys, ids, opened = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        several = np.zeros(len(keys), bool)
        several[1:] |= same
        several[:-1] |= same
        alone = order[~several]
        at = order[several]
        at = at[np.lexsort((ids[at, 1], ids[at, 0], ~opened[at], keys[at]))]  # a key's lead first: the one it had, or its smallest id
        key, own = keys[at], ids[at]
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(at) else np.zeros(0, bool)
        heads = np.flatnonzero(first)
        lead = heads[np.cumsum(first) - 1] if len(at) else heads
        again = np.zeros(len(at), bool)
        again[1:] = ~first[1:] & (own[1:] == own[:-1]).all(axis=1)
        again |= ~first & (own == own[lead]).all(axis=1)
        number = np.cumsum(first) - 1
        n = np.bincount(number[~again], minlength=len(heads))
        more = ((n > 2) | opened[at[heads]])[number] if len(at) else again
        out = ~again & (more | (~first & last))
        kept = ~again & ~out | first & more
        rest = np.concatenate((alone, at[kept]))
        self.parts = [] if last else [(keys[rest], ids[rest], np.concatenate((opened[alone], more[kept])))]
        self.held = 0 if last else len(rest)
        return key[out], own[out], own[lead[out]], more[out]


def _shared_of_shards(most: int):
    """Rows (key, id, lead_id, more) of packed members in order of their shards."""

    def table(rows):
        keys, *ids, more = rows
        listed = [pa.Array.from_buffers(pa.binary(ID_BYTES), len(x), [None, pa.py_buffer(x.astype(">u8").tobytes())]).cast(pa.binary()) for x in ids]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *listed, pa.array(more)], names=["key", "id", "lead_id", "more"])

    def run(batches):
        buckets, shard, limit = _Buckets(), None, most
        for batch in batches:
            for at, keys, ids in zip(batch.column("shard").to_pylist(), batch.column("keys"), batch.column("ids"), strict=True):
                if at != shard:
                    if rows := buckets.shared(True):
                        yield table(rows)
                    shard, limit = at, most
                buckets.add(keys.as_py(), ids.as_py())
                if buckets.held > limit:
                    yield table(buckets.shared(False))
                    limit = max(most, 2 * buckets.held)
        if rows := buckets.shared(True):
            yield table(rows)

    return run


def packed_buckets(members: DataFrame, shards: int, most: int = MOST_HELD) -> DataFrame:
    """Shared buckets, for ``linked``, of ``packed`` members; a task holds the keys of a shard at a time."""
    dealt = members.repartitionById(partitions(members.sparkSession), "shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(_shared_of_shards(most), "key long, id binary, lead_id binary, more boolean"), "shared-buckets")


def shared_buckets(members: DataFrame) -> DataFrame:
    """Rows of the buckets that several ids of ``members`` (key, id, ...) share, with their bucket's lead."""
    extra = [c for c in members.columns if c not in ("key", "id")]
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in members.columns), *(f"lead_{c} {kinds[c]}" for c in ("id", *extra))])
    dealt = members.repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key", "id")
    return streamed(dealt.mapInArrow(_shared(extra), schema), "shared-buckets")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after ``links`` have come to the components of ``labels``: only the components that they join are gone through."""
    if labels is None:
        return components(links)
    of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joins = components(ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    moved = labels.join(joins.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return moved.union(joins.join(labels, "id", "left_anti").select("id", "label"))


def _linked(shared: DataFrame, may_link: Callable[[str, str], Column] | None, verify: Callable[[DataFrame], DataFrame], details: Callable[[DataFrame], DataFrame] | None, surely: Callable[[str, str], Column] | None, before: Callable[[DataFrame], None] | None, block: int, rounds: int, meet: Callable[[DataFrame], DataFrame] | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Links, in the order in which they were found, and the labels of all but the last ones' components."""
    extra = [c for c in shared.columns if c not in ("key", "id", "more") and not c.startswith("lead_")]
    may = may_link or (lambda x, y: F.lit(True))

    def paired(pairs: DataFrame) -> DataFrame:
        return written(pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct(), "pairs")

    own = F.struct("id", *extra).alias("l")
    lead = F.struct(F.col("lead_id").alias("id"), *(F.col(f"lead_{c}").alias(c) for c in extra)).alias("r")
    first_pairs = paired(shared.filter("id <> lead_id").select(own, lead).filter(may("l", "r")))
    if before is not None:
        every = first_pairs if may_link is None else shared.select(F.col("id").alias("a"), F.col("lead_id").alias("b"))
        before(every.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = [written(verify(first_pairs), "links")]
    labels = written(merged(None, links[0]), "labels")

    def labelled(rows: DataFrame) -> DataFrame:
        return written(rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")

    crowded = shared.filter("more") if "more" in shared.columns else shared
    rest = labelled(crowded.select("key", "id", *extra, (F.col("id") == F.col("lead_id")).alias("leads"), F.col("lead_id").alias("first")))
    for _ in range(rounds - 1):
        # A further lead: the member that shares most buckets. It is compared with all that its bucket's others don't join to it.
        often = written(rest.groupBy("id").agg(F.count(F.lit(1)).alias("met")), "met")
        chosen = rest.filter("not leads").join(often, "id").groupBy("key").agg(F.max(F.struct("met", "id", "label", *extra)).alias("m")).select("key", "m.*")
        chosen = written(chosen, "leads")
        met = rest.filter("not leads").alias("l").join(chosen.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.label") != F.col("r.label")) & may("l", "r"))
        links.append(written(verify(paired(met)), "links"))
        labels = written(merged(labels, links[-1]), "labels")
        flags = chosen.select("key", F.col("id").alias("_lead"))
        rest = rest.drop("label").join(flags, "key", "left").withColumn("leads", F.col("leads") | F.coalesce(F.col("id") == F.col("_lead"), F.lit(False))).drop("_lead")
        rest = labelled(rest)
    # Leads have met all others of their bucket; what is open are buckets whose other members are in several components.
    other = F.when(~F.col("leads"), F.col("label"))
    keys = rest.groupBy("key").agg(F.min(other).alias("x"), F.max(other).alias("y"), F.max(F.when(F.col("id") == F.col("first"), F.col("label"))).alias("major"), F.count(F.lit(1)).alias("n"))
    keys = keys.filter("x <> y").select("key", "major", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rest = written(rest.filter("not leads").join(keys, "key"), "open-buckets")
    if details is not None:
        rest = rest.join(written(details(rest.select("id").distinct()), "open-members"), "id")
    own_block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    if meet is not None:
        spread = rest.withColumn("minor", F.expr("label <> major")).withColumn("own", own_block)
        spread = spread.withColumn("block", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))).withColumn("other", F.expr("block = own"))
        pairs = written(meet(spread.repartition(partitions(rest.sparkSession), "key", "block").sortWithinPartitions("key", "block", F.desc("other"))).distinct(), "pairs")
    else:
        minor = rest.filter("label <> major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        others = rest.withColumn("block", own_block)
        apart = (F.col("l.label") != F.col("r.label")) & ((F.col("r.label") == F.col("r.major")) | (F.col("l.id") < F.col("r.id"))) & may("l", "r")
        same = (F.col("l.key") == F.col("r.key")) & (F.col("l.block") == F.col("r.block"))
        pairs = paired(minor.alias("l").join(others.alias("r"), same & (apart if surely is None else apart & surely("l", "r"))))
    links.append(written(verify(pairs), "links"))
    dropped(shared)
    return links, labels


def linked(members: DataFrame, may_link: Callable[[str, str], Column] | None, verify: Callable[[DataFrame], DataFrame], details: Callable[[DataFrame], DataFrame] | None = None, surely: Callable[[str, str], Column] | None = None, before: Callable[[DataFrame], None] | None = None, block: int = BLOCK, rounds: int = 1) -> DataFrame:
    """Links (a, b), a < b, among members of a bucket: ``members`` has (key, id, ...); equal rows count once.

    ``may_link`` is a necessary condition on two members' columns, given their aliases, and ``surely`` one on the columns
    that ``details`` gives by id, for a table of the ids that are left; ``verify`` keeps the pairs (a, b) that do link.
    ``before`` gets the ids of shared buckets first. ``rounds``: leads that a bucket has, one after the other. Links inside a
    component that the leads have formed aren't all listed, so this serves components, not counts of links.
    """
    links, _ = _linked(shared_buckets(members), may_link, verify, details, surely, before, block, rounds)
    return reduce(lambda x, y: x.union(y), links)


def joined(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], details: Callable[[DataFrame], DataFrame], meet: Callable[[DataFrame], DataFrame], before: Callable[[DataFrame], None] | None = None, block: int = BLOCK) -> DataFrame:
    """Components, (id, label), of the links that ``linked`` lists, from ``packed_buckets``. ``meet`` gives the pairs (a, b)
    that may link, of rows in order of key, block and ``other``, those that are others first: a row that is ``minor`` (label
    and major differ) meets the others of its key and block that have another label, are in the major component or have a
    larger id."""
    links, labels = _linked(shared, None, verify, details, None, before, block, 1, meet)
    return merged(labels, links[-1])
