"""Best-fit packing of token sequences by linear grouping (operator 3).

Documents are tokenised where they lie; only pieces (id, start, length, checksum) go on. Lengths are at most the
capacity, so their histogram is a table of bounded size, and the plan is made on it alone: large lengths, in order, are
cut into groups of equally many pieces and rounded up to their group's longest; configurations of rounded sizes are
chosen one at a time, each the fullest that holds the longest size left, and used as often as its counts allow. Pieces
then take the slots of their group by rank, and what a sequence really has left, again as a histogram, is filled with the
small pieces by best fit, longest first; only what fits nowhere opens new sequences. Ranks are counted within
(length, salt) and shifted by prefix sums, so a length that a third of all pieces share is many tasks.

A null text is empty: one piece with the separator alone. A null id is passed on; repeated rows are packed as often as
they occur. Texts are tokenised whole. No rows give no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import read_table, small_batches, written
from .shingles import _BASE, _INVERSE, _powers, _table, mix, slices

CAPACITY = 2048
SEPARATOR = 0
GROUPS = 512
#: Pieces up to CAPACITY / SMALL_SHARE are small.
SMALL_SHARE = 16
ROWS_PER_SALT = 50_000
#: Units of text whose ids a worker remembers before it starts over.
REMEMBERED = 1_500_000


def _unit_classes() -> np.ndarray:
    """0 white space, 1 letter, 2 punctuation, 3 anything that makes a word one unit as it stands."""
    out = np.full(256, 3, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[65:91] = out[97:123] = 1
    out[0xC3] = 1  # with what follows: the letters of Latin-1, but for two signs
    out[0x80:0xC0] = 1
    out[np.frombuffer(b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~", np.uint8)] = 2
    return out


_UNIT_CLASS = _unit_classes()


class UnitIds:
    """Ids of texts by a tokenizer that never joins across white space, nor letters with punctuation.

    A text is cut into units in numpy: runs of letters and of punctuation, or a whole word if there is anything else in
    it. Each distinct unit, by hash, is coded once; a text's ids are gathered from those. Unknown simple units are coded
    as one text, where the pre-token of each id tells whose it is.
    """

    def __init__(self, path: str | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, "<u4"), 0

    def _code(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _keep(self, hashes: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while n + len(hashes) > len(self.begin):
            self.begin, self.size = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(hashes)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(hashes)] = sizes
        self.used += len(ids)
        self.known.update(zip(hashes, range(n, n + len(hashes)), strict=True))

    def _learn(self, hashes: list[int], units: list[str], simple: list[bool]) -> None:
        easy = [i for i, s in enumerate(simple) if s]
        for at in range(0, len(easy), 4096):
            some = easy[at : at + 4096]
            code = self._code(" ".join([units[i] for i in some]))
            sizes = np.bincount(np.array(code.word_ids, np.int64), minlength=len(some))
            self._keep([hashes[i] for i in some], np.array(code.ids, "<u4"), sizes)
        for i, s in enumerate(simple):
            if not s:
                ids = np.array(self._code(units[i]).ids, "<u4")
                self._keep([hashes[i]], ids, np.array([len(ids)]))

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column."""
        for first, last, data, offsets in slices(column):
            n = len(data)
            kind = _UNIT_CLASS[data]
            if n > 1:
                signs = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
                kind[:-1][signs] = 3
            inside = kind > 0
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | edge[1:n]
            words = np.flatnonzero(begins)
            if not len(words):
                for _ in range(first, last):
                    yield np.zeros(0, "<u4")
                continue
            whole = np.maximum.reduceat(kind, words) == 3
            word = np.cumsum(begins) - 1
            cut = begins.copy()
            cut[1:] |= inside[1:] & inside[:-1] & (kind[1:] != kind[:-1]) & ~whole[word[1:]]
            starts = np.flatnonzero(cut)
            stops = inside.copy()
            stops[:-1] &= ~inside[1:] | edge[1:n] | cut[1:]
            ends = np.flatnonzero(stops) + 1
            sums = np.zeros(n + 1, np.uint64)
            lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
            np.cumsum(_table[lower] * _powers(_BASE, n), out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts])
            distinct, sample, home = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) + len(distinct) > REMEMBERED:
                self._forget()
            keys = distinct.tolist()
            new = [i for i, k in enumerate(keys) if k not in self.known]
            if new:
                at = sample[new]
                raw, lowered = data.tobytes(), lower.tobytes()
                easy = ~whole[word[starts[at]]]
                units = [(lowered if e else raw)[a:b].decode("utf-8", "replace") for a, b, e in zip(starts[at].tolist(), ends[at].tolist(), easy.tolist(), strict=True)]
                self._learn([keys[i] for i in new], units, easy.tolist())
            known = self.known
            entry = np.fromiter((known[k] for k in keys), np.int64, len(keys))[home]
            size = self.size[entry]
            upto = np.concatenate(([0], np.cumsum(size)))
            ids = self.pool[np.repeat(self.begin[entry] - upto[:-1], size) + np.arange(upto[-1])]
            bounds = upto[np.searchsorted(starts, offsets)].tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[a:b]


_coders: dict[str | None, UnitIds] = {}


def coder(path: str | None) -> UnitIds:
    """One a worker process, so what it has learned serves the next task too."""
    if path not in _coders:
        _coders[path] = UnitIds(path)
    return _coders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each row of ``docs``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = SEPARATOR.to_bytes(4, "little")

    def run(batches):
        words = coder(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, code in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text")), strict=True):
                ids = code.tobytes() + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (doc_id, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field("doc_id").type), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def linear_groups(histogram: dict[int, int], groups: int) -> list[tuple[int, list[int], int]]:
    """(rounded size, lengths in it, pieces) from long to short, of equally many pieces as far as whole lengths allow."""
    share = -(-sum(histogram.values()) // groups) if histogram else 1
    out, lengths, n = [], [], 0
    for length in sorted(histogram, reverse=True):
        lengths.append(length)
        n += histogram[length]
        if n >= share:
            out.append((lengths[0], lengths, n))
            lengths, n = [], 0
    if lengths:
        out.append((lengths[0], lengths, n))
    return out


def fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """How many of each size (by index) make the fullest sequence with one of ``first``: subset sums as bit sets."""
    room = capacity - sizes[first]
    mask = (1 << (room + 1)) - 1
    sums, trail = 1, []
    for i in range(first, len(sizes)):
        n = min(left[i] - (i == first), room // sizes[i])
        if n <= 0:
            continue
        trail.append((i, n, sums))
        step = sums
        for _ in range(n):
            step = (step << sizes[i]) & mask
            sums |= step
            if not step:
                break
        if sums >> room & 1:
            break
    total = sums.bit_length() - 1
    chosen = {first: 1}
    for i, n, before in reversed(trail):
        for k in range(n + 1):
            if total - k * sizes[i] >= 0 and before >> (total - k * sizes[i]) & 1:
                break
        if k:
            chosen[i] = chosen.get(i, 0) + k
            total -= k * sizes[i]
    return chosen


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each size in a sequence, sequences like that), until no piece is left."""
    left, out, first = list(counts), [], 0
    while True:
        while first < len(left) and left[first] == 0:
            first += 1
        if first == len(left):
            return out
        chosen = fullest(sizes, left, first, capacity)
        times = min(left[i] // k for i, k in chosen.items())
        for i, k in chosen.items():
            left[i] -= k * times
        out.append((chosen, times))


def best_fit(gaps: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first slot, slots, gap, first rank, slots per sequence) and how many sequences are new.

    The pieces of a length, by rank, take slots; a slot is in the sequence of that rank among those that had ``gap``
    left at first; the gap ``capacity`` stands for new sequences.
    """
    open_: dict[int, list[tuple[int, int, int]]] = {g: [(g, 0, n)] for g, n in gaps.items() if n}
    rows, new = [], 0
    for length in sorted(small, reverse=True):
        todo, slot = small[length], 0
        while todo:
            fit = min((g for g in open_ if g >= length), default=None)
            if fit is None:
                per = capacity // length
                n = todo // per
                if n:
                    rows.append((length, slot, n * per, capacity, new, per))
                    open_.setdefault(capacity - per * length, []).append((capacity, new, n))
                    slot, todo, new = slot + n * per, todo - n * per, new + n
                if todo:
                    rows.append((length, slot, todo, capacity, new, todo))
                    open_.setdefault(capacity - todo * length, []).append((capacity, new, 1))
                    slot, todo, new = slot + todo, 0, new + 1
                continue
            gap, rank, n = open_[fit].pop()
            take = min(n, todo)
            rows.append((length, slot, take, gap, rank, 1))
            if take < n:
                open_[fit].append((gap, rank + take, n - take))
            if not open_[fit]:
                del open_[fit]
            open_.setdefault(fit - length, []).append((gap, rank, take))
            slot, todo = slot + take, todo - take
    return rows, new


def ranked(rows: DataFrame, key: str, most: int, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each value of ``key``, by salted counts; ``most`` rows have one value."""
    salts = max(1, -(-most // ROWS_PER_SALT))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(key).orderBy("_salt")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    return salted.withColumn("_row", inside).join(starts, [key, "_salt"]).withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_salt", "_row", "_start")


def _histogram(rows: DataFrame, key: str) -> dict[int, int]:
    """At most capacity + 1 rows come to the driver."""
    return {int(r[0]): int(r[1]) for r in rows.groupBy(key).count().collect()}


def pack(docs: DataFrame, *, tokenizer_path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = written(token_pieces(docs, tokenizer_path, capacity), "pieces")
    histogram = _histogram(pieces, "length")
    most = max(histogram.values(), default=1)
    limit = capacity // SMALL_SHARE
    grouped = linear_groups({k: n for k, n in histogram.items() if k > limit}, groups)
    plan = configurations([g[0] for g in grouped], [g[2] for g in grouped], capacity)

    slots, used, sequence = [], [0] * len(grouped), 0
    for chosen, times in plan:
        for i, per in chosen.items():
            slots.append((i, used[i], used[i] + per * times, sequence, per))
            used[i] += per * times
        sequence += times
    shifts = []
    for i, (_, lengths, _) in enumerate(grouped):
        at = 0
        for length in lengths:
            shifts.append((length, i, at))
            at += histogram[length]
    order = ["doc_id", "piece", "start", "ids_crc32"]
    large = ranked(pieces.filter(F.col("length") > limit), "length", most, order, "rank")
    shift = spark.createDataFrame(shifts, "length long, group int, shift long")
    slot = spark.createDataFrame(slots, "group int, slot_from long, slot_to long, sequence_from long, per long")
    placed = large.join(F.broadcast(shift), "length").withColumn("slot", F.col("rank") + F.col("shift"))
    met = (placed["group"] == slot["group"]) & (placed["slot"] >= slot["slot_from"]) & (placed["slot"] < slot["slot_to"])
    placed = placed.join(F.broadcast(slot), met).withColumn("sequence_id", F.col("sequence_from") + F.floor((F.col("slot") - F.col("slot_from")) / F.col("per")))
    kept = [*order[:3], "length", "ids_crc32", "sequence_id"]
    placed = written(placed.select(*kept), "pieces-large")

    small_sizes = {k: n for k, n in histogram.items() if k <= limit}
    if small_sizes:
        left = placed.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("gap")).filter("gap > 0")
        left = written(left, "gaps")
        gaps = _histogram(left, "gap")
        fits, _ = best_fit(gaps, small_sizes, capacity)
        fit = spark.createDataFrame(fits, "length long, slot_from long, slots long, gap long, rank_from long, per long")
        small = ranked(pieces.filter(F.col("length") <= limit), "length", most, order, "slot")
        small = small.join(F.broadcast(fit.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & (F.col("slot") >= F.col("slot_from")) & (F.col("slot") < F.col("slot_from") + F.col("slots")))
        small = small.withColumn("rank", F.col("rank_from") + F.floor((F.col("slot") - F.col("slot_from")) / F.col("per")))
        holes = ranked(left, "gap", max(gaps.values(), default=1), ["sequence_id"], "rank")
        old = small.filter(F.col("gap") < capacity).join(holes, ["gap", "rank"])
        new = small.filter(F.col("gap") == capacity).withColumn("sequence_id", F.lit(sequence) + F.col("rank"))
        placed = placed.union(old.select(*kept)).union(new.select(*kept))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), *order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
