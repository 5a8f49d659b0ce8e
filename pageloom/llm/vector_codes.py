"""Vector code compression: product codes, nearest entries by slice-and-intersect bitmasks (operator 12).

Vectors become integers, floor(SCALE * x), and are cut into equal parts, each with a codebook of at most ENTRIES entries,
fitted by ROUNDS rounds of assigning every part to its nearest entry and moving each entry to the floor of its parts' mean.

The nearest entry is found by slices. For each dimension the entries' coordinates are sorted, and every place in that
order carries a bit mask of the entries before it. An initial radius is the distance to the entry that is nearest in the
dimension in which entries are spread most. In each dimension the entries within that radius of the part are one
range of the order, so their mask is the difference of two prefix masks; the AND of all dimensions' masks keeps every
entry that can be as near as the first, as an entry that is out of reach in one dimension is farther in all of them. The
candidates left are compared exactly, in ascending order, so ties go to the lower one. Masks are words of 64 bits.

Each round is one scan: a task sums its parts per entry, Spark adds the tasks' sums, and only the codebooks (parts x
entries x dimensions) reach the driver. No vector is shuffled. Vectors that are null, empty, or hold a null or a non-finite component are
dropped; the others must have one length, a multiple of PARTS, and components below LARGEST in magnitude (sums stay exact
in 64 bits), else the job fails with ArithmeticError. Entries start from the vectors of the least ids, null ids last, those of
one id in order of their components; fewer vectors give fewer entries. Repeated rows count each. No vectors give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import partitions, read_table, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LARGEST = 1 << 16
#: Vectors that are looked up at once.
BLOCK = 8192
#: Labels up to which their sums are broadcast; more of them are joined, salted.
MAX_BROADCAST_LABELS = 100_000
SALTS = 32


class Slices:
    """Prefix masks of one codebook: ``entries`` is an array (entries, dimensions) of integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, d = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0).T.copy()  # (dimensions, entries)
        bits = np.zeros((k, (k + 63) // 64), np.uint64)
        bits[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.masks = np.zeros((d, k + 1, bits.shape[1]), np.uint64)
        for j in range(d):
            self.masks[j, 1:] = np.bitwise_or.accumulate(bits[order[:, j]], axis=0)
        self.widest = int(np.argmax(self.sorted[:, -1] - self.sorted[:, 0])) if d else 0
        self.by_widest = order[:, self.widest]

    def distances(self, parts: np.ndarray, which: np.ndarray) -> np.ndarray:
        gap = parts - self.entries[which]
        return np.einsum("ij,ij->i", gap, gap)

    def first(self, parts: np.ndarray) -> np.ndarray:
        """An entry that is near in the dimension in which entries are spread most."""
        row, x = self.sorted[self.widest], parts[:, self.widest]
        after = np.searchsorted(row, x).clip(0, len(row) - 1)
        before = np.maximum(after - 1, 0)
        return self.by_widest[np.where(np.abs(row[before] - x) <= np.abs(row[after] - x), before, after)]

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (parts, words) of all entries within ``radius`` in every dimension."""
        out = None
        for j, row in enumerate(self.sorted):
            low, high = np.searchsorted(row, parts[:, j] - radius), np.searchsorted(row, parts[:, j] + radius, "right")
            within = self.masks[j, high] ^ self.masks[j, low]
            out = within if out is None else np.bitwise_and(out, within, out=out)
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part, exactly; of equally near entries the lower one."""
        guess = self.first(parts)
        found = self.distances(parts, guess)
        masks = self.candidates(parts, roots(found))
        best, least = np.full(len(parts), len(self.entries)), found.copy()
        for word in range(masks.shape[1]):
            mask = masks[:, word]
            live = np.flatnonzero(mask)
            mask = mask[live]
            while len(live):
                lowest = mask & (~mask + np.uint64(1))
                entry = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) + 64 * word
                far = self.distances(parts[live], entry)
                nearer = (far < least[live]) | ((far == least[live]) & (entry < best[live]))
                best[live[nearer]], least[live[nearer]] = entry[nearer], far[nearer]
                mask = mask ^ lowest
                more = mask != 0
                live, mask = live[more], mask[more]
        return best, least


def roots(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their vectors as integers) of a column of lists."""
    lengths = np.diff(np.asarray(column.offsets)).astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    values = column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    flat = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    home = np.repeat(np.arange(len(column)), lengths)
    valid[home[~np.isfinite(flat)]] = False
    kept = np.flatnonzero(valid)
    if not len(kept):
        return kept, np.zeros((0, 0), np.int64)
    width = int(lengths[kept[0]])
    if (lengths[kept] != width).any():
        raise ArithmeticError("vectors of several lengths")
    flat = flat[valid[home]]
    if (np.abs(flat) >= LARGEST).any():
        raise ArithmeticError(f"a component of {LARGEST} or more")
    return kept, np.floor(flat * SCALE).astype(np.int64).reshape(-1, width)


def codes(vectors: np.ndarray, slices: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances) of every part of every vector, as (vectors, parts)."""
    entry, far = (np.empty((len(vectors), len(slices)), np.int64) for _ in range(2))
    width = vectors.shape[1] // len(slices)
    for p, book in enumerate(slices):
        part = np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])
        for at in range(0, len(part), BLOCK):
            entry[at : at + BLOCK, p], far[at : at + BLOCK, p] = book.nearest(part[at : at + BLOCK])
    return entry, far


def _firsts(entries: int):
    """Of a task's vectors those of the least ids."""

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            kept, vectors = integers(batch.column("vector"))
            ids = batch.column("id").take(pa.array(kept)).to_pylist()
            held += [(i is None, i or 0, v) for i, v in zip(ids, vectors.tolist(), strict=True)]
            held = sorted(held)[:entries]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([None if x[0] else x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.list_(pa.int64()))], names=["id", "vector"])

    return run


def _checked(vectors: np.ndarray, books: np.ndarray) -> None:
    if vectors.shape[1] != books.shape[0] * books.shape[2]:
        raise ArithmeticError("vectors of several lengths")


def _sums(books: np.ndarray):
    """A task's sums of the parts of each entry: (part, entry, n, total)."""

    def run(batches):
        slices = [Slices(book) for book in books]
        parts, entries, width = books.shape
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, vectors = integers(batch.column("vector"))
            if not len(vectors):
                continue
            _checked(vectors, books)
            entry, _ = codes(vectors, slices)
            for p in range(parts):
                n[p] += np.bincount(entry[:, p], minlength=entries)
                np.add.at(total[p], entry[:, p], vectors[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return run


def _coded(books: np.ndarray, id_name: str):
    def run(batches):
        slices = [Slices(book) for book in books]
        for batch in batches:
            kept, vectors = integers(batch.column("vector"))
            if not len(kept):
                continue
            _checked(vectors, books)
            entry, far = codes(vectors, slices)
            digits = entry.astype(np.uint8).tobytes().hex()
            code = [digits[i : i + 2 * len(books)] for i in range(0, len(digits), 2 * len(books))]
            rest = [batch.column(c).take(pa.array(kept)) for c in (id_name, "label")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(code, pa.string()), pa.array(far.sum(axis=1))], names=["id", "label", "code", "error"])

    return run


def _numbered(vectors: DataFrame, id_name: str, vector: str) -> DataFrame:
    return vectors.select(F.col(id_name).cast("long").alias("id"), F.col(vector).alias("vector"))


def codebooks(vectors: DataFrame, *, id_name: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Array (parts, entries, dimensions of a part) of integers; None without vectors. ``entries`` may be 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    rows = _numbered(vectors, id_name, vector)
    first = rows.mapInArrow(_firsts(entries), "id long, vector array<long>").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    if len({len(r.vector) for r in first}) > 1 or len(first[0].vector) % parts:
        raise ArithmeticError("vectors of several lengths, or not of a multiple of the parts")
    start = np.array([r.vector for r in first], np.int64)
    books = start.reshape(len(start), parts, -1).swapaxes(0, 1).copy()
    width = books.shape[2]
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(books), "part long, entry long, n long, total array<long>")
        added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(j))).alias(f"x{j}") for j in range(width)))
        for r in added.collect():  # parts x entries rows at most
            books[r.part, r.entry] = [r[f"x{j}"] // r.n for j in range(width)]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, books: np.ndarray, *, id_name: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, code, error) of each vector that is kept: two hex digits a part, summed squared distances."""
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (id_name, label))
    rows = vectors.select(F.col(id_name).alias("_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    return rows.mapInArrow(_coded(books, "_id"), f"id {id_type}, label {label_type}, code string, error long")


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector, in units of 1 / SCALE, that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))])


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the error summed over equal labels; nulls are one label. Few labels are broadcast; the
    sums of many are repeated for SALTS shares of their rows, so that a label of a third of all rows is many tasks."""
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    if sums.count() <= MAX_BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    many = sums.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, (F.col("_salt") == F.col("_at")) & F.col("label").eqNullSafe(F.col("_label"))).drop("_label", "_salt", "_at")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    books = codebooks(vectors)
    if books is None:
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(compressed(vectors, books), "coded")
    return with_label_error(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    near = f"""SELECT v.vec_id, v.part, v.x, CAST(arg_min(b.entry, d.far * {entries} + b.entry) AS BIGINT) AS entry, min(d.far) AS far
  FROM v JOIN {{0}} b ON b.part = v.part, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS far) d GROUP BY ALL"""
    ctes = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        f"v AS (SELECT vec_id, p AS part, q[len(q) // {parts} * p + 1 : len(q) // {parts} * (p + 1)] AS x FROM k, range({parts}) AS r(p))",
        f"b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v QUALIFY entry < {entries})",
    ]
    for r in range(rounds):
        ctes += [
            f"n{r} AS MATERIALIZED ({near.format(f'b{r}')})",
            f"s{r} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM n{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL)",
            f"m{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY ALL)",
            f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))",
        ]
    return f"""WITH {", ".join(ctes)}, f AS MATERIALIZED ({near.format(f"b{rounds}")}),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""
