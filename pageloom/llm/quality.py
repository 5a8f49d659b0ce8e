"""Quality classifier by nearest-neighbour voting (operator 1).

Texts become counts of their words (hashed to TERMS terms), of character-class trigrams, and of words that repeat the one
before, or one shortly before. Log counts are weighted by inverse document frequency; terms and shape are brought to one
length each, so that neither drowns the other, and are projected to DIMENSIONS latent axes (a randomised SVD of the
labelled texts, in one task, as their number is bounded). The labelled vectors, at most MAX_LABELLED of them, are
broadcast; each block of texts is multiplied with all of them, so cosines are exact, and the NEIGHBOURS nearest vote with
weights that grow with their cosine.

Fitted on at most MAX_LABELLED labelled rows, those of the least hash of their id, never on held-out ones; every text is
scored whole. Language, source, id and labels are no inputs of a score. A text without any trigram, empty or null, gets
the share of label 1 among the labelled; without labelled rows every score is 1. Null ids aren't held out. Repeated rows
get equal scores. No rows give no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import read_table, shield, small_batches
from .shingles import slices, word_hashes

MAX_LABELLED = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 12.0
THRESHOLD = 0.7
HELD_OUT = (4, 2)
LOG2_TERMS = 12
TERMS = 1 << LOG2_TERMS
#: Length of the terms' part of a vector; the shape's part has length 1.
TERM_WEIGHT = 0.3

_CLASSES = 16
_FEATURES = _CLASSES**3
_WORD_FEATURES = 4
_SHAPE = _FEATURES + _WORD_FEATURES
#: Texts that are counted at once.
_BLOCK = 256


def _classes() -> np.ndarray:
    out = np.full(256, 15, np.int32)  # other punctuation and control characters
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 4
    for i, group in enumerate((b" ", b"\n", b".", b",", b"!", b"|", b"*#", b"$%&", b"'\"()", b":;-"), 5):
        out[np.frombuffer(group, np.uint8)] = i
    return out


_CLASS = _classes()


def counts(column: pa.Array) -> np.ndarray:
    """One row of feature counts per text."""
    rows = []
    for first, last, data, offsets in slices(column):
        n = last - first
        doc = np.repeat(np.arange(n), np.diff(offsets))
        kind = _CLASS[data]
        grams = (kind[:-2] * _CLASSES + kind[1:-1]) * _CLASSES + kind[2:]
        same = doc[:-2] == doc[2:]
        table = np.bincount(doc[:-2][same] * _FEATURES + grams[same], minlength=n * _FEATURES).reshape(n, _FEATURES)
        words, begins = word_hashes(data, offsets)
        home = np.repeat(np.arange(n), np.diff(begins))
        near = np.zeros((n, _WORD_FEATURES))
        near[:, 0] = np.diff(begins)
        seen = np.zeros(len(words), bool)
        for back in range(1, 9):
            equal = np.zeros(len(words), bool)
            equal[back:] = (words[back:] == words[:-back]) & (home[back:] == home[:-back])
            if back == 1:
                near[:, 1] = np.bincount(home[equal], minlength=n)
            seen |= equal
        near[:, 2] = np.bincount(home[seen], minlength=n)
        order = np.lexsort((words, home))
        again = np.zeros(len(words), bool)
        if len(words) > 1:
            again[1:] = (words[order][1:] == words[order][:-1]) & (home[order][1:] == home[order][:-1])
        near[:, 3] = np.bincount(home[order][again], minlength=n)
        term = (words >> np.uint64(64 - LOG2_TERMS)).astype(np.int64)
        terms = np.bincount(home * TERMS + term, minlength=n * TERMS).reshape(n, TERMS)
        rows.append(np.hstack([table, near, terms], dtype=np.float32, casting="unsafe"))
    return np.vstack(rows) if rows else np.zeros((0, _SHAPE + TERMS), np.float32)


def _directions(rows: np.ndarray) -> np.ndarray:
    """``rows`` brought to length 1 in place; zeros stay."""
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, size, out=rows, where=size > 0)


class Voters:
    """The fitted model: feature weights, latent axes, labelled vectors, labels. Its size is bounded by the constants."""

    def __init__(self, table: np.ndarray, labels: np.ndarray, seed: int = 7) -> None:
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 1.0
        if not len(labels):
            return
        self.weights = (np.log((1 + len(table)) / (1 + np.count_nonzero(table, axis=0))) + 1).astype(np.float32)
        x = self._features(table)
        width = min(DIMENSIONS + 16, *x.shape)
        basis = np.linalg.qr(x.T @ (x @ np.random.default_rng(seed).standard_normal((x.shape[1], width), dtype=np.float32)))[0]
        for _ in range(3):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, axes = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = np.ascontiguousarray((basis @ axes.T)[:, :DIMENSIONS], dtype=np.float32)
        self.vectors = np.ascontiguousarray(_directions(x @ self.axes).T)

    def _features(self, table: np.ndarray) -> np.ndarray:
        """Weighted log counts, in the place of ``table``."""
        np.log1p(table, out=table)
        table *= self.weights
        _directions(table[:, :_SHAPE])
        _directions(table[:, _SHAPE:])
        table[:, _SHAPE:] *= TERM_WEIGHT
        return table

    def scores(self, table: np.ndarray, block: int = 512) -> np.ndarray:
        """One score per row of counts, which are used up."""
        out = np.full(len(table), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(table), block):
            some = table[at : at + block]
            filled = some.any(axis=1)
            cosine = _directions(self._features(some) @ self.axes) @ self.vectors
            near = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, -k:]
            weight = np.exp(SHARPNESS * (np.take_along_axis(cosine, near, axis=1).astype(np.float64) - 1))
            vote = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            out[at : at + block] = np.where(filled, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    modulus, rest = HELD_OUT
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == rest, F.lit(False))


def _sparse(batches):
    """Labelled texts as (quality, places and counts of their features)."""
    for batch in batches:
        quality, texts = batch.column("quality"), batch.column("text")
        for at in range(0, batch.num_rows, _BLOCK):
            packed = [np.stack([np.flatnonzero(r), r[r > 0]]).astype(np.float32).tobytes() for r in counts(texts.slice(at, _BLOCK))]
            yield pa.RecordBatch.from_arrays([quality.slice(at, _BLOCK), pa.array(packed, pa.binary())], names=["quality", "counts"])


def _fitted(most: int):
    def run(batches):
        table, labels = np.zeros((most, _SHAPE + TERMS), np.float32), []
        for batch in batches:
            for quality, row in zip(batch.column("quality").to_pylist(), batch.column("counts"), strict=True):
                at, values = np.frombuffer(row.as_py(), np.float32).reshape(2, -1)
                table[len(labels), at.astype(np.int64)] = values
                labels.append(quality)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(Voters(table[: len(labels)], np.array(labels, np.float64)))], pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Voters:
    """Fit on the labelled rows that aren't held out, at most ``max_labelled``, in one task; the model comes to the driver."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    joined = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(max_labelled)
    rows = joined.select((F.col("quality") > 0).cast("int").alias("quality"), "text").mapInArrow(_sparse, "quality int, counts binary")
    return pickle.loads(rows.coalesce(1).mapInArrow(_fitted(max_labelled), "model binary").first()["model"])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted (columns of these names are replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        parts = [model.value.scores(counts(text.slice(at, _BLOCK))) for at in range(0, len(text), _BLOCK)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    out = docs.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality, as they are."""
    shielded, restore = shield(docs, ("doc_id", "text"))
    return restore(scored(shielded, labels).filter("predicted = 1"))


def op1_quality_votes(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
