"""Line dedup, fuzzy lines by MinHash (operator 10).

A line is a text's part between newlines; its form for comparison has A-Z lowered and white space runs as one space,
trimmed. Its set is the distinct shingles of SHINGLE characters (code points): one changed character inside a line breaks
SHINGLE of them at most, so copies of 10 * SHINGLE - 1 characters pass PERCENT with one such change. The signature is one-permutation MinHash: a shingle's
hash picks a bin and competes for its least value, and empty bins copy a bin chosen by their own number. BANDS bands of
ROWS bins catch 99 % of the pairs at the threshold. Lines that meet in a band are verified by exact Jaccard similarity
of their whole sets; components of verified links are formed by joins, and the first line (least doc_id, then position)
of each component stays, all others go.

Equal lines collapse to one before anything else, by a map-side minimum, so a line in a third of all texts costs one row
a task. Lines of fewer than ``min_chars`` characters are copies only if they are equal; by default these are the ones
without a whole shingle. Lines of white space are left as they are. Documents never go, but a document may keep no line; its text is then empty. Texts that lose no line stay as they are, nulls too.
A null doc_id sorts last; repeated rows keep their lines once. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import MOST_HELD, joined, packed, packed_buckets
from .ngram_join import row_key, similar
from .scratch import BATCH_BYTES, partitions, read_table, shield, small_batches, written
from .shingles import mix

SHINGLE = 5
BANDS, ROWS = 15, 6
BINS = BANDS * ROWS
BITS = 4096
PERCENT = 80
#: Bytes of lines that are hashed at once: arrays of a few hundred KB stay in a core's cache and are taken from the heap again.
SLICE = 1 << 16
#: Lines a task knows as sent: an equal one isn't signed again.
REMEMBERED = 1 << 16
#: Pairs of lines that are compared at once.
MET = 1 << 12
#: Bits of the table that tells the lines whose forms are needed from most others: of fixed size, as it goes to all tasks.
LOG2_MARKS = 25
#: Lines whose bands are sent at once.
SENT = 1 << 15

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_WEIGHTS = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_DONORS = (mix(np.arange(BINS * 64, dtype=np.uint64).reshape(64, BINS)) % np.uint64(BINS)).astype(np.int64)


def line_form(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def code_points(form: bytes) -> np.ndarray:
    if form.isascii():
        return np.frombuffer(form, np.uint8)
    return np.frombuffer(form.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")


def lengths(forms: list[bytes]) -> np.ndarray:
    """Code points of each form: its bytes that don't continue one."""
    sizes, joined_forms = np.fromiter(map(len, forms), np.int64, len(forms)), b"".join(forms)
    if joined_forms.isascii():
        return sizes
    starts = np.cumsum((np.frombuffer(joined_forms, np.uint8) & 0xC0) != 0x80)
    return np.diff(np.concatenate(([0], starts))[np.cumsum(sizes)], prepend=0)


def shingle_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE code points from each position on."""
    wide = data.astype(np.uint64)
    wide += np.uint64(1)
    n = max(0, len(data) - SHINGLE + 1)
    sums, term = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for j in range(SHINGLE):
        sums += np.multiply(wide[j : j + n], _WEIGHTS[j], out=term)
    return mix(sums)


def shingle_codes(data: np.ndarray) -> np.ndarray | None:
    """A number of the SHINGLE code points from each position on, a different one for different code points. None if
    ``data`` has too many kinds of them for 64 bits."""
    present = np.zeros(int(data.max(initial=0)) + 1, bool)
    present[data] = True
    width = 64 // SHINGLE
    if np.count_nonzero(present) > 1 << width:
        return None
    ranks = (np.cumsum(present, dtype=np.uint64) - np.uint64(1))[data]
    codes = np.zeros(max(0, len(data) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        codes = codes << np.uint64(width) | ranks[j : j + len(codes)]
    return codes


def within_lines(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``values``, one for each position of joined lines: those whose shingle ends in its line, and how many each has."""
    line = np.repeat(np.arange(len(sizes)), sizes)[: len(values)]
    whole = np.arange(len(values)) + SHINGLE <= np.cumsum(sizes)[line]
    return values[whole], np.maximum(sizes - SHINGLE + 1, 0)


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's values in order and once each, and where each line's begin (one more than lines). Sorts ``values``."""
    bounds = np.concatenate(([0], np.cumsum(counts)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][counts > 0]] = True
    return values[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def shingled(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' shingles, line after line, and how many each line has."""
    return within_lines(shingle_hashes(code_points(b"".join(forms))), lengths(forms))


def signatures(hashes: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """One row of BINS least hashes for each of ``n`` lines; every line has one shingle at least. Hashes of line ``n`` go nowhere."""
    high = hashes >> np.uint64(32)
    values = hashes << np.uint64(32)
    values |= high
    high *= np.uint64(BINS)
    high >>= np.uint64(32)
    at = high.view(np.int64)
    at += line * BINS
    out = np.full((n + 1) * BINS, _EMPTY, np.uint64)
    np.minimum.at(out, at, values)
    out = out[: n * BINS].reshape(n, BINS)
    filled = out != _EMPTY
    turn = 0
    rows, bins = np.nonzero(~filled)
    while len(rows):
        donor = _DONORS[turn] if turn < 64 else np.roll(np.arange(BINS), turn)
        has = filled[rows, donor[bins]]
        out[rows[has], bins[has]] = out[rows[has], donor[bins[has]]]
        rows, bins, turn = rows[~has], bins[~has], turn + 1
    return out


def line_set(form: bytes) -> np.ndarray:
    return distinct(*shingled([form]))[0]


def _bands(least: np.ndarray) -> np.ndarray:
    values = least.reshape(len(least), BANDS, ROWS)
    weights = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
    return mix((values * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def band_values(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return _bands(signatures(hashes, np.repeat(np.arange(len(counts)), counts), len(counts)))


def bands(forms: list[bytes]) -> np.ndarray:
    """Bands of lines that have a shingle each."""
    hashes, sizes = shingle_hashes(code_points(b"".join(forms))), lengths(forms)
    line = np.repeat(np.arange(len(sizes)), sizes)[: len(hashes)]
    across = (np.cumsum(sizes)[:, None] - np.arange(1, SHINGLE)).ravel()  # shingles from here on end in the next line
    line[across[across < len(hashes)]] = len(sizes)
    return _bands(signatures(hashes, line, len(sizes)))


def bit_maps(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BITS bits that each line's hashes set, a row of longs per line."""
    flags = np.zeros((len(counts), BITS), bool)
    flags[np.repeat(np.arange(len(counts)), counts), (hashes >> np.uint64(40)) % np.uint64(BITS)] = True
    return np.packbits(flags, axis=1).view(np.int64)


def _runs(sizes: list[int]):
    """(first, after the last) of neighbours of about SLICE bytes."""
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > SLICE:
            yield first, i
            first, held = i, 0
        held += size
    if sizes:
        yield first, len(sizes)


def _numbers(ids: pa.Array) -> np.ndarray:
    """Two numbers for each id, in the same order."""
    return np.frombuffer(b"".join(ids.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


def may_be_similar(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """An exact bound for pairs of lines, by sizes and bit maps: a bit that only one line sets stands for a shingle that only that line has."""
    least = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return (100 + percent) * np.minimum(least, np.minimum(n, m)) >= percent * (n + m)


class _Rows:
    """Rows of a batch as arrays: those of one bucket's block, or a part."""

    NAMES = ("key", "id", "label", "major", "size", "bits", "bands", "minor")

    def __init__(self, *columns: np.ndarray):
        self.columns = columns
        for name, column in zip(self.NAMES, columns, strict=True):
            setattr(self, name, column)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        listed = (batch.column(c).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for c in ("bits", "bands"))
        own = (batch.column(c) for c in ("id", "label", "major"))
        return cls(batch.column("key").to_numpy().view(np.uint64), *map(_numbers, own), batch.column("size").to_numpy(), *listed, batch.column("minor").to_numpy(zero_copy_only=False))

    def __getitem__(self, at) -> _Rows:
        return _Rows(*(x[at] for x in self.columns))

    def __add__(self, more: _Rows) -> _Rows:
        return _Rows(*map(np.concatenate, zip(self.columns, more.columns, strict=True)))


def _pairs(minor: _Rows, others: _Rows, percent: int) -> np.ndarray:
    """Four numbers (the smaller id, the larger one) for each pair that may be similar and meets in the first band it shares."""
    label = (minor.label[:, None] != others.label[None]).any(axis=2)
    a, b = minor.id[:, None], others.id[None]
    before = (a[..., 0] < b[..., 0]) | ((a[..., 0] == b[..., 0]) & (a[..., 1] < b[..., 1]))
    i, k = np.nonzero(label & ((others.label == others.major).all(axis=1)[None] | before))
    found = []
    for at in range(0, len(i), MET):
        p, q = i[at : at + MET], k[at : at + MET]
        n, m = minor.size[p], others.size[q]
        near = (100 + percent) * np.minimum(n, m) >= percent * (n + m)
        p, q = p[near], q[near]
        same = minor.bands[p] == others.bands[q]
        first = minor.bands[p, same.argmax(axis=1)] == minor.key[p]
        p, q = p[first], q[first]
        near = may_be_similar(minor.size[p], others.size[q], minor.bits[p], others.bits[q], percent)
        found.append(np.stack((minor.id[p[near]], others.id[q[near]]), axis=1))
    out = np.concatenate(found) if found else np.zeros((0, 2, 2), np.uint64)
    turn = (out[:, 0, 0] > out[:, 1, 0]) | ((out[:, 0, 0] == out[:, 1, 0]) & (out[:, 0, 1] > out[:, 1, 1]))
    out[turn] = out[turn][:, ::-1]
    return out


def _meet(percent: int):
    """Pairs (a, b) of lines that may be similar; a bucket's block is held at a time, and minor lines of other blocks stream by."""

    def table(pairs: list[np.ndarray]):
        raw = np.concatenate(pairs).astype(">u8")
        ids = [pa.Array.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(raw[:, end].tobytes())]).cast(pa.binary()) for end in (0, 1)]
        return pa.RecordBatch.from_arrays(ids, names=["a", "b"])

    def run(batches):
        place, others, done = None, None, True

        def close():
            """Pairs inside the block itself, once all of it is there."""
            return [] if done or others is None else [_pairs(others[others.minor], others, percent)]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, out = _Rows.of(batch), []
            block, other = batch.column("block").to_numpy(), batch.column("other").to_numpy(zero_copy_only=False)
            new = (rows.key[1:] != rows.key[:-1]) | (block[1:] != block[:-1]) | (other[1:] != other[:-1])
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(block)]
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                here, part = (rows.key[first], block[first]), rows[first:last]
                if here != place:
                    out += close()
                    place, others, done = here, None, False
                if other[first]:
                    others = part if others is None else others + part
                elif others is not None:
                    out += close()
                    done = True
                    out.append(_pairs(part, others, percent))
            if out:
                yield table(out)
        if out := close():
            yield table(out)

    return run


def line_id(form: bytes) -> bytes:
    """16 bytes that name a line's form."""
    import xxhash

    return xxhash.xxh3_128_digest(form)


def _lines(text: bytes):
    """(position, form) of the lines that aren't white space."""
    forms = text.lower().split(b"\n")
    # Most texts have single spaces between words and no others: their lines are forms but for A-Z.
    if b"  " in text or b"\t" in text or b"\r" in text or b"\v" in text or b"\f" in text or any(x[:1] == b" " or x[-1:] == b" " for x in forms):
        forms = map(line_form, forms)
    return [x for x in enumerate(forms) if x[1]]


def _bytes(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _found(batches):
    """(doc_id, row_key, place, line, head) of every line; ``head``: the first of its row."""
    for batch in batches:
        counts, places, lines = [], [], []
        for text in batch.column("text"):
            found = _lines(_bytes(text))
            counts.append(len(found))
            places += [place for place, _ in found]
            lines += [line_id(form) for _, form in found]
        at = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        head = np.diff(at, prepend=-1) > 0
        at = pa.array(at)
        columns = [batch.column("doc_id").take(at), batch.column("row_key").take(at), pa.array(places, pa.int32()), pa.array(lines, pa.binary()), pa.array(head)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "place", "line", "head"])


def _banded(min_chars: int, shards: int):
    """Packed bands of the lines of ``min_chars`` characters at least; a task sends a line again only if it has met many others."""

    def run(batches):
        seen: set[bytes] = set()
        forms: list[bytes] = []
        names: list[bytes] = []
        keys: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for text in batch.column("text"):
                for _, form in _lines(_bytes(text)):
                    if len(form) < min_chars or (len(form) < 4 * min_chars and lengths([form])[0] < min_chars):
                        continue
                    name = line_id(form)
                    if name in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    forms.append(form), names.append(name)
                    held += len(form)
                    if held > SLICE:
                        keys.append(bands(forms))
                        forms, held = [], 0
                        if len(names) >= SENT:
                            yield packed(names, np.concatenate(keys), shards)
                            names, keys = [], []
        if forms:
            keys.append(bands(forms))
        if names:
            yield packed(names, np.concatenate(keys), shards)

    return run


def line_marks(ids: DataFrame) -> np.ndarray:
    """A table of 2^LOG2_MARKS bits in which each id's first bits are set."""
    bit = F.shiftright(F.conv(F.hex(F.substring("id", 1, 4)), 16, 10).cast("long"), 32 - LOG2_MARKS)
    words = ids.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).toArrow()
    table = np.zeros(1 << LOG2_MARKS - 6, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table


def _forms(marks):
    """(id, form) of the lines whose id is marked; a task sends a line again only if it has met many others."""

    def run(batches):
        table = np.frombuffer(marks.value, np.uint64)
        seen: set[bytes] = set()
        for batch in batches:
            found = [form for text in batch.column("text") for _, form in _lines(_bytes(text))]
            ids = [line_id(form) for form in found]
            bit = np.frombuffer(b"".join(ids), ">u4").astype(np.uint64)[::4] >> np.uint64(32 - LOG2_MARKS)
            marked = table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)
            sent, forms = [], []
            for i in np.flatnonzero(marked).tolist():
                if ids[i] not in seen:
                    seen.add(ids[i])
                    sent.append(ids[i]), forms.append(found[i])
            if len(seen) >= REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sent, pa.binary()), pa.array(forms, pa.binary())], names=["id", "form"])

    return run


def _sketches(batches):
    """Set size, bit map and bands of lines."""
    for batch in batches:
        forms = batch.column("form").to_pylist()
        for first, last in _runs([len(x) for x in forms]):
            hashes, bounds = distinct(*shingled(forms[first:last]))
            counts = np.diff(bounds)
            bits, table = bit_maps(hashes, counts), band_values(hashes, counts).astype(np.int64)
            listed = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (bits, table)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), pa.array(counts, pa.int64()), *listed], names=["id", "size", "bits", "bands"])


def shingles(form: str) -> set[str]:
    return {form[i : i + SHINGLE] for i in range(len(form) - SHINGLE + 1)}


def similar_lines(x: list[bytes], y: list[bytes], percent: int) -> list[bool]:
    """Whether each pair of forms reaches the threshold, by their whole sets of shingles."""
    forms = list({*x, *y})
    codes = shingle_codes(code_points(b"".join(forms)))
    if codes is None:
        sets = {form: shingles(form.decode("utf-8", "surrogatepass")) for form in forms}
        return [(100 + percent) * len(sets[a] & sets[b]) >= percent * (len(sets[a]) + len(sets[b])) for a, b in zip(x, y, strict=True)]
    values, bounds = distinct(*within_lines(codes, lengths(forms)))
    of = {form: values[a:b] for form, a, b in zip(forms, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
    return [similar(of[a], of[b], percent) for a, b in zip(x, y, strict=True)]


def _similar_lines(percent: int):
    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            keep: list[bool] = []
            for first, last in _runs([len(a) + len(b) for a, b in zip(x, y, strict=True)]):
                keep += similar_lines(x[first:last], y[first:last], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def line_components(rows: DataFrame, percent: int = PERCENT, min_chars: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(occurrences, components, repeats) of ``rows`` (doc_id, row_key, text), and whether there are repeats: (label,
    doc_id, row_key, place) of the lines that occur twice or are linked; (label, keep), ``keep`` is the place that stays;
    the row_key of the rows with lines that are there several times."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = written(rows.mapInArrow(_found, f"doc_id {id_type}, row_key binary, place int, line binary, head boolean"), "line-places")
    repeats = found.filter("head").groupBy("row_key").count().filter("count > 1").select("row_key")
    repeated = not repeats.isEmpty()
    equal = written(found.groupBy("line").count().filter("count > 1").select("line"), "equal-lines")
    shards = max(partitions(rows.sparkSession), BANDS * found.count() // MOST_HELD)
    members = rows.select("text").mapInArrow(_banded(max(min_chars, SHINGLE), shards), "shard int, keys binary, ids binary")
    forms: list[DataFrame] = []

    def texts_of(ids: DataFrame) -> None:
        """Forms of the lines that share a bucket: all texts are read again, but only marked lines are moved."""
        ids = written(ids, "line-ids")
        marks = rows.sparkSession.sparkContext.broadcast(line_marks(ids).tobytes())
        texts = rows.select("text").mapInArrow(_forms(marks), "id binary, form binary")
        forms.append(written(texts.join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"]), "line-forms"))
        marks.destroy()

    def details(ids: DataFrame) -> DataFrame:
        return forms[0].join(ids.hint("shuffle_hash"), "id", "left_semi").mapInArrow(_sketches, "id binary, size long, bits array<long>, bands array<long>")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda end, name: forms[0].select(F.col("id").alias(end), F.col("form").alias(name))
        both = pairs.join(side("a", "x").hint("shuffle_hash"), "a").join(side("b", "y").hint("shuffle_hash"), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_similar_lines(percent), "a binary, b binary")

    def meet(open_rows: DataFrame) -> DataFrame:
        return open_rows.select(*_Rows.NAMES, "block", "other").mapInArrow(_meet(percent), "a binary, b binary")

    labels = joined(packed_buckets(members, shards), verify, details, meet, texts_of)
    named = equal.join(labels, equal["line"] == labels["id"], "full_outer").select(F.coalesce("line", "id").alias("line"), F.coalesce("label", "line").alias("label"))
    held = written(found.join(named.hint("shuffle_hash"), "line").select("label", "doc_id", "row_key", "place"), "line-parts")
    place = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row_key", "place")
    # Written, so Spark can split a crowded component's rows when they meet the place that stays.
    return held, written(held.groupBy("label").agg(F.min(place).alias("keep")), "line-keeps"), repeats, repeated


def _without(columns: list[str]):
    """Texts without the lines at ``_gone``; of a row that repeats an earlier one, without any line that isn't white space."""

    def run(batches):
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, gone, again in zip(*(batch.column(c) for c in ("text", "_gone", "_again")), strict=True):
                raw = _bytes(text)
                parts = raw.split(b"\n")
                lost = set(gone.as_py() or ()) if again.as_py() <= 1 else {i for i, _ in _lines(raw)}
                texts.append(b"\n".join(x for i, x in enumerate(parts) if i not in lost) if lost else text.as_py())
                lines.append(len(parts) if text.is_valid else 0)
                removed.append(len(lost))
            own = {"text": pa.array([x.decode("utf-8", "surrogatepass") if isinstance(x, bytes) else x for x in texts], pa.string()), "_lines_": pa.array(lines, pa.int64()), "_removed_": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in columns], names=columns)

    return run


def dedup_lines(docs: DataFrame, *, percent: int = PERCENT, min_chars: int = SHINGLE) -> DataFrame:
    """``docs`` without the lines that copy an earlier one; n_chars, if there, follows. Adds n_lines and n_removed, which
    take the place of columns of these names."""
    small_batches(docs.sparkSession, most_bytes=BATCH_BYTES)
    extra = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*extra)
    shielded, restore = shield(docs, ("doc_id", "text", "n_chars"))
    keyed = shielded.withColumn("_row_key", row_key("doc_id", "text"))
    rows = keyed.select("doc_id", F.col("_row_key").alias("row_key"), "text")
    found, parts, repeats, repeated = line_components(rows, percent, min_chars)
    here = (F.col("keep.row_key") == F.col("row_key")) & (F.col("keep.place") == F.col("place"))
    held = found.join(parts.hint("shuffle_hash"), "label").select(F.col("row_key").alias("_row_key"), "place", here.alias("here"))
    gone = held.filter("not here")
    gone = (gone.distinct() if repeated else gone).groupBy("_row_key").agg(F.collect_list("place").alias("_gone"))
    whole = keyed.join(gone.hint("shuffle_hash"), "_row_key", "left")
    # Of rows that repeat a document wholly, the later ones lose the lines that the first one keeps.
    again = F.lit(1)
    if repeated:
        whole = whole.join(repeats.select(F.col("row_key").alias("_row_key"), F.lit(True).alias("_repeats")), "_row_key", "left")
        again = F.when(F.col("_repeats"), F.row_number().over(Window.partitionBy("_row_key").orderBy("_row_key"))).otherwise(F.lit(1))
    whole = whole.select(*shielded.columns, "_gone", again.alias("_again"))
    columns = [*shielded.columns, "_lines_", "_removed_"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shielded.schema.fields), "_lines_ long", "_removed_ long"])
    out = whole.mapInArrow(_without(columns), schema).withColumnsRenamed({"_lines_": "n_lines", "_removed_": "n_removed"})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restore(out, "n_lines", "n_removed")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
