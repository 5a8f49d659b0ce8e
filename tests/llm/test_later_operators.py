"""Operators 11 to 13 against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import decontamination, fill_middle, vector_codes
from pageloom.llm.fm_index import FMIndex

WORDS = "river stone bright quiet amber folding lantern harbor meadow copper winter saddle marble thunder velvet orchard".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


PASSAGE = prose(1, 40)
ITEMS = [(1, PASSAGE), (2, "Only, three WORDS"), (10, PASSAGE), (3, None), (4, " .-! "), (None, "Straße über\nalles"), (5, prose(7, 10)), (5, prose(7, 10)), (6, prose(8, 9))]
LONG = prose(50, 30_000)
TEXTS = [
    "see: " + PASSAGE.upper() + "!", PASSAGE, PASSAGE, " ".join(PASSAGE.split()[:9]), " ".join(PASSAGE.split()[5:15]) + " and only-three words", None, "", " \n\t", "only", "x" * 5000,
    "STRAßE über. alles", "straße ÜBER alles", LONG + " " + PASSAGE + " " + LONG, prose(7, 10).replace(" ", " 'n"), prose(8, 9) + " " + prose(7, 10) + " " + prose(8, 9), "only three words, only three words",
    "a\x00only\x00three\x00words", LONG, "only three words " * 200,
]


def brute(text, items, window=decontamination.WINDOW):
    cut = lambda t: re.findall(decontamination.WORD, "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, found = cut(text), set(), set()
    for item, own in items:
        own = cut(own)
        for i in range(max(1, len(own) - window + 1)) if own else ():
            phrase = own[i : i + window]
            for j in range(len(words) - len(phrase) + 1):
                if words[j] == phrase[0] and words[j : j + len(phrase)] == phrase:
                    hit.update(range(j, j + len(phrase)))
                    found.add("" if item is None else str(item))
    return len(words), hit, sorted(found)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i}", -1) for i, t in enumerate(TEXTS)] + [(None, PASSAGE, None, -1), (3, TEXTS[0], "other", -1), (3, TEXTS[0], "other", -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n int").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_index_finds_and_locates():
    rng = np.random.default_rng(5)
    for n, symbols in ((1, 3), (2, 2), (70, 3), (300, 5), (900, 40)):
        seq = np.append(rng.integers(1, symbols, n), 0)
        seq[n // 3 : n // 3 + n // 4] = seq[: n // 4]  # a long repeat
        index = FMIndex.built(seq, symbols, np.array([0, n // 2]), sample=7)
        for length in (1, 2, 3, 8):
            some = np.concatenate((rng.integers(1, symbols, (5, length)), [seq[i : i + length] for i in range(0, max(0, n - length), 11)] or np.ones((1, length), int)))
            low, high = index.search(some, np.full(len(some), length))
            for phrase, a, b in zip(some, low, high, strict=True):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(seq) - length + 1) if (seq[i : i + length] == phrase).all()]


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 300, "piece_bytes": 200, "block": 15}, {"window": 3}])
def test_contamination(docs, items, how):
    got = decontamination.contamination(docs, items, **how).collect()
    assert set(got[0].asDict()) == {"doc_id", "n", "n_words", "n_hit", "spans", "items"}
    want = {}
    for text in set(TEXTS):
        n, hit, found = brute(text, ITEMS, how.get("window", decontamination.WINDOW))
        want[text] = (n, len(hit), found, hit)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, PASSAGE), (3, TEXTS[0]), (3, TEXTS[0])]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted((str(i), *want[t][:3]) for i, t in rows)
    for r in got:
        inside = [w for s in r.spans for w in range(s.lo, s.hi)]
        assert len(inside) == r.n_hit and inside == sorted(set(inside)) and all(a.hi < b.lo for a, b in zip(r.spans, r.spans[1:], strict=False))
        if r.doc_id not in (None, 3):
            assert set(inside) == want[TEXTS[r.doc_id]][3]


def test_decontaminated(docs, items, spark):
    out = decontamination.decontaminated(docs, items)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.spans): r.text for r in out.collect()}
    assert got[0, "s0"] == "see: !" and got[1, "s1"] == "" and got[5, "s5"] is None and got[6, "s6"] == "" and got[3, "s3"] == TEXTS[3]
    assert got[12, "s12"] == LONG + "  " + LONG and got[4, "s4"] == " and " and got[3, "other"] == "see: !" and got[None, None] == "" and len(got) == len(TEXTS) + 2
    assert decontamination.contamination(docs.filter("false"), items).count() == 0
    clean = decontamination.contamination(docs, items.filter("false")).collect()
    assert len(clean) == len(TEXTS) + 3 and not any(r.n_hit or r["items"] for r in clean)


# Operator 12.


def test_slices_find_the_nearest():
    rng = np.random.default_rng(3)
    for k, d, spread in ((1, 3, 50), (5, 1, 4), (16, 8, 30), (16, 8, 2), (70, 4, 9), (200, 2, 40)):
        entries, parts = rng.integers(-spread, spread, (k, d)), rng.integers(-3 * spread, 3 * spread, (500, d))
        parts[:k] = entries[: len(parts)][:500]
        far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        best, least = vector_codes.Slices(entries).nearest(parts)
        assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
    squares = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2, ((1 << 31) - 1) ** 2])
    assert vector_codes.roots(squares).tolist() == [0, 1, 1, 1, 2, (1 << 31) - 1, 1 << 31, (1 << 31) - 1]


def lloyd(vectors, parts, entries, rounds):
    """Codebooks by brute force, of vectors in order of their ids."""
    width = vectors.shape[1] // parts
    split = vectors.reshape(len(vectors), parts, width)
    books = split[:entries].swapaxes(0, 1).copy()
    for _ in range(rounds):
        for p in range(parts):
            own = ((split[:, p, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1)
            for e in range(len(books[p])):
                if (own == e).any():
                    books[p, e] = split[own == e, p].sum(axis=0) // (own == e).sum()
    far = np.stack([((split[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)], axis=1)
    return books, far.argmin(axis=2), far.min(axis=2).sum(axis=1)


@pytest.mark.parametrize("n", [300, 5])
def test_codes(spark, n):
    rng = np.random.default_rng(n)
    good = [(int(i), [float(x) for x in rng.normal(size=8).round(3)], None if i % 9 == 0 else int(i % 4), "clash") for i in range(n)]
    good[2] = (2, [-1.5] * 8, 1, "clash")
    bad = [(-1, None, 1, ""), (-2, [], 1, ""), (-3, [1.0] * 7 + [None], 1, ""), (-4, [1.0] * 7 + [float("nan")], 2, ""), (-5, [float("inf")] * 8, None, "")]
    again = [(n + 1, good[1][1], 3, ""), (n + 1, good[1][1], 3, ""), (None, good[4][1], 3, "")]
    rows = spark.createDataFrame(good + bad + again, "vec_id long, embedding array<double>, label int, code string").repartition(5)
    books = vector_codes.codebooks(rows, parts=4, entries=16, rounds=3)
    kept = good + again
    want, entry, error = lloyd(np.floor(np.array([r[1] for r in kept]) * 4096).astype(np.int64), 4, 16, 3)
    assert (books == want).all()
    coded = vector_codes.compressed(rows, books).cache()
    assert sorted((str(r.id), r.code, r.error) for r in coded.collect()) == sorted((str(k[0]), "".join(f"{x:02x}" for x in e), d) for k, e, d in zip(kept, entry.tolist(), error.tolist(), strict=True))
    sums = {}
    for k, d in zip(kept, error.tolist(), strict=True):
        sums[k[2]] = sums.get(k[2], 0) + d
    assert all(r.label_error == sums[r.label] for r in vector_codes.with_label_error(coded).collect())
    most, vector_codes.MAX_BROADCAST_LABELS = vector_codes.MAX_BROADCAST_LABELS, 1
    try:
        salted = vector_codes.with_label_error(coded).collect()
    finally:
        vector_codes.MAX_BROADCAST_LABELS = most
    assert len(salted) == len(kept) and all(r.label_error == sums[r.label] for r in salted)
    first = coded.filter("id = 0").first()
    assert sum(int(x) for x in (vector_codes.decoded(first.code, books) - np.floor(np.array(good[0][1]) * 4096).astype(int)) ** 2) == first.error


def test_vectors_that_cannot_be_coded(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.codebooks(spark.createDataFrame([(1, None, 1)], kind)) is None
    for wrong in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 7, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="vectors of several lengths|component of"):
            vector_codes.codebooks(spark.createDataFrame(wrong, kind))


def test_nothing_to_code(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vector_codes.op12_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


# Operator 13.


@pytest.mark.parametrize("kind", [None, "array", "bitmap", "run"])
def test_containers_select(kind):
    rng = np.random.default_rng(0)
    for low in (np.array([0]), np.array([65_535]), np.arange(65_536), np.flatnonzero(rng.random(65_536) < 0.5), np.flatnonzero(rng.random(65_536) < 0.01), np.arange(100, 9000)):
        box = fill_middle.Container(low, kind)
        some = np.unique(np.linspace(0, len(low) - 1, 300).astype(int))
        assert [box.select(int(i)) for i in some] == low[some].tolist()
    kinds = {fill_middle.Container(low).kind for low in (np.array([3, 9]), np.arange(5000), np.flatnonzero(rng.random(65_536) < 0.5))}
    assert kinds == {"array", "run", "bitmap"}


def test_boundaries_are_unit_ends():
    for text in ("", "a", "ab cd", " .é", "x" * 20, "abé" * 9, "a-b", "zz" + "é" * 7 + "q" * 9, "word " * 5):
        ends = [0]
        for unit in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
            ends.append(ends[-1] + len(unit))
        for size in (1, 2, 3, 8, 1 << 16):
            cuts = fill_middle.BoundarySet(text, size)
            assert cuts.cardinality == len(ends) and [cuts.select(i) for i in range(len(ends))] == ends


def test_fill_in_middle(spark):
    texts = ["", None, "one", "two words, three", "a<P>b", "<S>", "ends in <", "<M", "é" * 70_000 + "tail " * 30_000, "x" * 200_000, "\x00 \t", "<P <S <M"] + [prose(i, 30) for i in range(60)]
    rows = [(i, t, "keep", "clash") for i, t in enumerate(texts)] + [(None, "no id", "keep", ""), (3, texts[3], "keep", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, output string").repartition(2)
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = out.withColumn("back", fill_middle.restored(out["output"], out["form"])).collect()
    assert len(back) == len(rows) and all(r.back == (r.text or "") and r.n_chars == "keep" for r in back)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    for r in back:
        text, name = r.text or "", "" if r.doc_id is None else r.doc_id
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{name}".encode()).hexdigest()
        a, b, share, order = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        first, second = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        before, middle, after = ("".join(x) for x in (units[:first], units[first:second], units[second:]))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or share % 100 >= 90:
            want = (len(units), "plain", None, None, text)
        elif order % 100 < 20:
            want = (len(units), "spm", len(before), len(middle), f"<S>{after}<P>{before}<M>{middle}")
        else:
            want = (len(units), "psm", len(before), len(middle), f"<P>{before}<S>{after}<M>{middle}")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
    assert fill_middle.fill_in_middle(docs.filter("false")).count() == 0


def test_split_anchors_send_windows_that_stay():
    from pageloom.llm.suffix_dedup import _shards

    common = bytes(range(60, 120))  # 60 bytes: 11 windows
    contexts = [bytes([i]) * 10 + common + bytes([i + 20]) * 10 for i in range(1, 9)]
    columns = {"value": [7] * 8, "context": list(range(8)), "shard": [0] * 8, "doc": list(range(8)), "bytes": contexts}
    batch = pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in columns.items()], names=list(columns))
    rows = [r for out in _shards(50, 1 << 19)([batch]) for r in out.to_pylist()]
    windows = [r for r in rows if r["window"] is not None]
    assert len(windows) == 8 * 20 + 11 and {r["doc"] for r in windows if r["window"] in common} == {0}
    assert [(r["context"], r["begin"], r["end"]) for r in rows if r["window"] is None] == [(i, 10, 70) for i in range(1, 8)]
