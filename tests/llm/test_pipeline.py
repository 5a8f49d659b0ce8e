"""Stages of the corpus pipeline: each against brute force on odd rows, and one after the other on the smallest tables."""

import collections
import re

import numpy as np
import pytest
from test_operators import plain_lines, prose

import corpus_pipeline
from pageloom.llm import ngram_join, packing, quality
from pageloom.llm.scratch import read_table, written

STAGES = dict(corpus_pipeline.STAGES)
#: Columns of documents, and one that clashes with what stages add.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string"
BASE = prose(41, 60)
TEXTS = [
    (1, BASE, "a"), (2, BASE, "b"), (3, BASE.replace(BASE.split()[30], "other", 1), "a"), (4, prose(42, 50) + "\n" + prose(43, 12), "a"), (5, prose(44, 40) + "\n" + prose(43, 12) + "x", "b"),
    (6, None, "a"), (7, "", None), (8, " \n\t", "c"), (9, "word", "c"), (9, "word", "c"), (None, prose(45, 30), "b"), (None, prose(46, 30), None), (10, prose(47, 5000), "b"), (11, BASE + " tail", "c"), (12, "é€ 😀 " * 40, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "xx", s, None if t is None else len(t), "clash") for i, t, s in TEXTS], COLUMNS).repartition(3)


def rows(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)


def test_quality_stage(spark, odd, small):
    out = STAGES["quality_votes"](spark, odd, small)
    assert out.columns == odd.columns and {r.score for r in out.collect()} <= {"clash"}
    kept = {(r.doc_id, r.text) for r in quality.scored(odd.select("doc_id", "text", "source"), read_table(spark, small, "labels")).collect() if r.score >= 0.7}
    assert rows(out) == sorted([x for x in TEXTS if x[:2] in kept], key=repr)


def test_line_stage(spark, odd, small):
    out = STAGES["line_dedup"](spark, odd, small)
    assert out.columns == odd.columns
    # Rows in order of id, null last; repeats of a whole row come after it and keep no line.
    order = sorted(range(len(TEXTS)), key=lambda k: (TEXTS[k][0] is None, TEXTS[k][0] or 0))
    texts = [TEXTS[k][1] for k in order]
    lines, own = plain_lines(texts)
    kept, gone = [], collections.defaultdict(set)
    for (i, k, _), mine in zip(lines, own, strict=True):
        near = [x for x in kept if 10 * len(mine & x) >= 8 * len(mine | x)]
        gone[i].add(k) if near else None
        kept.append(mine)
    want = []
    for i, k in enumerate(order):
        t = texts[i]
        want.append((TEXTS[k][0], t if not gone[i] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), TEXTS[k][2]))
    by_id = lambda found: sorted((x for x in found if x[0] is not None), key=repr)
    got = rows(out)
    assert by_id(got) == by_id(want) and len(got) == len(TEXTS)
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_near_copy_stage(spark, odd, small):
    out = STAGES["ngram_join"](spark, odd, small)
    assert out.columns == odd.columns
    sets = []
    for _, t, _ in TEXTS:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    label = list(range(len(TEXTS)))
    for a in range(len(TEXTS)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    want = [x for k, x in enumerate(TEXTS) if not sets[k] or min(j for j in range(len(TEXTS)) if label[j] == label[k]) == k]
    assert rows(out) == sorted(want, key=repr)


def test_mixing_stage(spark, odd, small):
    out = STAGES["source_mix"](spark, odd, small)
    assert out.columns == odd.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, limit = collections.Counter(), {}
    for _, t, s in TEXTS:
        totals[s] += size(t)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    left, open_ = float(sum(totals.values())), list(names)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    while open_:  # shares that pass three times their source stop there, the rest is shared anew
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * totals[s]]
        for s in over:
            limit[s], left = 3.0 * totals[s], left - 3 * totals[s]
            open_.remove(s)
        if not over:
            limit |= {s: share * weight[s] for s in open_}
            break
    taken, copies = collections.Counter(), collections.Counter()
    whole = {(i, s): t for i, t, s in TEXTS}
    for r in out.collect():
        taken[r.source] += size(r.text)
        copies[r.doc_id, r.source] += 1
        full = whole.get((r.doc_id, r.source))
        assert r.text in (full, " ".join((full or "").split()[: size(r.text)])) or r.doc_id is None
        assert r.n_chars == len(r.text)
    assert {s: taken[s] for s in names} == {s: int(limit[s]) for s in names}
    assert max(copies.values()) <= 6 and copies[6, "a"] == copies[7, None] == copies[8, "c"] == 0


def test_packing_stage(spark, odd, small):
    out = STAGES["best_fit_packing"](spark, odd, small).collect()
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t, _ in TEXTS:
        n = len(coder.encode(t or "", add_special_tokens=False).ids) + 1
        want.update((str(i), k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    assert collections.Counter((str(r.doc_id), r.piece, r.start, r.length) for r in out) == want
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_nothing(spark, odd, small, name):
    assert STAGES[name](spark, odd.filter("false"), small).count() == 0


def test_stages(spark, small):
    docs = read_table(spark, small, "documents")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, small), name)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids
        if name == "ngram_join":
            found = ngram_join.similarity_classes(docs)
            assert found.filter("set_id is not null and doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_votes_by_brute_force():
    """Every cosine one by one, on the fitted axes: the nearest labelled vectors and their weights give the score."""
    import pyarrow as pa

    texts = [prose(i, 40) if i % 3 else " ".join(f"{w}!!" for w in prose(i, 30).upper().split()) for i in range(80)] + ["", "x"]
    labels = np.array([float(i % 3 > 0 or i % 7 == 0) for i in range(80)])
    model = quality.Voters(quality.counts(pa.array(texts[:80])), labels)
    got = model.scores(quality.counts(pa.array(texts)))

    def vector(text):
        row = np.log1p(quality.counts(pa.array([text]))[0].astype(np.float64)) * model.weights
        shape, terms = row[: quality._SHAPE], row[quality._SHAPE :]
        shape, terms = (x / n if (n := np.linalg.norm(x)) else x for x in (shape, terms))
        out = np.concatenate((shape, quality.TERM_WEIGHT * terms)) @ model.axes.astype(np.float64)
        return out / n if (n := np.linalg.norm(out)) else out

    own = [vector(t) for t in texts]
    for text, mine, score in zip(texts, own, got, strict=True):
        cosines = [float(mine @ own[j]) for j in range(80)]
        near = sorted(range(80), key=lambda j: -cosines[j])[: quality.NEIGHBOURS]
        weights = [np.exp(quality.SHARPNESS * (cosines[j] - 1)) for j in near]
        want = sum(w * labels[j] for w, j in zip(weights, near, strict=True)) / sum(weights)
        if len(text) < 3:  # no trigram and no vector to speak of
            want = labels.mean() if not text else want
        edge = sorted(cosines)[-quality.NEIGHBOURS] - sorted(cosines)[-quality.NEIGHBOURS - 1]
        assert abs(score - want) < (1e-3 if edge > 1e-6 else 0.2), text
