"""Golden cases of folds, chains, lines, paragraphs, wrapping and joined readings."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions.folds import bisect, heads_where, running_sums, runs_at, scan
from pageloom.functions.text import anywhere_spans, bounded_spans
from pageloom.operators.chains import chain_ranges, chain_text, chained, chains, grouped_lines, page_text, paragraph_numbers, wrapped
from pageloom.operators.reading import hit_ranges, joined_reading, reading_hits, replace_in_spans, span_pieces, to_flat, to_reading

RUNS = "doc_id int, page int, runs array<struct<ln:int,wn:int,text:string,x:double,y:double,width:double,size:double,space_w:double>>"


def run(place, text, x, y, size=10.0):
    return (place, 0, text, float(x), float(y), 5.0 * len(text), size, 5.0)


def page(spark, *pages):
    """Pages of (text, x, y) in drawing order."""
    return spark.createDataFrame([(d, 0, [run(i, *r) for i, r in enumerate(found)]) for d, found in enumerate(pages)], RUNS)


def texts(spark, *found):
    return [r.t for r in chains(page(spark, found)).orderBy("chain").select(chain_text(F.col("runs")).alias("t")).collect()]


def test_folds(spark):
    numbers = list(range(1, 700))
    rows = spark.createDataFrame([(0, numbers), (1, []), (2, None), (3, [5])], "i int, a array<int>")
    got = {r.i: (r.s, r.h) for r in rows.select("i", running_sums(F.col("a")).alias("s"), runs_at(F.col("a"), heads_where(F.col("a"), lambda x, i: i % 300 == 0)).alias("h")).collect()}
    assert got[0][0] == [n * (n + 1) // 2 for n in numbers] and [len(x) for x in got[0][1]] == [300, 300, 99]
    assert got[1] == ([], []) and got[3] == ([5], [[5]])
    last = scan(F.col("a"), F.lit(None).cast("int"), lambda s, x: F.struct(x.alias("state"), s.alias("out")), "int")
    assert rows.filter("i = 0").select(last.alias("s")).first().s == [None, *numbers[:-1]]
    for n in (0, 1, 2, 7, 8, 699):
        below = [r.b for r in spark.range(n + 1).select(bisect(F.lit(n), lambda i: i < F.col("id")).alias("b")).collect()]
        assert below == list(range(n + 1))


def test_spans_of_long_texts(spark):
    text = "nan na " * 400 + "na"
    row = spark.createDataFrame([(text, "na")], "t string, l string").select(bounded_spans(F.col("t"), "na").alias("a"), bounded_spans(F.col("t"), F.col("l")).alias("b"), anywhere_spans(F.col("t"), F.col("l")).alias("c")).first()
    assert row.a == row.b and [s.lo for s in row.a] == [7 * i + 4 for i in range(400)] + [2800] and len(row.c) == 801
    odd = r"a\Eb.(" 
    assert spark.createDataFrame([("x " + odd + " y", odd)], "t string, l string").select(bounded_spans(F.col("t"), F.col("l")).alias("a")).first().a[0].lo == 2


@pytest.mark.parametrize(
    "found,want",
    [
        ([("gar-", 0, 0), ("den", 0, 14), ("wall", 20, 14)], ["garden wall"]),
        ([("gar", 0, 0), ("-", 15, 0), ("den", 0, 14)], ["garden"]),
        # A hyphen inside a line stays, though the next run lies a little lower.
        ([("gar-", 0, 0), ("den", 20, 0.4)], ["gar-den"]),
        ([("see", 0, 0), ("sub-", 19, 0), ("net", 39, 0.4), ("now", 58, 0)], ["see sub-net now"]),
        ([("gar-", 0, 0), ("den", 60, 0)], ["gar-", "den"]),  # far ahead on the same line
        ([("gar-", 0, 0), ("den", 0, 25)], ["garden"]),
        ([("gar-", 0, 0), ("den", 0, 26)], ["gar-", "den"]),
        ([("gar-", 0, 14), ("den", 0, 0)], ["gar-", "den"]),  # upwards
        ([("4-", 0, 0), ("2", 0, 14)], ["42"]),
        ([("gar -", 0, 0), ("den", 0, 14)], ["gar -", "den"]),
        ([("gar-", 0, 0), ("(den", 0, 14)], ["gar-", "(den"]),
        ([("-", 0, 0), ("den", 0, 14)], ["-", "den"]),
        ([("gar", 0, 0), ("-", 25, 0), ("den", 0, 14)], ["gar -", "den"]),
        ([("a­", 0, 0), ("b‐", 0, 14), ("c", 0, 28)], ["abc"]),
        ([("one", 0, 0), ("two", 15, 0), ("", 30, 0), ("six", 34, 0)], ["onetwo six"]),
        ([("one", 0, 0), ("two", 9, 0)], ["one", "two"]),  # back by more than half a size
        ([("one", 0, 0, 0.0), ("two", 16, 0, 0.0)], ["one", "two"]),  # no size at all
        ([], []),
    ],
)
def test_chains(spark, found, want):
    assert texts(spark, *found) == want


def test_hits_of_chains_go_back_to_their_runs(spark):
    pages = page(spark, [("gar", 0, 0), ("-", 15, 0), ("den", 0, 14), ("wall", 19, 14)])
    assert [(r.lo, r.hi, r.cut) for r in pages.select(F.inline(chained(F.col("runs")))).collect()] == [(0, 3, 0), (3, 3, 1), (3, 6, 0), (7, 11, 0)]
    ask = lambda lo, hi: [tuple(x)[0:1] + tuple(x)[2:] for x in chains(pages).select(chain_ranges(F.col("runs"), F.lit(lo), F.lit(hi)).alias("r")).first().r]
    assert ask(0, 6) == [(0, 0, 3), (1, 0, 1), (2, 0, 3)]  # the hyphen goes with its word
    assert ask(1, 2) == [(0, 1, 2)] and ask(4, 9) == [(2, 1, 3), (3, 0, 2)] and ask(6, 7) == []
    assert pages.select(page_text(F.col("runs")).alias("t")).first().t == "gar\n-\nden\nwall"
    assert page(spark, [("gar-", 0, 0)]).select(page_text(F.col("runs")).alias("t")).first().t == "gar-"


def test_lines_keep_the_first_baseline(spark):
    """A line ends at a step of half a point from its FIRST run; runs of a line are put from left to right."""
    got = sorted(grouped_lines(page(spark, [("c", 20, 0.0), ("a", 0, 0.4), ("b", 10, 0.4), ("d", 0, 0.5), ("e", 5, 0.9), ("f", 0, 1.0)])).collect(), key=lambda r: r.ln)
    assert [(r.line, r.place) for r in got] == [(0, 2), (0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert [r.line for r in grouped_lines(page(spark, [("a", 0, 0), ("b", 0, 0.5), ("c", 0, 1.0)])).orderBy("ln").collect()] == [0, 1, 2]


def test_paragraphs_keep_edge_size_and_leading(spark):
    def numbers(*lines):
        row = spark.createDataFrame([([(float(x), float(y), float(s)) for x, y, s in lines],)], "l array<struct<x:double,y:double,size:double>>")
        return row.select(paragraph_numbers(F.col("l")).alias("p")).first().p

    assert numbers((60, 100, 11), (60, 114, 11), (60, 128, 11)) == [0, 0, 0]
    assert numbers((60, 100, 11), (60, 114, 15)) == numbers((60, 100, 11), (200, 114, 11)) == numbers((60, 100, 11), (60, 200, 11)) == numbers((60, 100, 11), (60, 99, 11)) == [0, 1]
    assert numbers((60, 100, 11), (60, 114, 11), (60, 140, 11), (60, 154, 11)) == [0, 0, 1, 1]
    assert numbers((60, 0, 11), (60, 14, 11), (60, 28.5, 11), (60, 43.5, 11), (60, 59.1, 11)) == [0, 0, 0, 0, 1]  # each step within half a point of the last
    assert numbers((0, 0, 0), (0, 9, 0)) == [0, 1] and numbers() == []


def test_wrapping(spark):
    rows = spark.createDataFrame([(["aa", "bb", "c", "dddddd", "e"],), ([],)], "w array<string>")
    assert [r.l for r in rows.select(wrapped(F.col("w"), 5).alias("l")).collect()] == [["aa bb", "c", "dddddd", "e"], []]


SPANS = "spans array<struct<text:string,style:string,inserted:boolean,line_break:boolean,gap:double>>"


def paragraph(spark, *spans):
    """Spans of (text, style); a style of None with a space is a line break."""
    return spark.createDataFrame([([(t, s or "p", False, s is None, 0.0) for t, s in spans],)], SPANS)


def replaced(spark, spans, literal, token, **how):
    r = paragraph(spark, *spans).select(replace_in_spans(F.col("spans"), literal, token, **how).alias("r")).first().r
    return r.hits, [(s.text, s.style, s.inserted) for s in r.spans]


BREAK = (" ", None)


def test_readings_join_broken_words(spark):
    read = lambda *spans: paragraph(spark, *spans).select(joined_reading(F.col("spans")).alias("r")).first().r
    r = read(("to Lund-", "p"), BREAK, ("berg now", "p"))
    assert (r.text, r.flat) == ("to Lundberg now", "to Lund- berg now") and [tuple(s) for s in r.segments] == [(0, 0, 7), (7, 9, 17)]
    assert read(("Nr. 17-", "p"), ("40 b", "p")).text == "Nr. 17-40 b"  # no break, no joining
    assert read(("see -", "p"), BREAK, ("next", "p")).text == "see - next" and read(("end-", "p"), BREAK, ("(x)", "p")).text == "end- (x)"
    assert read(("Lund", "p"), ("-", "q"), BREAK, ("berg", "p")).text == "Lund- berg"  # a hyphen that is a span of its own
    assert read(("Lund-", "p"), ("", None), ("", "q"), ("berg", "p")).text == "Lundberg" and read(BREAK, ("a", "p")).text == " a" and read().text == ""
    pages = paragraph(spark, ("to Lund-", "p"), BREAK, ("berg now", "p")).select(joined_reading(F.col("spans")).alias("r"))
    there = [x.a for x in pages.select(F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i"), "r").select(to_flat(F.col("r.segments"), F.col("i")).alias("a")).collect()]
    assert there == [*range(7), *range(9, 17)]
    back = [x.a for x in pages.select(F.explode(F.sequence(F.lit(0), F.lit(16))).alias("i"), "r").select(to_reading(F.col("r.segments"), F.col("i")).alias("a")).collect()]
    assert back == [*range(7), 7, 7, *range(7, 15)]
    hit = pages.select("r", F.explode(reading_hits(F.col("r"), "Lundberg")).alias("h"))
    assert [tuple(x) for x in hit.select(F.inline(span_pieces(F.col("r.starts"), F.col("h.lo"), F.col("h.hi")))).collect()] == [(0, 3, 8), (1, 0, 1), (2, 0, 4)]


def test_hits_of_many_paragraphs_are_placed_at_once(spark):
    texts = ["", "to Lund\u2011", "b\u00e9rg x", "-", None, "x", "Lund-", "xx x", "7\u00ad", "\u00e9"]
    draw, rows = random.Random(3), []
    for i in range(400):
        spans = [(draw.choice(texts), "p", False, draw.choice([False, None]), 0.0) if draw.random() < 0.6 else (draw.choice([" ", "", None]), "p", False, True, 0.0) for _ in range(draw.randrange(10))]
        rows.append((i, spans))
    pages = spark.createDataFrame([*rows, (400, None)], f"i int, {SPANS}").repartition(2)
    for literal, bounded in (("x", True), ("x", False), ("Lundb\u00e9rg", True), ("dx", False)):
        hits = pages.select("i", joined_reading(F.col("spans")).alias("r")).select("i", "r.starts", F.explode(reading_hits(F.col("r"), literal, bounded)).alias("h"))
        each = hits.select("i", F.col("h.lo").alias("hit"), F.inline(span_pieces(F.col("starts"), F.col("h.lo"), F.col("h.hi"))))
        want = sorted(map(tuple, each.collect()))
        assert want == sorted(map(tuple, pages.select("i", F.inline(hit_ranges(F.col("spans"), literal, bounded))).collect())) and want


def test_replacement_keeps_styles(spark):
    assert replaced(spark, [("to Lund-", "p"), BREAK, ("berg now", "q")], "Lundberg", "[N]") == (1, [("to ", "p", False), ("[N]", "p", True), (" now", "q", False)])
    # Over three spans: what is put in has the style of the first character it replaces.
    assert replaced(spark, [("a Lu", "p"), ("nd", "b"), ("berg, b", "i")], "Lundberg", "[N]") == (1, [("a ", "p", False), ("[N]", "p", True), (", b", "i", False)])
    assert replaced(spark, [("Nr. CH", "p"), ("-29 x", "b")], "CH29", "[N]") == (0, [("Nr. CH", "p", False), ("-29 x", "b", False)])
    assert replaced(spark, [("Lundbergs ", "p"), ("Lundberg", "b")], "Lundberg", "") == (1, [("Lundbergs ", "p", False)])
    assert replaced(spark, [("Lundbergs ", "p"), ("Lundberg", "b")], "Lundberg", "X", bounded=False) == (2, [("X", "p", True), ("s ", "p", False), ("X", "b", True)])
    assert replaced(spark, [("x x", "p"), (" x", "p")], "x", "y") == (3, [("y", "p", True), (" ", "p", False), ("y", "p", True), (" ", "p", False), ("y", "p", True)])
    # Spans of one style merge, a break is a space like others, once something is replaced; else all stays.
    assert replaced(spark, [("a", "p"), BREAK, ("b", "p"), (" c", "p")], "c", "d") == (1, [("a b ", "p", False), ("d", "p", True)])
    assert replaced(spark, [("a", "p"), BREAK, ("b", "p")], "c", "d") == (0, [("a", "p", False), (" ", "p", False), ("b", "p", False)])
    assert replaced(spark, [], "c", "d") == (0, [])


def test_chains_of_a_batch_are_those_of_its_pages(spark):
    """Pages of all lengths beside each other, null and empty ones among them: each has the chains that it has alone.

    Folds inside the row asked one run after the other; those of a batch are now asked together."""
    words = ["tion-", "on", "-", "a", "b\u00a0", "", "d-", "E\u0301t", "\U0001d4d0-", "9"]
    run = lambda i: (i // 3, i, words[i * 7 % 10], float(i * 13 % 40), 14.0 * (i // 3), 5.0 * (i % 4), [10.0, 0.0, None, 10.0][i % 4], [5.0, 0.0, None][i % 3])
    pages = [None, *([run(i + n) for i in range(n)] for n in (0, 1, 2, 40, 0, 3, 100))]
    schema = "doc_id int, page int, runs array<struct<ln:int,wn:int,text:string,x:double,y:double,width:double,size:double,space_w:double>>"
    rows = [(i, 0, p) for i, p in enumerate(pages)]
    alone = [tuple(r) for row in rows for r in chains(spark.createDataFrame([row], schema)).collect()]
    together = [tuple(r) for r in chains(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert alone == together and {r[0] for r in together} == {2, 3, 4, 6, 7}
    got = spark.createDataFrame(rows, schema).coalesce(1).select(chained(F.col("runs")).alias("c")).collect()
    assert got[0].c is None and got[1].c == [] and [r for c in got if c.c for r in c.c] == [x for r in together for x in r[3]]


def test_chains_of_texts_stay_in_one_step(spark):
    """Rows made of laid out texts are those of the column forms, and runs leave no task: nothing but the rows goes back to Spark."""
    from pageloom.operators.chains import chain_hits, chain_rows, page_texts
    from pageloom.plans.catalog import QUERIES
    from pageloom.sources.tables import page_runs

    rng = random.Random(11)
    word = lambda: rng.choice(["ti-\non", "tion", "tiontion", "na-", "-", "- \non", "a.", "b,", "\n", "", "😀tion", "ti- on", "é­\non", "\n" * 60])
    found = [(i, " ".join(word() for _ in range(rng.randrange(90)))) for i in range(60)] + [(90, ""), (91, None), (92, "\n"), (93, "tion")]
    docs = spark.createDataFrame(found, "doc_id int, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    cut = chains(page_runs(docs)).cache()
    joined = F.size(F.filter("runs", lambda r: r["joined"])).cast("long")
    assert rows(chain_rows(docs)) == rows(cut.select("doc_id", "page", "chain", chain_text(F.col("runs")), joined)) != []
    hits = cut.select("doc_id", "page", "runs", F.explode(anywhere_spans(chain_text(F.col("runs")), "tion")).alias("h"))
    assert rows(chain_hits(docs, "tion")) == rows(hits.select("doc_id", "page", F.inline(chain_ranges(F.col("runs"), F.col("h.lo"), F.col("h.hi"))))) != []
    assert rows(page_texts(docs)) == rows(page_runs(docs).filter(F.size("runs") > 0).select("doc_id", "page", page_text(F.col("runs"))))
    cut.unpersist()
    for name in ("build_chains", "hyphenated_chains", "chain_map_back", "page_text"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "Generate" not in plan, name


def test_many_paragraphs_are_replaced_in_at_once(spark):
    """As letter by letter; no fold runs over a paragraph's spans."""
    draw, rows = random.Random(8), []
    texts = ["", "to Lund‐", "bérg x", "-", None, "x", "Lund-", "xx x", "7­", "é", "😀x", "Lundbérg"]
    for i in range(500):
        span = lambda: (draw.choice(texts) if draw.random() < 0.6 else draw.choice([" ", "", None]), draw.choice(["p", "q", None]), draw.choice([True, False, False, None]), draw.choice([True, False, None]), draw.choice([0.0, 2.0, None]))
        rows.append((i, [span() for _ in range(draw.randrange(12))], draw.choice(["x", "Lundbérg", "none", "dx", None]), draw.choice(["", "[é😀]", None])))
    rows.append((500, None, "x", "y"))
    pages = spark.createDataFrame(rows, f"i int, {SPANS}, l string, t string").repartition(2)

    def by_letters(spans, hits, token):
        if not hits:
            return [tuple(s) for s in spans]
        letters, out, at = [(c, k) for k, s in enumerate(spans) for c in s.text or ""], [], 0
        ends = [sum(len(s.text or "") for s in spans[: k + 1]) for k in range(len(spans))]
        while at < len(letters):
            hit = next((h for h in hits if h.lo == at), None)
            k = letters[at][1]
            if hit:
                piece, at = (token or "", spans[k].style, True, False), hit.hi
            else:
                to = min([h.lo for h in hits if h.lo > at] + [ends[k]])
                piece = ("".join(c for c, _ in letters[at:to]), spans[k].style, bool(spans[k].inserted), bool(spans[k].line_break) and at == 0 and to == ends[k])
                at = to
            if piece[0] and out and out[-1][1:] == piece[1:] and not piece[3]:
                out[-1] = (out[-1][0] + piece[0], *piece[1:])
            elif piece[0]:
                out.append(piece)
        return [(*p, 0.0) for p in out]

    for bounded in (True, False):
        got = pages.withColumn("k", joined_reading(F.col("spans"))).select("*", reading_hits(F.col("k"), F.col("l"), bounded).alias("h"), replace_in_spans(F.col("spans"), F.col("l"), F.col("t"), bounded).alias("r")).collect()
        assert sum(r.r.hits for r in got) > 10
        for r in got:
            assert r.r.hits == len(r.h)
            assert (None if r.spans is None else by_letters(r.spans, r.h, r.t)) == (None if r.r.spans is None else [tuple(s) for s in r.r.spans]), r
        same = pages.filter("l = 'x'").select("i", replace_in_spans(F.col("spans"), "x", "yy", bounded).alias("r"))
        column = pages.filter("l = 'x'").select("i", replace_in_spans(F.col("spans"), F.col("l"), F.lit("yy"), bounded).alias("r"))
        assert sorted(map(repr, same.collect())) == sorted(map(repr, column.collect()))
    assert "aggregate(" not in same._jdf.queryExecution().executedPlan().toString()
