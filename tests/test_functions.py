"""Golden cases of the text functions, labels and ranges."""

import time

from pyspark.sql import functions as F

from pageloom.functions.dates import document_date, xmp_date
from pageloom.functions.geometry import blend_rgb
from pageloom.functions.labels import format_label
from pageloom.functions.text import anywhere_hits, bounded_hits, bounded_spans, dehyphenate, needs_space, replace_bounded
from pageloom.operators.graph import chain_ends, reachable
from pageloom.operators.redact import expand_variants, matches_any_rule, merge_ranges, merged_ranges
from pageloom.operators.spans import apply_splices, literal_splices, merge_spans
from pageloom.plans import catalog

BOUNDED = [
    ("Frau Keller, Ärztin", "Keller", 1), ("Kellerei am Hang", "Keller", 0), ("Keller", "Keller", 1), ("(Keller)", "Keller", 1), ("Keller/Keller", "Keller", 2), ("Weinkeller Keller", "Keller", 1),
    ("Nr. 17-40-9", "40-9", 1), ("Nr. 417-40-95", "40-9", 0), ("ééKeller", "Keller", 0), ("Keller٣", "Keller", 0), ("Keller_", "Keller", 1), ("nana nan", "nana", 1), ("bo bobo bo", "bo", 2), ("b b b", "b b", 1), ("", "b", 0),
]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_bounded_hits(spark):
    for text, literal, hits in BOUNDED:
        assert one(spark, bounded_hits(F.col("t"), literal), t=text) == hits, (text, literal)
        assert len(one(spark, bounded_spans(F.col("t"), literal), t=text)) == hits
    assert one(spark, anywhere_hits(F.col("t"), "Keller"), t="Kellerei, Weinkeller Keller") == 2


def test_spans_and_replacement(spark):
    text = "zu Keller, Kellerei ü Keller"
    assert [tuple(s) for s in one(spark, bounded_spans(F.col("t"), "Keller"), t=text)] == [(3, 9), (22, 28)]
    assert one(spark, replace_bounded(F.col("t"), "Keller", "<A>"), t=text) == "zu <A>, Kellerei ü <A>"


def test_dehyphenate(spark):
    for text, expected in (("ab-\ncd ef-\ngh", "abcd efgh"), ("7\u2010 \t\n8", "78"), ("wait -\nfor it", "wait -\nfor it"), ("end.-\nnew", "end.-\nnew"), ("a-b\nc", "a-b\nc"), ("so\u00ad \nft", "soft")):
        assert one(spark, dehyphenate(F.col("t")), t=text) == expected


def test_labels(spark):
    cases = [("D", 7, "7"), ("D", -1, ""), ("r", 8, "viii"), ("r", 49, "xlix"), ("R", 444, "CDXLIV"), ("R", 2026, "MMXXVI"), ("R", 5001, "5001"), ("r", 0, ""), ("a", 3, "c"), ("A", 30, "DD"), ("a", 80, "bbbb"), ("x", 9, "")]
    rows = spark.createDataFrame(cases, "style string, n int, label string").withColumn("got", format_label(F.col("style"), F.col("n"))).collect()
    assert all(r["got"] == r["label"] for r in rows), rows


def test_long_labels_are_dealt_to_all_tasks(spark, small):
    labels = catalog.QUERIES["format_label"](spark, small).groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("label")).alias("letters"))
    letters = [r.letters for r in labels.collect()]
    assert max(letters) < sum(letters) / 3


def test_needs_space(spark):
    ask = lambda a, b, gap: one(spark, needs_space(F.col("a"), F.col("b"), F.col("g"), F.lit(5.0)), a=a, b=b, g=gap)
    assert ask("one", "two", 4.0) and not ask("one", "two", 3.4) and not ask("one ", "two", 9.0) and not ask("one", " two", 9.0)


def test_touching_ranges_merge(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 9), (1, 6, 7), (1, 12, 13)], "doc_id int, lo int, hi int")
    assert sorted((r.lo, r.hi) for r in merge_ranges(rows, ["doc_id"]).collect()) == [(0, 3), (5, 9), (12, 13)]


def test_ranges_are_cut_to_their_text(spark):
    rows = spark.createDataFrame([(1, -3, 2, 8), (1, 4, 4, 8), (1, 6, 11, 8), (1, 9, 12, 8)], "doc_id int, lo int, hi int, n int")
    assert sorted((r.lo, r.hi) for r in merge_ranges(rows, ["doc_id"]).collect()) == [(0, 2), (6, 8)]


def test_ranges_merge_inside_a_row(spark):
    cases = [([(5, 9), (0, 2), (2, 3), (6, 7), (12, 13)], 99, [(0, 3), (5, 9), (12, 13)]), ([(-3, 2), (4, 4), (6, 11), (9, 12)], 8, [(0, 2), (6, 8)]), ([(0, 9), (1, 2), (9, 10), (11, 12)], 50, [(0, 10), (11, 12)]), ([], 5, [])]
    rows = spark.createDataFrame([(i, r, n) for i, (r, n, _) in enumerate(cases)], "i int, r array<struct<lo:int,hi:int>>, n int")
    got = {x.i: [tuple(r) for r in x.m] for x in rows.select("i", merged_ranges(F.col("r"), F.col("n")).alias("m")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_dates(spark):
    ask = lambda f, t: one(spark, f(F.col("t")).cast("string"), t=t)
    for text, want in (("D:20310405060708Z", "2031-04-05 06:07:08"), ("D:203104050607", "2031-04-05 06:07:00"), ("D:2031040506", "2031-04-05 06:00:00"), ("D:20310405", "2031-04-05 00:00:00"), ("D:2031", None), ("20310405", None), ("D:20310431", None)):
        assert ask(document_date, text) == want, text
    for text, want in (("2031-04-05T06:07:08+05:00", "2031-04-05 06:07:08"), ("2031-04", "2031-04-01 00:00:00"), ("2031", "2031-01-01 00:00:00"), ("2031-4", None), ("", None),
        ("2031-04-05T06:07", "2031-04-05 06:07:00"), ("2031-04-05T06:07Z", None), ("2031-04-05T06:07+01:00", None), ("2031-04-05T06:07:08.25", "2031-04-05 06:07:08.25"), ("2031-04-05T06:07:08,5Z", "2031-04-05 06:07:08.5"),
        ("2031-04-05T06:07:08.1234567-03:30", "2031-04-05 06:07:08.123456"), ("2031-04-05T6:07:08", "2031-04-05 06:07:08"), ("2031-04-05T06:07:08 ", None), ("2031-04-05\n", None), ("2031-13-05", None)):
        assert ask(xmp_date, text) == want, text


def test_single_words(spark):
    hit = lambda w: one(spark, matches_any_rule(F.col("t"), ["Grete Ohm", "Li"], [r"^[0-9]{4}$"]), t=w)
    # Parts of a literal count from three bytes on, not from three characters.
    for word, want in (("Ül", True), ("Ohm", True), ("(Ül)", True), ("Ab", False), ("Ül.x", False)):
        assert one(spark, matches_any_rule(F.col("t"), ["Ül Ohm", "Ab Ohm"], []), t=word) == want, word
    assert one(spark, matches_any_rule(F.col("t"), ["li"], [], bounded=False), t="Alice") and not one(spark, matches_any_rule(F.col("t"), ["li"], []), t="Alice")
    assert [hit(w) for w in ("Grete", "(Ohm),", "Li", "Li-An", "Lisa", "2031", "20312", "Gretel")] == [True, True, True, True, False, True, False, False]


def test_colours(spark):
    mix = lambda mode, b, s: [round(x, 4) for x in spark.range(1).select(blend_rgb(mode, F.array(*map(F.lit, b)), F.array(*map(F.lit, s))).alias("c")).first()["c"]]
    assert mix("Luminosity", (0.2, 0.2, 0.2), (1.0, 1.0, 1.0)) == [1.0, 1.0, 1.0]
    assert mix("Color", (0.5, 0.5, 0.5), (1.0, 0.0, 0.0)) == [1.0, 0.2857, 0.2857]
    assert mix("Hue", (0.4, 0.4, 0.4), (1.0, 0.0, 0.0)) == [0.4, 0.4, 0.4]


def test_chains_of_links(spark):
    links = [(i, i + 1) for i in range(9)] + [(9, None), (20, 21), (21, 20), (30, 99)]
    got = {r.src: (r.end, r.steps) for r in chain_ends(spark.createDataFrame(links, "src int, dst int"), 8).collect()}
    assert got == {i: (9, 9 - i) if i > 0 else (None, None) for i in range(10)} | {20: (None, None), 21: (None, None), 30: (None, None)}


def test_ended_links_do_not_meet(spark, tmp_path):
    """Links that have ended, and those that lead nowhere, aren't joined on a place that they don't have: one task would get them all."""
    n = 4000
    links = spark.range(n).selectExpr("id AS src", "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 4 = 1 THEN id - 1 ELSE -id END AS dst")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ends = chain_ends(links, 4)
        got = {r.src: (r.end, r.steps) for r in ends.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (i, 0) if i % 2 == 0 else (i - 1, 1) if i % 4 == 1 else (None, None) for i in range(n)}
    plan = ends._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") > 2  # ended links stay where they were written


def test_colours_of_tables(spark):
    """Rows of all kinds as the column gives them, without an interpreted lambda."""
    from pageloom.functions.geometry import blended_rgb

    colours = [(0.2, 0.2, 0.2), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.9, 0.95, 0.1), (1.2, -0.3, 0.5), (None, 0.1, 0.4)]
    rows = spark.createDataFrame([(i, list(b), list(s)) for i, (b, s) in enumerate((b, s) for b in colours for s in colours)], "i int, b array<double>, s array<double>")
    mixed = blended_rgb(rows, "b", "s", ["i"])
    assert "lambda" not in mixed._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.i, r.mode): [r.c0, r.c1, r.c2] for r in mixed.collect()}
    for mode in ("Hue", "Saturation", "Color", "Luminosity"):
        want = {r.i: r.c for r in rows.select("i", blend_rgb(mode, F.col("b"), F.col("s")).alias("c")).collect()}
        assert all(got[i, mode] == c for i, c in want.items())
    assert len(got) == 4 * len(colours) ** 2


def test_whole_numbers(spark):
    """As ``round`` has them, without its decimals."""
    from pageloom.functions.geometry import nearest_whole

    values = [0.0, -0.0, 0.49999999999999994, 0.5, -0.5, 1.5, 2.5, -2.5, -0.2, 1e15 + 0.5, 2.0**52 - 0.5, 2.0**53, -(2.0**60), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(nearest_whole(F.col("x")).alias("n"), F.round("x").cast("long").alias("r")).collect()
    assert [r.n for r in rows] == [r.r for r in rows] and rows[2].n == 0


def test_variants(spark):
    rows = spark.createDataFrame([(1, "a b-c"), (2, "a b"), (3, "a b")], "rule_id int, literal string")
    got = expand_variants(rows).collect()
    assert len({r.spelling for r in got}) == len(got) == 8
    assert {r.rule_id for r in got if r.spelling == "a b"} == {2}


def test_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.node for r in reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b", "c"}


def test_splices_keep_tokens_apart(spark):
    cases = [
        ("ab cd", [(3, 5, "X")], "ab X"), ("abcd", [(1, 3, "X")], "a X d"), ("a(b)c", [(2, 3, "X")], "a(X)c"), ("abcd", [(1, 3, "")], "a d"), ("abcd", [(0, 4, "")], ""), ("abcd", [(2, 4, "Y"), (0, 2, "X")], "X Y"),
        ("abcd", [(0, 3, "X"), (2, 4, "Y")], None), ("abcd", [(2, 5, "X")], None), ("abcd", [(3, 2, "X")], None), ("abcd", [], "abcd"), ("", [], ""), ("a b", [(1, 1, "/N")], "a/N b"), (None, [(0, 1, "X")], None),
    ]
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, t string, s array<struct<lo:int,hi:int,new:string>>")
    got = {r.i: r.out for r in rows.select("i", apply_splices(F.col("t"), F.col("s")).alias("out")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_splices_of_a_long_text_take_time_in_proportion(spark):
    text = "bänder an " * 60_000
    spliced = apply_splices(F.col("t"), literal_splices(F.col("t"), "an", "X"))
    began = time.time()
    got = spark.createDataFrame([(text,), (None,), ("anan",), ("",)], "t string").select(spliced.alias("out")).collect()
    assert [r.out for r in got] == ["bänder X " * 60_000, None, "X X", ""] and time.time() - began < 30


def test_spans_of_one_style_merge(spark):
    rows = [(1, 0, "a", "x", False, 0.0, False), (1, 1, "b", "x", False, 0.0, False), (1, 2, "c", "x", True, 0.0, False), (1, 3, None, "x", True, 0.0, False), (1, 4, "e", "y", True, 0.0, False), (1, 5, "f", "y", True, 2.0, False), (1, 6, "g", "y", True, 0.0, False)]
    rows += [(2, 0, "h", "y", True, 0.0, True), (2, 1, "i", "y", True, 0.0, False), (None, 0, "j", None, False, None, None), (None, 1, "k", None, False, None, None)]
    spans = spark.createDataFrame(rows, "doc int, ord int, text string, style string, inserted boolean, gap double, line_break boolean")
    got = [(r.doc, r.ord, r.text) for r in merge_spans(spans, ["doc"]).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, "ab"), (1, 2, "c"), (1, 4, "e"), (1, 5, "f"), (1, 6, "g"), (2, 0, "h"), (2, 1, "i"), (None, 0, "jk")], key=repr)
