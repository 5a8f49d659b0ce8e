"""Golden cases of rule tables, publication, trees, boxes, numbering, layers and sampled functions."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions.sampled import exponential, interpolated, normalized, stitched, unpacked
from pageloom.operators.boxes import annotation_box, box_join, kept_annotations, places_met
from pageloom.operators.numbering import merge_objects, numbered
from pageloom.operators.publish import publish, published, publisher
from pageloom.operators.rules import redacted, rule_spans, waiting
from pageloom.operators.trees import field_names, in_order, inherited, structure, structure_lines, structure_outline
from pageloom.operators.visibility import layer_states, membership_states
from pageloom.sources.scratch import setting, written

NBSP, SHY = " ", "­"


def test_rule_tables(spark):
    texts = ["Keller met Kellerei", f"Grete{NBSP}Ohm, Grete Ohm", f"an Alt{SHY}Dorf, Alt-Dorf", "Alt-Dorfer", "(x) x", "", None, "nan nana nan", "oo", "the the the", "ab", "abc"]
    rules = [(1, "Keller"), (2, "Grete Ohm"), (3, "Alt-Dorf"), (4, "(x)"), (5, ""), (6, "nan"), (7, "oo"), (8, "Grete Ohm"), (9, "absent Keller"), (10, None), (11, "the the"), (12, "b")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    table = spark.createDataFrame(rules, "rule_id int, literal string")
    got = sorted((r.doc_id, r.rule_id, r.lo, r.hi) for r in rule_spans(docs, table).collect())
    assert got == [(0, 1, 0, 6), (1, 2, 0, 9), (1, 2, 11, 20), (2, 3, 3, 11), (2, 3, 13, 21), (4, 4, 0, 3), (7, 6, 0, 3), (7, 6, 9, 12), (8, 7, 0, 2), (9, 11, 0, 7)]
    anywhere = sorted((r.doc_id, r.rule_id, r.lo) for r in rule_spans(docs, table, bounded=False, variants=False).collect())
    assert anywhere == [(0, 1, 0), (0, 1, 11), (1, 2, 11), (2, 3, 13), (3, 3, 0), (4, 4, 0), (7, 6, 0), (7, 6, 4), (7, 6, 9), (8, 7, 0), (9, 11, 0), (10, 12, 1), (11, 12, 1)]
    cut = {r.doc_id: r.text for r in redacted(docs, rule_spans(docs, table), "#").collect()}
    assert cut[0] == "# met Kellerei" and cut[1] == "#, #" and cut[4] == "# x" and cut[6] is None and cut[5] == "" and cut[3] == texts[3]
    assert rule_spans(docs, table.filter("false")).count() == 0 and rule_spans(docs.filter("false"), table).count() == 0


def test_texts_meet_only_literals_that_stand_in_them(spark):
    """Literals of a text's own words in another order were looked for in all of its texts: these took the time and the disk."""
    words = "of the and to in was with for".split()
    orders = [f"{a} {b} {c}" for a in words for b in words for c in words]
    long = "x" * 70
    spellings = spark.createDataFrame([*enumerate([*orders, long + "y", long + "z"])], "rule_id int, spelling string")
    texts = spark.createDataFrame([(i, f"é {w} {i % 3} " * 40 + f"{orders[i]}é{orders[i + 9][1:]}" + long * (i == 7)) for i, w in enumerate(words * 4)], "doc_id int, text string")
    met = {(r.doc_id, r.spelling) for r in waiting(texts, spellings).collect()}
    there = {(d, s) for d, t in map(tuple, texts.collect()) for _, s in map(tuple, spellings.collect()) if s in t}
    # Literals that only differ beyond the key's bytes come together, and are told apart afterwards.
    assert there <= met and len(met - there) <= 4 and (7, long + "y") in met and (7, long + "y") not in there


def test_copies_of_boxes_and_areas_make_no_pairs(spark):
    """2,000 copies of a box in 2,000 of an area were 4 million pairs."""
    sides = "x0 double, y0 double, x1 double, y1 double"
    boxes = [(i, 0, 10.0, 10.0, 20.0, 20.0) for i in range(2000)] + [(2000, 0, 35.0, 10.0, 45.0, 20.0), (2001, 1, 10.0, 10.0, 20.0, 20.0), (2002, 0, None, 10.0, 20.0, 20.0)]
    areas = [(i, 0, 0.0, 0.0, 40.0, 40.0) for i in range(7, 2007)] + [(3, 0, 19.0, 0.0, 900.0, 900.0), (1, 0, 20.0, 0.0, 30.0, 30.0), (2, 0, 5.0, 5.0, 5.0, 50.0)]
    met = places_met(spark.createDataFrame(boxes, f"id int, page int, {sides}"), spark.createDataFrame(areas, f"n int, page int, {sides}"), ["page"], "n")
    assert {(r.x0, r.n_areas, r.n_whole, r.first_area) for r in met.collect()} == {(10.0, 2001, 2000, 3), (35.0, 2001, 1, 3)}
    assert met.count() == 2


def test_places_are_counted_without_pairs(spark):
    """3,000 places, each its own, meet a third of 3,000 areas: they were millions of pairs."""
    rng = random.Random(5)
    sides = "x0 double, y0 double, x1 double, y1 double"
    number = lambda: float(rng.choice([rng.randrange(-40, 40), rng.random() * 60]))
    box = lambda w: (x := number(), y := number(), x + rng.choice([0, 1, w, w * rng.random()]), y + rng.choice([0, 2, w]))
    boxes = [(i, rng.choice([0, 1, None]), *box(9)) for i in range(300)] + [(i, 0, 1e300, 0.0, 1e301, 1.0) for i in range(2)]
    areas = [(i if i % 7 else None, rng.choice([0, 1, 2, None]), *box(30)) for i in range(200)]
    want = {}
    for _, page, *b in boxes:
        met = [(n, a) for n, p, *a in areas if p == page is not None and b[0] < a[2] and a[0] < b[2] and b[1] < a[3] and a[1] < b[3] and a[0] < a[2] and a[1] < a[3]]
        if met:
            want[page, *b] = (len(met), sum(a[0] <= b[0] and a[1] <= b[1] and b[2] <= a[2] and b[3] <= a[3] for _, a in met), min((n for n, _ in met if n is not None), default=None))
    left, right = spark.createDataFrame(boxes, f"id int, page int, {sides}"), spark.createDataFrame(areas, f"n int, page long, {sides}")
    for most in (1 << 16, 37):
        got = places_met(left, right, ["page"], "n", places_at_once=most, areas_at_once=most + 3)
        assert {tuple(r)[:5]: tuple(r)[5:] for r in got.collect()} == want
    many = spark.range(3000).selectExpr("0 AS page", "id % 60 AS x0", "id / 3000 AS y0", "id % 60 + 9 AS x1", "id / 3000 + 1 AS y1", "id AS n")
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert places_met(many, many, ["page"], "n").agg(F.sum("n_areas")).first()[0] == sum(50 * 50 for i in range(60) for j in range(60) if abs(i - j) < 9)
    store = spark._jsparkSession.sharedState().statusStore()
    runs = [store.executionsList().apply(k) for k in range(before, store.executionsList().size())]
    rows = [int(n.replace(",", "")) for r in runs for m in [store.executionMetrics(r.executionId())] for i in range(r.metrics().size()) if r.metrics().apply(i).name() == "number of output rows" and m.contains(r.metrics().apply(i).accumulatorId()) for n in [m.apply(r.metrics().apply(i).accumulatorId())]]
    assert rows and max(rows) <= 3000


def test_runs_meet_their_areas_where_they_are_laid_out(spark, monkeypatch):
    """The rows of the join on tiles, without a written or dealt run."""
    from pageloom.operators import boxes as B
    from pageloom.sources import tables as T
    from pageloom.sources.tables import runs

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "\n".join(" ".join("wort" * rng.randrange(4) for _ in range(9)) for _ in range(rng.randrange(130)))) for i in range(12)] + [(20, None), (21, "")], "doc_id long, text string")
    side = lambda: (x := rng.randrange(0, 90) * 2.5, y := rng.randrange(0, 700) * 1.1, x + rng.choice([0, 40, 500]), y + rng.choice([-3, 20, 4000]))
    rows = [(rng.choice([0, 1, 2, 5, 20, 21, 99, None]), rng.choice([0, 1, 2, 3, -1, None]), *side()) for _ in range(300)] + [(1, 0, None, 0.0, 9.0, 9.0), (1, 0, float("nan"), 0.0, 9.0, 9.0)]
    areas = spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    boxes = runs(docs).selectExpr("doc_id", "page", "ln", "wn", "x AS x0", "y - 7.5D AS y0", "x + width AS x1", "y + 2.5D AS y1")
    want = sorted((r.doc_id, r.page, r.box_ln, r.box_wn, r.whole) for r in box_join(boxes, areas, ["doc_id", "page"]).collect())
    monkeypatch.setattr(B, "BESIDE", 7)
    names = []
    monkeypatch.setattr(B, "written", lambda df, name: names.append(name))
    assert sorted(map(tuple, B.run_marks(docs, areas).collect())) == want != [] and not names
    # The same from small parts and few pairs at a time.
    monkeypatch.setattr(T, "PART", 100)
    monkeypatch.setattr(B, "PAIRS", 50)
    lists = areas.filter("page is not null and x0 < x1 and y0 < y1").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("page").cast("long").alias("page"), "x0", "y0", "x1", "y1")).alias("areas"))
    batches = docs.filter("text is not null").join(lists, "doc_id").toArrow().combine_chunks().to_batches()
    columns = ["doc_id", "page", "ln", "wn", "whole"]
    assert sorted(tuple(r[c] for c in columns) for b in T._parts(B._marks, columns[2:], ("areas",))(batches) for r in b.to_pylist()) == want


def test_only_proven_documents_are_published(spark, tmp_path):
    folder = str(tmp_path / "out")
    rules = spark.createDataFrame([(1, "Keller"), (2, "Grete Ohm")], "rule_id int, literal string")
    rows = [(1, "<A> was here", ["<A>"]), (2, "Keller stayed", None), (3, "a Kel-\nler, broken", None), (4, "Kellerei is another word", None), (5, "nothing", ["<A>", "<B>"]), (6, f"Grete{NBSP}Ohm", ["<A>"]), (7, None, None)]
    out = spark.createDataFrame(rows, "doc_id int, text string, tokens array<string>")
    told = {r.doc_id: (r.reasons, r.proven) for r in publish(out, rules, folder, "7").collect()}
    assert told == {1: ([], True), 2: (["residue:1"], False), 3: (["residue:1"], False), 4: ([], True), 5: (["missing:<A>", "missing:<B>"], False), 6: (["missing:<A>", "residue:2"], False), 7: ([], True)}
    assert sorted(r.doc_id for r in published(spark, folder).collect()) == [1, 4]  # a null text has no digest to show
    # A batch that counts isn't done again; one that died before its manifest is.
    again = publish(out.filter("doc_id = 2"), rules, folder, "7")
    assert again.count() == 7
    out.filter("doc_id = 4").write.parquet(f"{folder}/staged/batch=8")
    assert {r.doc_id for r in published(spark, folder).collect()} == {1, 4}
    each = publisher(lambda batch: batch, rules, folder)
    each(out.filter("doc_id in (2, 4)").withColumn("doc_id", F.col("doc_id") + 10), 8)
    assert sorted((r.batch, r.doc_id) for r in published(spark, folder).collect()) == [(7, 1), (7, 4), (8, 14)]


def test_streams_publish_what_is_proven(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id int, text string"
    rules = spark.createDataFrame([(1, "Keller")], "rule_id int, literal string")
    spark.createDataFrame([(1, "clean"), (2, "Keller")], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(publisher(lambda b: b, rules, folder)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert [r.doc_id for r in published(spark, folder).collect()] == [1]


def edges_of(spark, *rows):
    return spark.createDataFrame(list(rows), "parent long, node long, ord long")


def test_trees_in_document_order(spark):
    roots = spark.createDataFrame([(1, 0), (9, 1)], "node long, ord long")
    edges = edges_of(spark, (1, 5, 1), (1, 2, 2), (5, 7, 1), (5, 6, 0), (2, 3, 0), (9, 8, 0))
    marks = spark.createDataFrame([(5, True), (3, True), (9, None)], "node long, mark boolean")
    rows = in_order(edges, roots, marks=marks).orderBy("path").collect()
    assert [(r.node, r.depth, r.below_mark) for r in rows] == [(1, 0, False), (5, 1, False), (6, 2, True), (7, 2, True), (2, 1, False), (3, 2, False), (9, 0, False), (8, 1, False)]
    # A loop is entered once; an element may list itself, and one below it may list it again.
    loop = edges_of(spark, (1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 1), (20, 21, 0), (21, 20, 0))
    assert [r.node for r in in_order(loop, roots.filter("node = 1")).orderBy("path").collect()] == [1, 2]
    # A node with two parents is below the first way, and chains of diamonds don't grow.
    diamonds = edges_of(spark, *((3 * i + a, 3 * i + b, o) for i in range(18) for a, b, o in ((1, 2, 0), (1, 3, 1), (2, 4, 0), (3, 4, 0))))
    found = in_order(diamonds, roots.filter("node = 1"), limit=60).collect()
    assert len(found) == 55 and [list(r.line)[-3:] for r in found if r.node == 55] == [[52, 53, 55]]
    chain = edges_of(spark, *((i, i + 1, 0) for i in range(1, 90)))
    assert in_order(chain, roots.filter("node = 1"), limit=31).count() == 32
    assert in_order(edges, roots.filter("false")).count() == 0 and in_order(edges.filter("false"), roots).count() == 2


def test_structure(spark):
    elements = [(1, "Sect", None, None, None, None), (2, "Head1", "Year in review", None, None, 0), (3, "P", None, None, "It rained.", 0), (4, "P", None, "", "", None), (5, "Figure", None, "A map", None, 1), (6, "Span", None, None, "ra", 2), (7, "H", None, None, None, None), (8, "Span", None, None, "below", 3), (9, "H2", "", "", "", None), (10, "H7", "no heading", None, None, None)]
    edges = edges_of(spark, (1, 2, 0), (1, 3, 1), (1, 4, 2), (1, 5, 3), (3, 6, 0), (1, 7, 4), (7, 8, 0), (1, 9, 5), (1, 10, 6))
    args = spark.createDataFrame(elements, "node long, type string, title string, alt string, actual_text string, page int"), edges, spark.createDataFrame([(1, 0)], "node long, ord long"), spark.createDataFrame([("Head1", "H1")], "type string, role string")
    found = structure(*args)
    rows = {r.node: r for r in found.collect()}
    assert (rows[2].type, rows[2].role, rows[1].role, rows[1].page, rows[7].page, rows[4].page, rows[6].below_text) == ("Head1", "H1", "Sect", 0, 3, None, True)
    assert [r.line for r in structure_lines(found).orderBy("path").collect()] == ["It rained.", "A map", "below"]
    heads = structure_outline(found, in_order(*args[1:3])).orderBy("path").collect()
    assert [(r.level, r.text, r.page) for r in heads] == [(1, "Year in review", 0), (1, "below", 3), (2, "", None)]


def test_values_down_parent_chains(spark):
    rows = [(1, None, "A4", None), (2, 1, None, "r"), (3, 2, None, None), (4, 3, "A5", None), (20, 21, None, None), (21, 20, None, "loop"), (30, 99, None, None), (31, 30, "own", None)]
    rows += [(100 + i, 99 + i if i else None, "far" if i == 0 else None, None) for i in range(80)]
    got = {r.node: r for r in inherited(spark.createDataFrame(rows, "node long, parent long, size string, turn string"), ["size", "turn"]).collect()}
    assert [(got[i]["size"], got[i].turn, got[i].size_depth) for i in (1, 2, 3, 4)] == [("A4", None, 0), ("A4", "r", 1), ("A4", "r", 2), ("A5", "r", 0)]
    assert got[20].turn == "loop" and got[20]["size"] is None and got[30]["size"] is None and got[31]["size"] == "own"
    assert got[165]["size"] == "far" and got[165].size_depth == 65 and got[166]["size"] is None
    fields = [(1, None, "form", "Tx", None, 1), (2, 1, "name", None, "Ohm", None), (3, 2, None, None, None, None), (4, 1, "age", "Ch", None, 0), (5, None, None, None, None, None), (6, 7, "x", None, None, None), (7, 6, "y", None, None, None)]
    named = {r.node: (r.name, r.type, r.value, r.flags) for r in field_names(spark.createDataFrame(fields, "node long, parent long, name string, type string, value string, flags int")).collect()}
    assert named == {1: ("form", "Tx", None, 1), 2: ("form.name", "Tx", "Ohm", 1), 3: ("form.name", "Tx", "Ohm", 1), 4: ("form.age", "Ch", None, 0), 5: (None, None, None, None)}


@pytest.mark.parametrize("tile,most", [(32.0, 4096), (1.0, 3), (500.0, 7)])
def test_boxes_meet_once(spark, tile, most):
    rng = random.Random(4)
    box = lambda i, size: (i, i % 2, x := rng.uniform(-90, 90), y := rng.uniform(-90, 90), x + rng.uniform(0, size), y + rng.uniform(0, size))
    boxes = [box(i, 12) for i in range(120)] + [(200, 0, -500.0, -500.0, 500.0, 500.0), (201, 0, 5.0, 5.0, 5.0, 9.0), (202, 0, 0.0, 0.0, 32.0, 32.0), (203, 1, None, 0.0, 1.0, 1.0), (204, 1, float("nan"), 0.0, 1.0, 1.0)]
    areas = [box(i, 40) for i in range(30)] + [(50, 0, -1000.0, -1000.0, 1000.0, 1000.0), (51, 0, 32.0, 0.0, 64.0, 32.0), (52, 0, 9.0, 9.0, 9.0, 20.0), (53, 1, 20.0, 20.0, 10.0, 30.0), (54, None, 0.0, 0.0, 9.0, 9.0)]
    kind = "id int, page int, x0 double, y0 double, x1 double, y1 double"
    got = sorted((r.box_id, r.area_id, r.whole) for r in box_join(spark.createDataFrame(boxes, kind), spark.createDataFrame(areas, kind), ["page"], tile=tile, most=most).collect())
    want = []
    for i, p, a, b, c, d in boxes:
        for j, q, e, f, g, h in areas:
            if p == q and None not in (a, p) and g > e and h > f and a < g and e < c and b < h and f < d:
                want.append((i, j, e <= a and f <= b and g >= c and h >= d))
    assert got == sorted(want) and (202, 51, False) not in got and (201, 50, True) in got


def test_annotations(spark):
    rows = [(1, [100.0, 700.0, 90.0, 720.0]), (2, [0.0, 0.0, 10.0, 10.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [1.0, None, 3.0, 4.0])]
    media = F.array(F.lit(10.0), F.lit(20.0), F.lit(610.0), F.lit(820.0))
    notes = spark.createDataFrame(rows, "id int, rect array<double>").select(F.lit(0).alias("page"), "id", annotation_box(F.col("rect"), media).alias("box"))
    assert [tuple(r.box) if r.box else None for r in notes.orderBy("id").collect()] == [(80.0, 100.0, 90.0, 120.0), (-10.0, 810.0, 0.0, 820.0), None, None, None]
    areas = spark.createDataFrame([(0, 85.0, 110.0, 86.0, 111.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.id for r in kept_annotations(notes, areas, ["page"]).collect()) == [2, 3, 4, 5]


def test_merged_objects_get_dense_numbers(spark):
    objects = spark.createDataFrame([(1, 4, "root"), (1, 7, "page"), (1, 9, "orphan"), (2, 4, "other"), (2, 5, "kid"), (3, 1, "alone")], "file int, num int, body string")
    refs = spark.createDataFrame([(1, 4, "Kids", 7), (1, 7, "Parent", 4), (1, 9, "Kids", 7), (2, 4, "A", 5), (2, 5, "B", 99), (2, 4, "C", 7)], "file int, src int, key string, dst int")
    roots = spark.createDataFrame([(1, 4), (2, 4), (3, 8)], "file int, num int")
    kept, moved, at = merge_objects(objects, refs, roots)
    assert sorted((r.num, r.file, r.body) for r in kept.collect()) == [(1, 1, "root"), (2, 1, "page"), (3, 2, "other"), (4, 2, "kid")]
    assert sorted((r.src, r.key, r.dst or 0) for r in moved.collect()) == [(1, "Kids", 2), (2, "Parent", 1), (3, "A", 4), (3, "C", 0), (4, "B", 0)]
    assert sorted(r.num for r in at.collect()) == [1, 3]
    shuffled = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.n for r in numbered(shuffled, ["k"], "n").collect()) and numbered(shuffled.filter("false"), ["k"], "n").count() == 0


def counted(spark, rows, schema):
    """A table, and how many of its rows have been read."""
    seen = spark.sparkContext.accumulator(0)

    def one(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(one), schema), seen


def test_reachability_reads_its_links_once(spark):
    from pageloom.operators.graph import reachable

    edges, seen = counted(spark, [(i, i + 1) for i in range(8)] + [(3, 3), (8, 2), (50, 51)], "src int, dst int")
    assert {r.node for r in reachable(edges, spark.createDataFrame([(0,)], "node int")).collect()} == set(range(9))
    assert seen.value == 11


def test_layers(spark):
    groups = spark.createDataFrame([(f, n) for f in (1, 2, 3) for n in (1, 2, 3)], "file int, node long")
    configurations = spark.createDataFrame([(1, False), (2, True)], "file int, base_off boolean")
    listed = spark.createDataFrame([(1, 1, "off"), (1, 1, "off"), (1, 2, "on"), (1, 9, "off"), (2, 1, "on"), (2, 2, "off"), (3, 1, "off")], "file int, node long, list string")
    states = layer_states(groups, configurations, listed)
    assert sorted((r.file, r.node) for r in states.filter("hidden").collect()) == [(1, 1), (2, 2), (2, 3)]
    cases = [("AnyOn", (1, 2), False), ("AllOn", (1, 2), True), ("AnyOff", (1, 2), False), ("AllOff", (1, 2), True), ("AnyOn", (1,), True), ("AllOn", (2, 3), False), ("AnyOff", (2, 3), True), ("AllOff", (1,), False), ("Odd", (1,), True), (None, (2,), False), ("AllOn", (), False), ("AllOn", (77,), False)]
    memberships = spark.createDataFrame([(f, 100 + i, p) for f in (1, 3) for i, (p, _, _) in enumerate(cases)], "file int, node long, policy string")
    members = spark.createDataFrame([(f, 100 + i, m) for f in (1, 3) for i, (_, ms, _) in enumerate(cases) for m in ms], "file int, node long, member long")
    got = {(r.file, r.node): r.hidden for r in membership_states(memberships, members, states).collect()}
    assert got == {(1, 100 + i): h for i, (_, _, h) in enumerate(cases)} | {(3, 100 + i): False for i in range(len(cases))}
    # Nested: each shows what the one below hides, to a depth of eight; a membership of itself ends there.
    n = 14
    chain = spark.createDataFrame([(1, 200 + i, "AllOff") for i in range(n)] + [(1, 300, "AllOn")], "file int, node long, policy string")
    below = spark.createDataFrame([(1, 200 + i, 199 + i if i else 1) for i in range(n)] + [(1, 300, 300)], "file int, node long, member long")

    def hidden(i, depth=0):
        if depth > 8 or i == 199:
            return depth <= 8
        return not hidden(i - 1, depth + 1)

    got = {r.node: r.hidden for r in membership_states(chain, below, states).collect()}
    assert got == {200 + i: hidden(200 + i) for i in range(n)} | {300: False}


def test_members_are_read_once_for_all_levels(spark):
    """The number of levels doesn't multiply what is exchanged: members are read for the links alone. No level joins by a new exchange."""
    rows = [(f, 100 + i, 99 + i if i else 1) for f in range(5) for i in range(12)]
    members, seen = counted(spark, rows, "file int, node long, member long")
    memberships = spark.createDataFrame([(f, n, "AllOff") for f, n, _ in rows], "file int, node long, policy string")
    states = spark.createDataFrame([(f, n, n == 2) for f in range(5) for n in (1, 2)], "file int, node long, hidden boolean")
    got = {(r.file, r.node): r.hidden for r in membership_states(memberships, members, states).collect()}
    assert got == {(f, 100 + i): i % 2 == 0 if i <= 8 else True for f in range(5) for i in range(12)} | {(f, 109 + j): got[f, 109 + j] for f in range(5) for j in range(3)}
    assert seen.value <= 2 * len(rows)


def test_layers_send_no_table_through_the_driver(spark):
    """However small written rows look as files, no join broadcasts a side: it would grow with the input."""
    executions = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = executions().size()
    rows = [(f, 100 + i, 99 + i if i else 1) for f in range(5) for i in range(3)]
    memberships, members = spark.createDataFrame([(f, n, "AllOff") for f, n, _ in rows], "file int, node long, policy string"), spark.createDataFrame(rows, "file int, node long, member long")
    groups = spark.createDataFrame([(f, n) for f in range(5) for n in (1, 2)], "file int, node long")
    configurations, listed = spark.createDataFrame([(f, False) for f in range(4)], "file int, base_off boolean"), spark.createDataFrame([(f, 1, "off") for f in range(3)], "file int, node long, list string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "1g"):
        got = {(r.file, r.node): r.hidden for r in membership_states(memberships, members, written(layer_states(groups, configurations, listed), "states")).collect()}
    assert got == {(f, 100 + i): f < 3 and i == 1 for f in range(5) for i in range(3)}
    plans = [executions().apply(k).physicalPlanDescription() for k in range(before, executions().size())]
    assert len(plans) > 2 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_functions_of_numbers(spark):
    ask = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    one = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    lit = lambda x: F.lit(float(x))
    assert ask(exponential(lit(3), one(0, 1, 9), one(4, 0), lit(2), lit(1), lit(5))) == [1.0, 0.75] and ask(exponential(lit(9), one(0), one(4), lit(0), lit(0), lit(1))) == [4.0]
    assert ask(normalized(lit(3), lit(2), lit(2))) == 0.0 and ask(normalized(lit(-3), lit(2), lit(4))) == 0.0
    bits = lambda data, n, k: ask(unpacked(F.unhex(F.lit(data)), F.lit(n), F.lit(k)))
    assert bits("00FF80", 8, 3) == [0.0, 1.0, 128 / 255] and bits("F05A", 4, 4) == [1.0, 0.0, 5 / 15, 10 / 15] and bits("0FFF", 12, 1) == [255 / 4095] and bits("80", 1, 3) == [1.0, 0.0, 0.0]
    assert bits("00010000FFFF", 16, 3) == [1 / 65535, 0.0, 1.0] and bits("FF", 8, 2) is None and bits("FFFFFFFF", 32, 1) == [1.0]
    grid = lambda at, sizes, samples, outputs=1: ask(interpolated(one(*at), F.array(*map(F.lit, sizes)), one(*samples), F.lit(outputs), one(*[0] * outputs), one(*[10] * outputs)))
    assert grid([0.25], [3], [0, 1, 0.5]) == [5.0] and grid([1], [3], [0, 1, 0.5]) == [5.0] and grid([0.5], [1], [0.3]) == [3.0]
    assert grid([0.5], [2], [0, 1, 1, 0], 2) == [5.0, 5.0]
    assert grid([0.5, 0.5], [2, 2], [0, 1, 0, 1]) == [5.0] and grid([1, 0], [2, 2], [0, 1, 0, 0]) == [10.0] and grid([0.5, 0.5, 0.5], [2, 2, 2], [0, 0, 0, 0, 1, 1, 1, 0]) == [3.75]
    pieces = lambda t, bounds=(2, 4), encode=(0, 1, 1, 0): tuple(ask(stitched(lit(t), one(*bounds), one(*encode), F.lit(3), lit(0), lit(6))))
    assert [pieces(t) for t in (-1, 1, 2, 3, 4, 6, 9)] == [(0, 0.0), (0, 0.5), (1, 1.0), (1, 0.5), (2, 0.0), (2, 1.0), (2, 1.0)]
    assert pieces(2, bounds=(2, 2)) == (2, 0.0)
