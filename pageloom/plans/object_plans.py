"""Queries of boxes, merged object tables, layers and sampled functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.sampled import exponential, interpolated, normalized, stitched, unpacked
from pageloom.operators.boxes import annotation_box, kept_annotations, places_met, run_marks
from pageloom.operators.numbering import merge_objects
from pageloom.operators.visibility import layer_states, membership_states
from pageloom.sources.scratch import written
from pageloom.sources.tables import RUNS_SQL, table

from .registry import query

#: An area for each labelled document; every third is a band over the page, and some have no width.
_DOC_AREAS_SQL = "a AS (SELECT doc_id, 0 AS page, doc_id % 7 * 40.0::DOUBLE AS x0, doc_id % 5 * 30.0::DOUBLE AS y0, CASE WHEN doc_id % 11 = 0 THEN doc_id % 7 * 40.0::DOUBLE WHEN doc_id % 3 = 0 THEN 5000.0 ELSE doc_id % 7 * 40.0::DOUBLE + 120 END AS x1, doc_id % 5 * 30.0::DOUBLE + 64 AS y1 FROM labels)"


def _doc_areas(spark, sf_dir):
    i = F.col("doc_id")
    x, y = (i % 7) * 40.0, (i % 5) * 30.0
    return table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("page"), x.alias("x0"), y.alias("y0"), F.when(i % 11 == 0, x).when(i % 3 == 0, 5000.0).otherwise(x + 120).alias("x1"), (y + 64).alias("y1"))


@query("area_table_marks", f"WITH {RUNS_SQL}, {_DOC_AREAS_SQL} SELECT r.doc_id, ln, wn, a.x0 <= x AND x + width <= a.x1 AND a.y0 <= y - 7.5 AND y + 2.5 <= a.y1 AS whole FROM runs r JOIN a ON a.doc_id = r.doc_id AND a.page = r.page AND x < a.x1 AND a.x0 < x + width AND y - 7.5 < a.y1 AND a.y0 < y + 2.5 WHERE a.x1 > a.x0 AND a.y1 > a.y0")
def area_table_marks(spark, sf_dir):
    """Runs that meet an area of a table; whether they lie inside."""
    return run_marks(table(spark, sf_dir, "documents"), _doc_areas(spark, sf_dir)).drop("page")


#: Lines of orders as boxes on ten pages, parts as areas; each thirteenth part is as large as a page.
_PART_AREAS_SQL = "a AS (SELECT p_partkey, p_partkey % 10 AS page, p_retailprice / 2 AS x0, p_size * 9.0::DOUBLE AS y0, p_retailprice / 2 + CASE WHEN p_partkey % 13 = 0 THEN 600 ELSE p_size END AS x1, p_size * 9.0::DOUBLE + CASE WHEN p_partkey % 13 = 0 THEN 500 ELSE 7 END AS y1 FROM part)"
_LINE_BOX_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 10 AS page, l_extendedprice / 100 AS x0, l_quantity * 9 AS y0, l_extendedprice / 100 + l_tax * 200 AS x1, l_quantity * 9 + l_discount * 60 AS y1 FROM lineitem WHERE l_linenumber = 1"


def _part_areas(spark, sf_dir):
    wide = F.col("p_partkey") % 13 == 0
    x, y = F.col("p_retailprice") / 2, F.col("p_size") * 9.0
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("page"), x.alias("x0"), y.alias("y0"), (x + F.when(wide, 600).otherwise(F.col("p_size"))).alias("x1"), (y + F.when(wide, 500).otherwise(7)).alias("y1"))


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _line_boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").selectExpr(*_LINE, "l_suppkey % 10 AS page", "l_extendedprice / 100 AS x0", "l_quantity * 9 AS y0", "l_extendedprice / 100 + l_tax * 200 AS x1", "l_quantity * 9 + l_discount * 60 AS y1")


@query("image_area_marks", f"WITH {_PART_AREAS_SQL}, b AS ({_LINE_BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n_areas, count(*) FILTER (a.x0 <= b.x0 AND a.y0 <= b.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1) AS n_whole, min(p_partkey) AS first_area FROM b JOIN a ON a.page = b.page AND b.x0 < a.x1 AND a.x0 < b.x1 AND b.y0 < a.y1 AND a.y0 < b.y1 GROUP BY ALL")
def image_area_marks(spark, sf_dir):
    """Images against areas of both small and page size, each pair once."""
    boxes = _line_boxes(spark, sf_dir)
    met = boxes.join(places_met(boxes, _part_areas(spark, sf_dir), ["page"], "p_partkey"), ["page", "x0", "y0", "x1", "y1"])
    # A line may be listed twice, as in the SQL's groups.
    return met.groupBy(*_LINE).agg(F.sum("n_areas").alias("n_areas"), F.sum("n_whole").alias("n_whole"), F.min("first_area").alias("first_area"))


@query("kept_annotations", f"""WITH {_PART_AREAS_SQL}, b AS ({_LINE_BOX_SQL}), n AS (SELECT *, l_orderkey % 4 = 3 AS none, 800 - y1 AS top, 800 - y0 AS low FROM b)
SELECT page, count(*) AS n_kept, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM n b WHERE none OR NOT EXISTS (SELECT 1 FROM a WHERE p_partkey % 13 > 0 AND a.page = b.page AND b.x0 < a.x1 AND a.x0 < b.x1 AND b.top < a.y1 AND a.y0 < b.low) GROUP BY page""")
def kept_annotations_query(spark, sf_dir):
    """Annotations outside all areas: rectangles count from the bottom of their page, corners in any order; some have none."""
    rect = F.when(F.col("l_orderkey") % 4 < 3, F.array(F.col("x1") + 10, F.col("y0") + 20, F.col("x0") + 10, F.col("y1") + 20))
    media = F.array(F.lit(10.0), F.lit(20.0), F.lit(610.0), F.lit(820.0))
    notes = _line_boxes(spark, sf_dir).select("page", F.struct(*_LINE).alias("id"), annotation_box(rect, media).alias("box"), "l_orderkey")
    kept = kept_annotations(notes, _part_areas(spark, sf_dir).filter("p_partkey % 13 > 0"), ["page"])
    return kept.groupBy("page").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("l_orderkey").alias("orders"))


_OBJECTS_SQL = """ob AS (SELECT o_orderkey % 4 AS file, o_orderkey AS num, o_totalprice AS price FROM orders),
ref AS (SELECT o_orderkey % 4 AS file, o_orderkey AS src, 'next' AS key, o_orderkey - 4 * (o_custkey % 5 + 1) AS dst FROM orders WHERE o_custkey % 3 > 0 UNION ALL SELECT o_orderkey % 4, o_orderkey, 'self', o_orderkey FROM orders WHERE o_custkey % 7 = 0),
live AS (SELECT o_orderkey % 4 AS file, o_orderkey AS num FROM orders WHERE o_custkey % 50 = 0 UNION SELECT r.file, r.dst FROM live l JOIN ref r ON r.file = l.file AND r.src = l.num JOIN ob ON ob.file = r.file AND ob.num = r.dst),
new AS (SELECT file, num, row_number() OVER (ORDER BY file, num) AS new FROM live)"""


def _objects(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("file"), F.col("o_orderkey").alias("num"), "o_custkey", "o_totalprice")
    refs = o.filter("o_custkey % 3 > 0").select("file", F.col("num").alias("src"), F.lit("next").alias("key"), (F.col("num") - 4 * (F.col("o_custkey") % 5 + 1)).alias("dst"))
    refs = refs.union(o.filter("o_custkey % 7 = 0").select("file", "num", F.lit("self"), "num"))
    return merge_objects(o.select("file", "num", "o_totalprice"), refs, o.filter("o_custkey % 50 = 0").select("file", "num"))


@query("merge_objects", f"WITH RECURSIVE {_OBJECTS_SQL} SELECT n.new AS num, n.file, n.num AS old, price FROM new n JOIN ob USING (file, num)")
def merge_objects_query(spark, sf_dir):
    """Objects of four files under dense numbers; what no root reaches is left out."""
    return _objects(spark, sf_dir)[0].select("num", "file", "old", F.col("o_totalprice").alias("price"))


@query("merge_references", f"WITH RECURSIVE {_OBJECTS_SQL} SELECT s.new AS src, key, coalesce(d.new, -1) AS dst FROM ref r JOIN new s ON s.file = r.file AND s.num = r.src LEFT JOIN new d ON d.file = r.file AND d.num = r.dst")
def merge_references(spark, sf_dir):
    """The references of merged objects, rewritten; -1 where one names nothing in its file."""
    return _objects(spark, sf_dir)[1].select("src", "key", F.coalesce("dst", F.lit(-1)).alias("dst"))


#: Orders are files, their lines groups; each is followed by memberships of its lines and of the memberships before it.
_POLICIES = ("AnyOn", "AllOn", "AnyOff", "AllOff", "Other")
_LAYERS_SQL = f"""g AS (SELECT DISTINCT l_orderkey AS file, l_linenumber::BIGINT AS node FROM lineitem),
c AS (SELECT o_orderkey AS file, o_orderstatus = 'P' AS base_off FROM orders WHERE o_custkey % 10 > 0),
listed AS (SELECT DISTINCT l_orderkey AS file, l_linenumber::BIGINT AS node, CASE WHEN l_returnflag = 'N' THEN 'on' ELSE 'off' END AS list FROM lineitem WHERE l_linestatus = 'O'),
st AS (SELECT g.file, g.node, CASE WHEN c.base_off IS NULL THEN false WHEN c.base_off THEN NOT EXISTS (SELECT 1 FROM listed l WHERE l.file = g.file AND l.node = g.node AND list = 'on') ELSE EXISTS (SELECT 1 FROM listed l WHERE l.file = g.file AND l.node = g.node AND list = 'off') END AS hidden FROM g LEFT JOIN c USING (file)),
m AS (SELECT file, 100 + k AS node, ['AnyOn', 'AllOn', 'AnyOff', 'AllOff', 'Other'][(file + k) % 5 + 1] AS policy FROM (SELECT DISTINCT file FROM g), unnest(range(6)) AS u(k)),
mm AS (SELECT m.file, m.node, g.node AS member FROM m JOIN g ON g.file = m.file AND (g.node + m.node) % 3 = 0 AND m.node < 105 UNION ALL SELECT file, node, node - 1 FROM m WHERE node > 100 AND node < 105)"""


def _layers(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    groups = lines.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("node")).distinct()
    configurations = orders.filter("o_custkey % 10 > 0").select(F.col("o_orderkey").alias("file"), (F.col("o_orderstatus") == "P").alias("base_off"))
    listed = lines.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("node"), F.when(F.col("l_returnflag") == "N", "on").otherwise("off").alias("list"))
    return written(layer_states(groups, configurations, listed), "states")


@query("layer_states", f"WITH {_LAYERS_SQL} SELECT file, node, hidden FROM st")
def layer_states_query(spark, sf_dir):
    """Groups that a configuration hides: a base state with its exceptions."""
    return _layers(spark, sf_dir)


_HIDDEN_SQL = "CASE WHEN n = 0 THEN false WHEN policy = 'AllOn' THEN shown <> n WHEN policy = 'AnyOff' THEN shown = n WHEN policy = 'AllOff' THEN shown <> 0 ELSE shown = 0 END"
_LEVELS_SQL = ", ".join(
    f"v{k} AS MATERIALIZED (SELECT file, node, EXISTS (SELECT 1 FROM st WHERE st.file = z.file AND st.hidden) AND {_HIDDEN_SQL} AS hidden FROM (SELECT m.file, m.node, policy, count(mm.member) AS n, count(mm.member) FILTER (NOT coalesce(st.hidden, v.hidden, false)) AS shown FROM m LEFT JOIN mm ON mm.file = m.file AND mm.node = m.node LEFT JOIN st ON st.file = mm.file AND st.node = mm.member LEFT JOIN {f'v{k - 1}' if k else '(SELECT 0::BIGINT AS file, 0::BIGINT AS node, false AS hidden)'} v ON v.file = mm.file AND v.node = mm.member GROUP BY ALL) z)"
    for k in range(6)
)


@query("membership_states", f"WITH {_LAYERS_SQL}, {_LEVELS_SQL} SELECT file, node, hidden FROM v5")
def membership_states_query(spark, sf_dir):
    """Memberships of groups and of other memberships, five deep, under all policies; the last of each file is empty."""
    states = _layers(spark, sf_dir)
    groups = states.select("file", "node")
    kinds = F.array(*map(F.lit, _POLICIES))
    memberships = groups.select("file").distinct().select("file", F.explode(F.array(*(F.lit(k) for k in range(6)))).alias("k"))
    memberships = memberships.select("file", (F.col("k") + 100).cast("long").alias("node"), F.get(kinds, ((F.col("file") + F.col("k")) % 5).cast("int")).alias("policy"))
    small = memberships.filter("node < 105")
    members = small.alias("m").join(groups.alias("g"), (F.col("m.file") == F.col("g.file")) & ((F.col("g.node") + F.col("m.node")) % 3 == 0)).select("m.file", "m.node", F.col("g.node").alias("member"))
    members = members.unionByName(small.filter("node > 100").select("file", "node", (F.col("node") - 1).alias("member")))
    return membership_states(memberships, members, states)


@query("function_values", """WITH f AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS t, p_retailprice / 2000 AS u FROM part),
g AS (SELECT *, CASE WHEN t < 0.3 THEN 0 WHEN t < 0.7 THEN 1 ELSE 2 END AS piece FROM f),
x AS (SELECT *, CASE piece WHEN 0 THEN t / 0.3 WHEN 1 THEN 1 - (t - 0.3) / 0.4 ELSE (t - 0.7) / (1 - 0.7) END AS x FROM g),
s AS (SELECT *, greatest(0, least(1, x)) * 3 AS p, greatest(0, least(1, u)) * 1 AS q FROM x),
c AS (SELECT *, CAST(least(floor(p), 3) AS INT) AS i, CAST(least(floor(q), 1) AS INT) AS j, [1, 6, 15, 8, 0, 9, 12, 3] AS d FROM s),
w AS (SELECT *, least(i + 1, 3) AS i1, least(j + 1, 1) AS j1, p - i AS a, q - j AS b FROM c)
SELECT p_partkey, piece, round(CASE piece WHEN 0 THEN pow(x, 2.0) WHEN 1 THEN 1 - 0.5 * pow(x, 1.5) ELSE -1 + 3 * ((1 - a) * (1 - b) * d[i + 4 * j + 1] + a * (1 - b) * d[i1 + 4 * j + 1] + (1 - a) * b * d[i + 4 * j1 + 1] + a * b * d[i1 + 4 * j1 + 1]) / 15.0::DOUBLE END, 6) AS v FROM w""")
def function_values(spark, sf_dir):
    """Two exponential functions and one sampled on a grid of two dimensions (four bits a sample), stitched."""
    one = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("t"), (F.col("p_retailprice") / 2000).alias("u"))
    zero, unit = F.lit(0.0), F.lit(1.0)
    rows = rows.withColumn("s", stitched(F.col("t"), one(0.3, 0.7), one(0, 1, 1, 0), F.lit(3), zero, unit))
    x = F.col("s.x")
    samples = unpacked(F.unhex(F.lit("16F809C3")), F.lit(4), F.lit(8))
    grid = interpolated(F.array(normalized(x, zero, unit), normalized(F.col("u"), zero, unit)), F.array(F.lit(4), F.lit(2)), samples, F.lit(1), one(-1), one(2))
    pieces = (exponential(x, one(0), one(1), F.lit(2.0), zero, unit), exponential(x, one(1), one(0.5), F.lit(1.5), zero, unit), grid)
    value = F.when(F.col("s.piece") == 0, pieces[0]).when(F.col("s.piece") == 1, pieces[1]).otherwise(pieces[2])
    return rows.select("p_partkey", F.col("s.piece").alias("piece"), F.round(F.get(value, F.lit(0)), 6).alias("v"))
