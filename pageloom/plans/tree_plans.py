"""Queries of trees: structure in document order, inherited values, form fields, number and name trees. Parts are the nodes
of a tree of twos (part 2n and 2n + 1 are below n), orders those of chains of their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators.numbering import numbered
from pageloom.operators.trees import field_names, in_order, inherited, structure, structure_lines, structure_outline
from pageloom.sources.scratch import written
from pageloom.sources.tables import table

from .registry import query

#: Fixed values of these queries: names of types, and what some are mapped to.
TYPES, ROLES = ("Head1", "P", "H2", "Figure", "Sect", "H", "H7"), {"Head1": "H1", "Sect": "Part"}
_TYPES_SQL = "['" + "', '".join(TYPES) + "']"
_ROLE_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " ELSE type END"
#: A node's children come in an order of their own: the larger number first where the node divides by three. Part 40 is also its
#: own child and its parent's parent's, which are ways that don't count.
_TREE_SQL = f"""el AS (SELECT p_partkey AS node, {_TYPES_SQL}[p_partkey % 7 + 1] AS type, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS title, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE '' END AS alt,
  CASE WHEN p_size % 11 = 0 THEN p_type ELSE '' END AS actual_text, CASE WHEN p_size % 4 = 0 THEN p_size END AS page FROM part),
edge AS (SELECT p_partkey // 2 AS parent, p_partkey AS node, CASE WHEN p_partkey // 2 % 3 = 0 THEN -1 ELSE 1 END * p_partkey AS ord FROM part WHERE p_partkey > 1),
tree AS (SELECT 1::BIGINT AS node, [0::BIGINT] AS path, [1::BIGINT] AS line, false AS below_text
  UNION ALL SELECT e.node, list_append(t.path, e.ord), list_append(t.line, e.node), t.below_text OR l.actual_text <> '' FROM tree t JOIN edge e ON e.parent = t.node JOIN el l ON l.node = t.node),
own AS (SELECT el.*, {_ROLE_SQL} AS role, coalesce(nullif(actual_text, ''), nullif(title, ''), nullif(alt, '')) AS said, t.path, t.line, t.below_text, len(t.path) - 1 AS depth FROM el JOIN tree t USING (node)),
paged AS (SELECT u.a AS node, arg_min(page, path) AS page FROM own, unnest(line) AS u(a) WHERE page IS NOT NULL GROUP BY u.a),
texted AS (SELECT u.a AS node, arg_min(said, path) AS said FROM own, unnest(line) AS u(a) WHERE said IS NOT NULL GROUP BY u.a)"""


def _tree(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    some = lambda n, c: F.when(F.col("p_size") % n == 0, F.col(c)).otherwise("")
    kinds = F.array(*map(F.lit, TYPES))
    elements = part.select(F.col("p_partkey").alias("node"), F.get(kinds, (F.col("p_partkey") % 7).cast("int")).alias("type"), some(3, "p_name").alias("title"), some(5, "p_brand").alias("alt"), some(11, "p_type").alias("actual_text"), F.when(F.col("p_size") % 4 == 0, F.col("p_size")).alias("page"))
    parent = F.floor(F.col("p_partkey") / 2).cast("long")
    edges = part.filter("p_partkey > 1").select(parent.alias("parent"), F.col("p_partkey").alias("node"), (F.when(parent % 3 == 0, -1).otherwise(1) * F.col("p_partkey")).alias("ord"))
    again = part.filter("p_partkey = 40").select(F.explode(F.array(*(F.lit(n).cast("long") for n in (40, 80, 161)))).alias("parent"), F.col("p_partkey").alias("node"), F.lit(-999).cast("long").alias("ord"))
    roots = part.filter("p_partkey = 1").select(F.col("p_partkey").alias("node"), F.lit(0).cast("long").alias("ord"))
    roles = spark.createDataFrame(list(ROLES.items()), "type string, role string")
    return elements, written(edges.union(again), "edges"), roots, roles


@query("struct_tree", f"WITH RECURSIVE {_TREE_SQL} SELECT node, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS place, CAST(depth AS INT) AS depth, type, role, coalesce(p.page, -1) AS page, below_text FROM own LEFT JOIN paged p USING (node)")
def struct_tree(spark, sf_dir):
    """Elements in document order with mapped roles, and pages from what is below them."""
    found = written(structure(*_tree(spark, sf_dir)), "structure")
    placed = in_place(found.select("node", "path"))
    return found.join(placed, "node").select("node", "place", "depth", "type", "role", F.coalesce("page", F.lit(-1)).alias("page"), "below_text")


def in_place(rows):
    """(node, place): numbers of rows in order of path, dense."""
    return numbered(rows, ["path"], "place").select("node", "place")


@query("struct_lines", f"WITH RECURSIVE {_TREE_SQL} SELECT node, coalesce(nullif(actual_text, ''), nullif(alt, '')) AS line, row_number() OVER (ORDER BY path) - 1 AS place FROM own WHERE NOT below_text AND coalesce(nullif(actual_text, ''), nullif(alt, '')) IS NOT NULL")
def struct_lines(spark, sf_dir):
    """What a tagged document says, line by line: an element that says what it reads speaks for all below it."""
    lines = written(structure_lines(structure(*_tree(spark, sf_dir))), "lines")
    return lines.join(in_place(lines.select("node", "path")), "node").select("node", "line", "place")


@query("struct_headings", f"WITH RECURSIVE {_TREE_SQL} SELECT node, CASE WHEN role = 'H' THEN 1 ELSE CAST(role[2] AS INT) END AS level, coalesce(t.said, '') AS text, coalesce(p.page, -1) AS page FROM own LEFT JOIN texted t USING (node) LEFT JOIN paged p USING (node) WHERE role = 'H' OR regexp_matches(role, '^H[1-6]$')")
def struct_headings(spark, sf_dir):
    """Headings by mapped role, with the best text that they or the elements below them offer."""
    elements, edges, roots, roles = _tree(spark, sf_dir)
    found = written(structure(elements, edges, roots, roles), "structure")
    tree = written(in_order(edges, roots), "tree")
    return structure_outline(found, tree).select("node", "level", "text", F.coalesce("page", F.lit(-1)).alias("page"))


@query("inherited_value", """WITH RECURSIVE n AS (SELECT o_orderkey AS node, CASE WHEN o_custkey % 9 > 0 THEN o_orderkey - 4 * (o_custkey % 3 + 1) END AS parent, CASE WHEN o_totalprice < 20000 THEN o_orderpriority END AS v, CASE WHEN o_custkey % 40 = 0 THEN o_orderstatus END AS w FROM orders),
a AS (SELECT node, node AS at, 0 AS depth FROM n UNION ALL SELECT a.node, n.parent, depth + 1 FROM a JOIN n ON n.node = a.at WHERE n.parent IS NOT NULL AND depth < 65),
x AS (SELECT a.node, arg_min(n.v, a.depth) AS value, min(a.depth) AS depth FROM a JOIN n ON n.node = a.at WHERE n.v IS NOT NULL GROUP BY a.node),
y AS (SELECT a.node, arg_min(n.w, a.depth) AS status FROM a JOIN n ON n.node = a.at WHERE n.w IS NOT NULL GROUP BY a.node)
SELECT node AS o_orderkey, value, coalesce(CAST(depth AS INT), -1) AS depth, status FROM n LEFT JOIN x USING (node) LEFT JOIN y USING (node)""")
def inherited_value(spark, sf_dir):
    """Two attributes, each from the nearest of an order and the up to 65 before it in its chain that has one."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("node"), F.when(F.col("o_custkey") % 9 > 0, F.col("o_orderkey") - 4 * (F.col("o_custkey") % 3 + 1)).alias("parent"),
        F.when(F.col("o_totalprice") < 20000, F.col("o_orderpriority")).alias("value"), F.when(F.col("o_custkey") % 40 == 0, F.col("o_orderstatus")).alias("status"),
    )
    out = inherited(rows, ["value", "status"])
    return out.select(F.col("node").alias("o_orderkey"), "value", F.coalesce("value_depth", F.lit(-1)).alias("depth"), "status")


@query("field_tree", """WITH RECURSIVE f AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 3 THEN p_partkey // 3 END AS parent, CASE WHEN p_size % 6 > 0 THEN p_brand END AS name, CASE WHEN p_size % 7 = 0 THEN p_type END AS type, CASE WHEN p_size % 3 = 0 THEN p_size END AS flags FROM part),
t AS (SELECT node, name, type, flags, 0 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.node, CASE WHEN f.name IS NULL THEN t.name WHEN t.name IS NULL THEN f.name ELSE t.name || '.' || f.name END, coalesce(f.type, t.type), coalesce(f.flags, t.flags), depth + 1 FROM t JOIN f ON f.parent = t.node WHERE depth < 32)
SELECT node, coalesce(name, '') AS name, coalesce(type, '') AS type, coalesce(flags, 0) AS flags, CAST(depth AS INT) AS depth FROM t""")
def field_tree(spark, sf_dir):
    """Fields with their whole dotted names, and type and flags from the nearest ancestor that has them."""
    part = table(spark, sf_dir, "part")
    parent = F.when(F.col("p_partkey") > 3, F.floor(F.col("p_partkey") / 3).cast("long"))
    rows = part.select(F.col("p_partkey").alias("node"), parent.alias("parent"), F.when(F.col("p_size") % 6 > 0, F.col("p_brand")).alias("name"), F.when(F.col("p_size") % 7 == 0, F.col("p_type")).alias("type"), F.lit(None).cast("string").alias("value"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("flags"))
    return field_names(rows).select("node", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("flags", F.lit(0)).alias("flags"), "depth")


_KIDS_SQL = "kid AS (SELECT p_partkey // 3 AS parent, p_partkey AS node FROM part WHERE p_partkey >= 3), walk AS (SELECT p_partkey AS node, [p_partkey] AS path, 0 AS depth FROM part WHERE p_partkey < 3 UNION ALL SELECT k.node, list_append(path, -k.node), depth + 1 FROM walk JOIN kid k ON k.parent = walk.node WHERE depth < 32)"


def _leaves(spark, sf_dir):
    """A tree of threes whose kids come from the last to the first, flattened in tree order."""
    part = table(spark, sf_dir, "part")
    edges = part.filter("p_partkey >= 3").select(F.floor(F.col("p_partkey") / 3).cast("long").alias("parent"), F.col("p_partkey").alias("node"), (-F.col("p_partkey")).alias("ord"))
    roots = part.filter("p_partkey < 3").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"))
    return part.withColumnRenamed("p_partkey", "node").join(in_order(edges, roots, 32), "node")


@query("number_tree", f"WITH RECURSIVE {_KIDS_SQL} SELECT node, p_size AS key, p_name AS value, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY path) - 1 AS place FROM walk JOIN part ON p_partkey = node WHERE p_size % 10 > 0")
def number_tree(spark, sf_dir):
    """A tree of numbers in tree order; keys that aren't whole are passed over."""
    rows = written(_leaves(spark, sf_dir).filter("p_size % 10 > 0").select("node", "path", F.col("p_size").alias("key"), F.col("p_name").alias("value"), "depth"), "entries")
    return rows.drop("path").join(in_place(rows.select("node", "path")), "node")


@query("tree_entries", f"WITH RECURSIVE {_KIDS_SQL}, e AS (SELECT node, path, u.i AS i, p_name || '/' || u.i AS key FROM walk JOIN part ON p_partkey = node, unnest(range(p_size % 4)) AS u(i)) SELECT node, CAST(i AS INT) AS i, key, row_number() OVER (ORDER BY path, i) - 1 AS place FROM e")
def tree_entries(spark, sf_dir):
    """A name tree flattened in order: each node's own names first, then those of its kids."""
    names = F.filter(F.sequence(F.lit(0), F.col("p_size") % 4), lambda i: i < F.col("p_size") % 4)
    rows = _leaves(spark, sf_dir).select("node", "path", F.explode(names).alias("i"), "p_name")
    return numbered(rows, ["path", "i"], "place").select("node", "i", F.concat("p_name", F.lit("/"), F.col("i").cast("string")).alias("key"), "place")
