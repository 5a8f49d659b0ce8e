"""Values down parent chains and trees in document order, by pointer doubling.

Every node holds what its chain says up to some ancestor; joining it with what that ancestor holds doubles the reach, so
chains of 64 links are seven joins. What is combined is any monoid: the first value that is there, names joined by dots,
positions as an array (which sorts nodes in document order), or whether some ancestor has a mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.sources.scratch import dropped, written

#: What a node's own value and the one above it make together.
Combine = Callable[[Column, Column], Column]


def nearest(below: Column, above: Column) -> Column:
    """The first value up the chain."""
    return F.coalesce(below, above)


def appended(below: Column, above: Column) -> Column:
    """Arrays from the top down."""
    return F.concat(above, below)


def either(below: Column, above: Column) -> Column:
    return below | above


def dotted(below: Column, above: Column) -> Column:
    """Names from the top down, those that aren't there left out."""
    return F.when(below.isNull(), above).when(above.isNull(), below).otherwise(F.concat(above, F.lit("."), below))


def up_chain(nodes: DataFrame, combine: dict[str, Combine], limit: int) -> DataFrame:
    """``nodes`` (node, parent, ...), each column of ``combine`` made of the node's own and its ancestors' values, as far as the
    chain goes but not over 2^k - 1 links, the least such number that isn't below ``limit``. Adds up: null where the chain has ended at a root, else
    a node that it hasn't looked at: chains that are longer, loops, and parents that aren't there. Nodes are distinct."""
    names = list(combine)
    state = written(nodes.withColumn("up", F.col("parent")).withColumn("_done", F.col("parent").isNull()), "chains")
    reach = 1
    while reach < limit + 1:
        above = state.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("_done").alias("_end"), *(F.col(n).alias(f"_{n}") for n in names))
        going, ended = state.filter("not _done"), state.filter("_done")
        met = going.join(above, F.col("up") == F.col("_node"), "left")
        found = F.col("_node").isNotNull()
        new = {n: F.when(found, combine[n](F.col(n), F.col(f"_{n}"))).otherwise(F.col(n)) for n in names}
        met = met.withColumns(new | {"up": F.when(found, F.col("_up")).otherwise(F.col("up")), "_done": F.coalesce("_end", F.lit(False))}).select(*state.columns)
        before, state = state, written(ended.unionByName(met), "chains")
        dropped(before)
        reach *= 2
    return state.drop("_done")


def inherited(nodes: DataFrame, values: list[str], limit: int = 65) -> DataFrame:
    """``nodes`` (node, parent, values...): each value the nearest one up the parent chain, at most ``limit`` links away, its
    own first, with ``<value>_depth``, how many links away it was. Null where the chain holds none: it may end, lead nowhere or loop."""
    depth = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.lit(0).alias("depth"), F.col(v).alias("value")))
    own = nodes.select("node", "parent", *(depth(v).alias(v) for v in values), F.lit(1).alias("_links"))

    def nearer(below: Column, above: Column) -> Column:
        return F.when(below.isNotNull(), below).when(above.isNotNull(), F.struct((above["depth"] + F.col("_links")).alias("depth"), above["value"].alias("value")))

    found = up_chain(own, {v: nearer for v in values} | {"_links": lambda a, b: a + b}, limit)
    near = lambda v: F.col(f"{v}.depth") <= limit
    return found.select("node", *(F.when(near(v), F.col(f"{v}.value")).alias(v) for v in values), *(F.when(near(v), F.col(f"{v}.depth")).alias(f"{v}_depth") for v in values))


def first_ways(edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """``edges`` (parent, node, ord) with one way to each node that ``roots`` (node, ord) reach: roots have none, of several the
    shallowest counts, then the first in order. Tables in which no node has two ways stay as they are, and cost one count."""
    twice = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    if twice.isEmpty() and edges.join(roots.select("node"), "node").limit(1).isEmpty():
        return edges
    level = seen = written(roots.select("node", F.array("ord").alias("path")).groupBy("node").agg(F.min("path").alias("path")), "ways")
    ways = None
    for _ in range(limit):
        step = level.select(F.col("node").alias("parent"), "path").join(edges, "parent").join(seen.select("node"), "node", "left_anti")
        step = step.groupBy("node").agg(F.min(F.struct(F.concat("path", F.array("ord")).alias("path"), "parent", "ord")).alias("w"))
        step = written(step.select("node", "w.*"), "ways")
        if step.isEmpty():
            break
        ways = step if ways is None else ways.unionByName(step)
        level, seen = step.select("node", "path"), seen.select("node", "path").unionByName(step.select("node", "path"))
    return edges.limit(0) if ways is None else ways.select("parent", "node", "ord")


def in_order(edges: DataFrame, roots: DataFrame, limit: int = 31, marks: DataFrame | None = None) -> DataFrame:
    """(node, path, line, depth) of all nodes that ``roots`` (node, ord) reach over ``edges`` (parent, node, ord) in ``limit``
    links: path sorts nodes in document order, line holds the ancestors' numbers from the root down, the node's own last.

    A loop is entered once and not gone round; a node with several parents is below the first way (see ``first_ways``). ``marks``
    (node, mark) adds below_mark: whether an ancestor of a node is marked. ``ord`` is an integer; equal ones are ordered by node.
    """
    ways = first_ways(edges.select("parent", "node", "ord").distinct(), roots, limit)
    nodes = roots.select("node", F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), "ord").distinct()
    nodes = nodes.groupBy("node", "parent").agg(F.min("ord").alias("ord")).unionByName(ways.join(roots.select("node"), "node", "left_anti").select("node", "parent", "ord"))
    nodes = nodes.select("node", "parent", F.array(F.struct("ord", "node")).alias("path"))
    combine: dict[str, Combine] = {"path": appended}
    if marks is not None:
        # A node passes on its own mark, but isn't below it.
        nodes = nodes.join(marks.select("node", "mark"), "node", "left").withColumn("marked", F.coalesce("mark", F.lit(False))).drop("mark").withColumn("own", F.col("marked"))
        combine["marked"] = either
    found = up_chain(nodes, combine, limit).filter(F.col("up").isNull() & (F.size("path") <= limit + 1))
    line = F.transform("path", lambda p: p["node"])
    out = found.select("node", "path", line.alias("line"), (F.size("path") - 1).alias("depth"), *(["marked", "own"] if marks is not None else []))
    if marks is None:
        return out
    # Marked by itself alone or by an ancestor: the parent's answer tells, which is one more join.
    above = out.select(F.col("node").alias("_up"), F.col("marked").alias("below_mark"))
    parent = F.when(F.col("depth") > 0, F.get("line", F.col("depth") - 1))
    return out.withColumn("_parent", parent).join(above, F.col("_parent") == F.col("_up"), "left").select("node", "path", "line", "depth", F.coalesce("below_mark", F.lit(False)).alias("below_mark"))


def first_below(tree: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): for each node of ``tree`` (node, path, line) the value of the first node in document order, itself included,
    that ``values`` (node, value) has. A value goes up its line to all ancestors, with its place; the least place stays, by a
    map-side minimum, so a root of all nodes gathers a row a task."""
    up = tree.join(values.filter("value is not null"), "node").select(F.explode("line").alias("node"), F.struct("path", "value").alias("v"))
    return up.groupBy("node").agg(F.min("v").alias("v")).select("node", "v.value")


#: The shape of roles that are headings, and the bare form, which is of the first level.
HEADING_ROLE = "^H[1-6]$"


def heading_level(role: Column) -> Column:
    return F.when(role == "H", 1).when(role.rlike(HEADING_ROLE), F.substring(role, 2, 1).cast("int"))


def structure(elements: DataFrame, edges: DataFrame, roots: DataFrame, roles: DataFrame, limit: int = 31) -> DataFrame:
    """``elements`` (node, type, title, alt, actual_text, page) that the tree reaches, with path, depth, role, page and below_text.

    ``roles`` (type, role) maps a document's own names to standard ones; others stay. An element without a page has that of the first element
    below it that has one. below_text: an ancestor says what it reads, so this element says nothing.
    """
    tree = written(in_order(edges, roots, limit, elements.select("node", (F.col("actual_text") != "").alias("mark"))), "tree")
    pages = first_below(tree, elements.select("node", F.col("page").alias("value"))).withColumnRenamed("value", "_page")
    named = elements.join(tree.drop("line"), "node").join(roles.select("type", F.col("role").alias("_role")), "type", "left").join(pages, "node", "left")
    return named.select("node", "path", "depth", "type", F.coalesce("_role", "type").alias("role"), "title", "alt", "actual_text", F.col("_page").alias("page"), F.col("below_mark").alias("below_text"))


def structure_lines(found: DataFrame) -> DataFrame:
    """(node, path, line) of a ``structure``: what its elements read as, their actual text before their alternate text."""
    said = F.coalesce(F.nullif(F.col("actual_text"), F.lit("")), F.nullif(F.col("alt"), F.lit("")))
    return found.filter(~F.col("below_text")).select("node", "path", said.alias("line")).filter("line is not null")


def structure_outline(found: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, path, level, text, page) of headings: their actual text, title or alternate text, or that of the first element
    below them that has one, else empty. ``tree`` is what ``in_order`` gives for the same nodes."""
    text = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("actual_text", "title", "alt")))
    heads = found.withColumn("level", heading_level(F.col("role"))).filter("level is not null").select("node", "path", "level", "page")
    first = first_below(tree, found.select("node", text.alias("value")))
    return heads.join(first, "node", "left").select("node", "path", "level", F.coalesce("value", F.lit("")).alias("text"), "page")


def field_names(fields: DataFrame, limit: int = 32) -> DataFrame:
    """``fields`` (node, parent, name, type, value, flags) below a root, with their whole dotted name and what they inherit. A
    part without a name adds none. Fields in loops or more than ``limit`` links down are left out."""
    own = fields.select("node", "parent", "name", "type", "value", "flags", F.lit(0).alias("depth"), F.lit(1).alias("_links"))
    combine = {"name": dotted, "type": nearest, "value": nearest, "flags": nearest, "_links": lambda a, b: a + b}
    return up_chain(own, combine, limit).filter(F.col("up").isNull() & (F.col("_links") <= limit + 1)).select("node", "name", "type", "value", "flags", (F.col("_links") - 1).alias("depth"))
