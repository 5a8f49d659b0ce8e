"""Reachability over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.sources.scratch import dropped, written


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) for all that ``roots`` (node) reach over ``edges`` (src, dst), roots included; loops end by themselves.

    Each step joins the frontier with the edges and drops what has been seen. Each frontier is written once; what has been
    seen is all frontiers together.
    """
    # Written, as every step reads them; a link to itself leads nowhere new.
    edges = written(edges.select("src", "dst").filter("not (src <=> dst)").distinct(), "edges")
    seen = frontier = written(roots.distinct(), "frontier")
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    dropped(edges)
    return seen


def chain_ends(links: DataFrame, limit: int) -> DataFrame:
    """(src, end, steps): where the chain from each src of ``links`` (src, dst) ends, a null dst being an end.

    ``end`` and ``steps`` are null where a link names nothing or after more than ``limit`` steps, loops included. The reach of
    every link is doubled again and again, so ``limit`` steps take a logarithm of joins. Only links that still lead on are joined:
    an ended one has no place to look up, and all of them would meet in one task.
    """
    here = F.when(F.col("dst").isNull(), F.struct(F.col("src").alias("end"), F.lit(0).alias("steps")))
    state = written(links.select("src", F.col("dst").alias("at"), here["end"].alias("end"), here["steps"].alias("steps")), "jumps")
    going, ended, reach = state.filter("at is not null"), state.filter("at is null"), 1
    while reach < limit + 1:
        other = ended.unionByName(going).select(F.col("src").alias("at"), F.col("at").alias("_at"), F.col("end").alias("_end"), F.col("steps").alias("_steps"))
        met = going.drop("end", "steps").join(other, "at", "left")
        state = written(met.select("src", F.col("_at").alias("at"), F.col("_end").alias("end"), (F.col("_steps") + reach).alias("steps")), "jumps")
        going, ended, reach = state.filter("at is not null"), ended.unionByName(state.filter("at is null")), reach * 2
    near = F.col("steps") <= limit
    found = ended.unionByName(going)
    return found.select("src", F.when(near, F.col("end")).alias("end"), F.when(near, F.col("steps")).alias("steps"))
