"""Which layers show: states from a configuration, and nested memberships under their policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.sources.scratch import setting, written

#: A join on several keys takes both sides as they are where they are dealt by one of them alike.
_BY_ONE_KEY = "spark.sql.requireAllClusterKeysForCoPartition"
#: No side of a join is bounded here: written rows are small files, so Spark would send millions of them through the driver.
_BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")

#: Fixed value: how deep memberships are followed; what lies deeper counts as shown.
DEPTH = 8
#: Levels in one plan: more would hold more sorts in a task's memory at a time, fewer would deal the links more often.
LEVELS = 4


def layer_states(groups: DataFrame, configurations: DataFrame, listed: DataFrame) -> DataFrame:
    """(file, node, hidden) of ``groups`` (file, node). ``configurations`` (file, base_off), ``listed`` (file, node, list: on or off).

    Where the base state is off, all groups but those on the on list are hidden; else those on the off list are. A file without a
    configuration hides nothing; lists may name a group twice or one that isn't there.
    """
    lists = listed.groupBy("file", "node").agg(F.bool_or(F.col("list") == "on").alias("_on"), F.bool_or(F.col("list") == "off").alias("_off"))
    base = configurations.groupBy("file").agg(F.bool_or("base_off").alias("base_off"))
    rows = groups.select("file", "node").distinct().join(lists.hint("merge"), ["file", "node"], "left").join(base.hint("merge"), "file", "left")
    on, off = (F.coalesce(c, F.lit(False)) for c in ("_on", "_off"))
    hidden = F.when(F.col("base_off").isNull(), False).when(F.col("base_off"), ~on).otherwise(off)
    return rows.select("file", "node", hidden.alias("hidden"))


def membership_states(memberships: DataFrame, members: DataFrame, states: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(file, node, hidden) of ``memberships`` (file, node, policy): ``members`` (file, node, member) are groups, whose ``states``
    (file, node, hidden) are given, or memberships.

    Evaluated from below, a level a step, ``depth`` + 1 steps: after k steps every membership has its value as seen with k levels
    below it, and a member that is deeper, be it a group, counts as shown, so loops end there. AllOn hides if a member is hidden, AnyOff if none
    is, AllOff if one shows; AnyOn, and any policy that isn't known, hides if none shows. Without members nothing is hidden; a
    member that isn't there shows.
    A membership that is itself on the list of hidden groups is hidden. Files in which nothing is hidden hide nothing.

    Nothing crosses files, so rows are dealt by file, and again after ``LEVELS`` levels, and every join and count stays on its partition. A file's rows
    are sorted there (on disk where they must be) and never held whole, nor sent through the driver.
    """
    by_file = lambda rows: rows.repartition("file")
    spark = memberships.sparkSession
    with setting(spark, _BY_ONE_KEY, "false"), setting(spark, _BROADCAST[0], "-1"), setting(spark, _BROADCAST[1], "-1"):
        links = written(_links(by_file(memberships.select("file", "node", "policy")), by_file(members.select("file", "node", "member")), by_file(states.select("file", "node", "hidden"))), "links")
        links = by_file(links)
        rule = [F.max(c).alias(c) for c in ("sure", "equal", "target")]
        known = links.groupBy("file", "node").agg(F.max("first").alias("hidden"))
        for step in range(depth):
            if step and step % LEVELS == 0:
                before = written(known, "visibility")
                known = by_file(before)
            below = known.select("file", F.col("node").alias("below"), F.col("hidden").alias("_hidden"))
            seen = links.join(below, ["file", "below"], "left").groupBy("file", "node").agg(*rule, F.count_if(~F.col("_hidden")).alias("_shown"))
            known = seen.select("file", "node", _hidden(F.col("_shown")).alias("hidden"))
        return written(known, "visibility")


def _links(memberships: DataFrame, members: DataFrame, states: DataFrame) -> DataFrame:
    """(file, node, sure, equal, target, first, below): a row for each membership below a membership, one (below null) where there is
    none. A membership is hidden as ``sure`` says, else if the number of those below it that show equals ``target``, or if it
    doesn't where ``equal`` is false; ``first``: whether it is while all members show. All are dealt by file."""
    known = memberships.select("file", F.col("node").alias("member"), F.lit(True).alias("_deeper"))
    groups = states.groupBy("file", "node").agg(F.bool_or("hidden").alias("own"))
    seen = members.join(known, ["file", "member"], "left").join(groups.select("file", F.col("node").alias("member"), F.col("own").alias("hidden")), ["file", "member"], "left")
    shows = F.col("_deeper").isNull() & ~F.coalesce("hidden", F.lit(False))
    counts = seen.groupBy("file", "node").agg(F.count(F.lit(1)).alias("n"), F.count_if(shows).alias("on"))
    hides = states.filter("hidden").groupBy("file").agg(F.lit(True).alias("some"))
    base = memberships.join(counts, ["file", "node"], "left").join(groups, ["file", "node"], "left").join(hides, "file", "left")
    deeper = members.join(known, ["file", "member"]).select("file", "node", F.col("member").alias("below"))
    n, on, policy, flag = F.coalesce("n", F.lit(0)), F.coalesce("on", F.lit(0)), F.coalesce("policy", F.lit("")), lambda c: F.coalesce(c, F.lit(False))
    sure = F.when(~flag("some"), False).when(flag("own"), True).when(n == 0, False)
    rules = base.select("file", "node", sure.alias("sure"), (~policy.isin("AllOn", "AllOff")).alias("equal"), (F.when(policy.isin("AllOn", "AnyOff"), n).otherwise(0) - on).alias("target"), (n - on).alias("_all"))
    return rules.join(deeper, ["file", "node"], "left").select("file", "node", "sure", "equal", "target", _hidden(F.col("_all")).alias("first"), "below")


def _hidden(shown: Column) -> Column:
    return F.coalesce("sure", (shown == F.col("target")) == F.col("equal"))
