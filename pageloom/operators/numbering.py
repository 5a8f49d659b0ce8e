"""Dense numbers over ordered tables, and merging object tables under new numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.graph import reachable
from pageloom.sources.scratch import written


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``rows`` with a dense number in ``order``, which should tell all rows apart: range partitions, numbered inside, and the
    sizes of those before (one row a partition, in one place). No task sees more than a partition."""
    parts = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # Written, so the partitions that are counted are those that are numbered.
    placed = written(parts.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_inside") + start).cast("long")).drop("_part", "_inside", "_before")


def merge_objects(objects: DataFrame, references: DataFrame, roots: DataFrame, start: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, references, roots) of several files as one.

    ``objects`` (file, num, ...), ``references`` (file, src, key, dst) and ``roots`` (file, num): files follow one another by their
    number, an object's new num is dense from ``start``, in order of (file, num); objects that no root reaches are left out, as are
    what they refer to. References are rewritten by joins; one that names no object of its file has a null dst. Each object is copied once.
    """
    name = lambda n: F.struct("file", F.col(n).alias("num"))
    there = objects.select("file", "num").distinct()
    known = references.join(there.select("file", F.col("num").alias("dst")), ["file", "dst"])
    live = reachable(known.select(name("src").alias("src"), name("dst").alias("dst")), roots.join(there, ["file", "num"]).select(name("num").alias("node"))).select("node.*")
    numbers = written(numbered(live.join(there, ["file", "num"]), ["file", "num"], "new", start), "numbers")
    as_src, as_dst = (numbers.select("file", F.col("num").alias(c), F.col("new").alias(f"new_{c}")) for c in ("src", "dst"))
    moved = references.join(as_src, ["file", "src"]).join(as_dst, ["file", "dst"], "left").select("file", F.col("new_src").alias("src"), "key", F.col("new_dst").alias("dst"))
    kept = objects.join(numbers, ["file", "num"]).withColumnRenamed("num", "old").withColumnRenamed("new", "num")
    return kept, moved, roots.join(numbers, ["file", "num"]).select("file", F.col("new").alias("num"))
