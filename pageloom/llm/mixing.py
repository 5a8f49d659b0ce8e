"""Mixing sources to target weights (operator 7).

Every row gets a hash-random key (MD5 of its id). Within each source the key space is cut into equal ranges; as the
keys are uniform, ranges hold about ``rows_per_range`` rows each whatever the ids look like, so a source with a third
of all rows is many tasks. Range totals give each range its start (a prefix sum over a small table), a window inside a
range gives each row its start, and the source's budget cuts there: whole epochs first, then the rows whose words start
below what is left, the last one in part.

Nulls: a null text has size 0; the null source is a source of its own and sorts last; null ids share one key and are
told apart by a hash of the text. Repeated rows count as often as they occur. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import read_table, shield, written

WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources up to this many rows is broadcast; beyond it Spark shuffles.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``totals`` (source, source_size, n_rows) with ``weight`` and ``target``.

    In order of cap/weight a source is capped while its cap is below its share of what the earlier ones leave; the
    first source that isn't has the largest share of those below their caps, and that fixes all of theirs (the fixed point
    of resharing the excess again and again).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit_", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("limit_") / F.col("weight"), F.col("source").asc_nulls_last())
    share = (
        F.sum("source_size").over(Window.partitionBy())
        - F.coalesce(F.sum("limit_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    shared = ranked.withColumn("share", share)
    free = F.when(F.col("limit_") / F.col("weight") > F.col("share"), F.col("share"))
    level = F.max(free).over(Window.partitionBy())
    return shared.withColumn("target", F.when(free.isNull(), F.col("limit_").cast("double")).otherwise(level * F.col("weight"))).select(
        "source", "source_size", "n_rows", "target"
    )


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, rows_per_range: int = 2048, carry: bool = False) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken); with ``carry`` all columns of ``docs`` come too."""
    keyed = docs.select(
        *(["*"] if carry else ["doc_id", "source"]),
        word_count(F.col("text")).alias("_size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"),
        F.xxhash64("text").alias("_tie"),
    )
    slim = written(keyed.select("source", "_size", "_key", "_tie", *([] if carry else ["doc_id"])), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = written(source_targets(totals, weights, cap), "mix-sources").withColumnsRenamed(
        {"source": "_source", "source_size": "_source_size", "target": "_target", "n_rows": "_n_rows"}
    )
    if sources.count() <= MAX_BROADCAST_SOURCES:
        sources = F.broadcast(sources)

    def ranged(rows: DataFrame) -> DataFrame:
        joined = rows.join(sources, rows["source"].eqNullSafe(F.col("_source")), "left")
        ranges = F.ceil(F.col("_n_rows") / rows_per_range)
        place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
        return joined.withColumn("_range", F.floor(place * ranges / F.lit(1 << 32)).cast("long"))

    starts = (
        ranged(slim)
        .groupBy("source", "_range")
        .agg(F.sum("_size").alias("_total"))
        .withColumn("_start", F.sum("_total").over(Window.partitionBy("source").orderBy("_range")) - F.col("_total"))
        .select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_start")
    )
    rows = ranged(keyed if carry else slim)
    rows = rows.join(starts, rows["source"].eqNullSafe(F.col("_s")) & (rows["_range"] == F.col("_r")))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_start") + F.sum("_size").over(inside) - F.col("_size")
    budget = F.floor("_target")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.col("_source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("_source_size")
    taken = epochs * F.col("_size") + F.least(F.greatest(rest - before, F.lit(0)), F.col("_size"))
    kept = docs.columns if carry else ["doc_id", "source"]
    return rows.withColumn("_taken", taken.cast("long")).select(
        *kept, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch of a document, the last cut to the words taken.

    A cut document keeps its first words, joined by single spaces; documents of which nothing is taken go.
    """
    shielded, restore = shield(docs, ("doc_id", "text", "source", "n_chars"))
    rows = mix(shielded, carry=True).filter("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")))))
    left = F.col("taken") - F.col("_copy") * F.col("size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(left < F.col("size"), F.array_join(F.slice(words, 1, F.greatest(left, F.lit(1)).cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restore(rows)


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 3 * source_size AS limit_,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
), shared AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(limit_) OVER (ORDER BY limit_ / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY limit_ / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share FROM ranked
), targets AS (
  SELECT source, source_size,
         CASE WHEN limit_ / weight > share
              THEN max(CASE WHEN limit_ / weight > share THEN share END) OVER () * weight
              ELSE CAST(limit_ AS DOUBLE) END AS target FROM shared
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + least(greatest(budget - (budget // source_size) * source_size - before, 0), size) END AS BIGINT) AS taken
FROM placed
"""
