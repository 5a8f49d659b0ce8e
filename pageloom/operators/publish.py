"""Publication of what is proven: stage, read back, check against all rules, and name the proven documents in a manifest.

A batch of documents is written to a staging folder and read back from there; what is checked is what a reader would get.
A document is withheld if its text isn't the one that was written, if a rule's literal can still be read in it (broken
words joined), or if a token that was to arrive isn't there. The manifest is written last and a batch counts once it is
there, so a run that dies publishes nothing, and a rerun of a batch that counts gives its manifest again. The same function
serves a batch job and ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import dehyphenate
from pageloom.operators.rules import rule_spans

MANIFEST = "doc_id {id}, text_sha256 string, reasons array<string>, proven boolean"


def _there(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def residue(texts: DataFrame, rules: DataFrame, *, bounded: bool = True) -> DataFrame:
    """(doc_id, rule_id) of rules that can still be read in ``texts`` (doc_id, text), words broken over lines joined."""
    read = texts.select("doc_id", dehyphenate(F.col("text")).alias("text"))
    return rule_spans(read, rules, bounded=bounded).select("doc_id", "rule_id").distinct()


def publish(out: DataFrame, rules: DataFrame, folder: str, batch: str, *, bounded: bool = True) -> DataFrame:
    """The manifest (doc_id, text_sha256, reasons, proven) of a batch of ``out`` (doc_id, text, tokens).

    ``tokens``, which may be missing or null, lists what must have arrived in the text. ``rules`` (rule_id, literal) apply to every
    document. Reasons are ``residue:rule_id``, ``missing:token`` and ``changed``, sorted; a proven document has none.
    """
    spark = out.sparkSession
    staged, manifest = f"{folder}/staged/batch={batch}", f"{folder}/manifest/batch={batch}"
    schema = MANIFEST.format(id=out.schema["doc_id"].dataType.simpleString())
    if _there(spark, f"{manifest}/_SUCCESS"):
        return spark.read.schema(schema).parquet(manifest)
    wanted = F.col("tokens") if "tokens" in out.columns else F.lit(None).cast("array<string>")
    rows = out.select("doc_id", "text", F.coalesce(wanted, F.array().cast("array<string>")).alias("tokens"), F.sha2("text", 256).alias("text_sha256"))
    rows.write.mode("overwrite").parquet(staged)
    back = spark.read.schema(rows.schema).parquet(staged)
    left = residue(back, rules, bounded=bounded).groupBy("doc_id").agg(F.collect_set(F.concat(F.lit("residue:"), F.col("rule_id").cast("string"))).alias("left"))
    missing = F.transform(F.filter("tokens", lambda t: ~F.contains(F.coalesce("text", F.lit("")), t)), lambda t: F.concat(F.lit("missing:"), t))
    changed = F.when(F.sha2("text", 256).eqNullSafe(F.col("text_sha256")), F.array().cast("array<string>")).otherwise(F.array(F.lit("changed")))
    reasons = F.array_sort(F.array_distinct(F.concat(F.coalesce("left", F.array().cast("array<string>")), missing, changed)))
    told = back.join(left, "doc_id", "left").select("doc_id", "text_sha256", reasons.alias("reasons"))
    told.withColumn("proven", F.size("reasons") == 0).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(schema).parquet(manifest)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, doc_id, text) of all proven documents: staged ones of which a manifest says so."""
    proven = spark.read.parquet(f"{folder}/manifest").filter("proven").select("batch", "doc_id", "text_sha256")
    return spark.read.parquet(f"{folder}/staged").join(proven, ["batch", "doc_id", "text_sha256"]).select("batch", "doc_id", "text")


def publisher(prepare: Callable[[DataFrame], DataFrame], rules: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is prepared (doc_id, text, tokens) and published under its number."""

    def each(batch: DataFrame, number: int) -> None:
        publish(prepare(batch), rules, folder, str(number))

    return each
