"""Marks of documents as they arrive: the batch operators on a stream of files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pageloom.operators.redact import Rule, literal_marks


def stream_marks(spark: SparkSession, source: str, schema: StructType, rules: list[Rule], sink: str, checkpoint: str) -> StreamingQuery:
    """Read new Parquet files below ``source`` once, write (doc_id, rule_id, hits) below ``sink``; reruns skip what is done."""
    texts = spark.readStream.schema(schema).parquet(source)
    marks = literal_marks(texts, rules)
    return marks.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
