"""What the operators of this subpackage share about tables and batches; scratch tables are those of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources.scratch import dropped, scratch_root, setting, written

__all__ = ["dropped", "partitions", "read_table", "scratch_root", "setting", "shield", "small_batches", "streamed", "written"]


#: Bytes that go to Python at once where rows hold two texts.
BATCH_BYTES = 1 << 24


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024, most_bytes: int | None = None) -> None:
    """Rows that carry whole texts go to Python in batches of at most ``rows``, and about ``most_bytes`` if that is given, so a
    batch of long texts fits in memory.

    The settings stay, as a DataFrame that is returned runs later; lower ones of the caller's are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        if most is not None and not 0 < int(str(spark.conf.get(key)).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def streamed(df: DataFrame, name: str, rows: int = 16_384) -> DataFrame:
    """``written``, for rows of numbers and short strings, which go to Python in batches of ``rows``."""
    with setting(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        return written(df, name)


def shield(docs: DataFrame, used: tuple[str, ...]):
    """``docs`` with its other columns under names that clash with nothing, and a function that gives them back."""
    hidden = {c: f"_x{i}_" for i, c in enumerate(docs.columns) if c not in used}

    def restore(out: DataFrame, *more: str) -> DataFrame:
        return out.select(*(F.col(hidden[c]).alias(c) if c in hidden else F.col(c) for c in docs.columns), *(c for c in more if c not in docs.columns))

    return docs.withColumnsRenamed(hidden), restore
