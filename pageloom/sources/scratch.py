"""Scratch tables between steps of an iteration.

Intermediate results that several later steps read are written as Parquet below the folder in
``spark.checkpoint.dir``, which every executor sees; a lost executor then costs a re-read, not the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: dict[str, str] = {}


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` has ``value`` meanwhile; afterwards it is as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``. Where that is unset: a temporary folder if everything
    runs in this one process (tests), else the warehouse, which a cluster shares."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            alone = spark.sparkContext.master.partition("[")[0] == "local"
            base = tempfile.mkdtemp(prefix="pageloom-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        root = f"{base.rstrip('/')}/pageloom-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a table without its lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
