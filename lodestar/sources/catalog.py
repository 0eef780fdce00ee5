"""Catalog of the star-schema tables.

Every table is a Parquet file or directory ``<dir>/<name>.parquet``. The path goes to Spark's
own reader unchanged, so any file system that Spark reads (local, HDFS, object store) works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_SCHEMAS: dict[tuple, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the catalog, lazily; columns are pruned and filters pushed down by Spark.

    The schema is read from the files' footers once for each state of a path, as a catalog would hold
    it, so that building a plan starts no job. Files that replace others have another time or length,
    and so a schema of their own. ``refresh`` forgets all of them.
    """
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, *(state(spark, path) or ()))
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def state(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """When a file or directory was changed, and its length; None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(at):
        return None
    found = files.getFileStatus(at)
    return found.getModificationTime(), found.getLen()


def refresh() -> None:
    """Forget all schemas."""
    _SCHEMAS.clear()


def load(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Several tables by name."""
    return {n: table(spark, sf_dir, n) for n in names}


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Register the tables as temporary views for ``spark.sql``."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
