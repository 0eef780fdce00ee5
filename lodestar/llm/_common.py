"""What the operators of this subpackage share: the shared work folder and Arrow text access."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors by the shared folder, once for each application, so that they need no copy of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or not (_local(spark) or spark.conf.get("spark.checkpoint.dir", None)):
        return  # on a cluster without a shared folder the executors need the package themselves
    _SHIPPED.add(context.applicationId)
    package, packed = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    folder, name = shared_dir(spark), f"lodestar-{uuid.uuid4().hex[:12]}.zip"
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(packed.getvalue())
    context.addPyFile(f"{folder}/{name}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so that any store that Spark reads will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder (tests); a cluster gets an error,
    as no folder of one machine is seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """A folder of its own below the shared folder, for one run of one operator.

    ``save`` writes a table and reads it again, which cuts lineage: what is built on it no longer
    depends on the executors that made it. ``drop`` removes a table that is no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Let Spark remove the shuffle files of finished steps: it does so as their plans are collected."""
        self.spark.sparkContext._jvm.System.gc()


def doc_key() -> list:
    """Two columns that identify a document by id and content; equal rows share a key.

    Positions in a scan are no identity: they change if executors are lost. Rows that agree in id
    and text get the same key, and so the same result.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("k1"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull(), F.col("text").isNull()).alias("k2"),
    ]


def utf8(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(1, np.int64), memoryview(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, memoryview(column.buffers()[2] or b"")


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each value's UTF-8 bytes; a null is empty."""
    offsets, data = utf8(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(data[a:b])


def runs(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about ``most`` bytes of text each, so that memory is bounded."""
    offsets, _ = utf8(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def schema(df: DataFrame, keep: list[str], more: str) -> StructType:
    """The fields ``keep`` of a table, then those of a DDL string."""
    return StructType([df.schema[c] for c in keep] + (StructType.fromDDL(more).fields if more else []))
