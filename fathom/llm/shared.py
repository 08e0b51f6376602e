"""The folder that the driver and all executors share, for written intermediate tables and models."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Has Spark drop a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "12m"
#: Bytes of input, as stored, that a hash range of a packed shuffle takes.
RANGE_BYTES = 256 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; a temporary one only where that is unset and all tasks run in this process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='fathom-')}")
    return f"{root.rstrip('/')}/fathom-{uuid.uuid4().hex}"


_own: dict[str, str] = {}


def local_path(uri: str) -> str:
    """The mounted path of a shared folder: executors write plain files there and map them.

    A folder in a store without a mount is refused, as memory-mapped files need a file system.
    """
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a shared mount for plain files, not {uri}")
    return parts.path


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_BYTES: an executor holds several at once, outside its heap and in its workers."""
    if spark.conf.get(BATCH).lower() in ("64mb", "64m", str(64 << 20), f"{64 << 20}b"):  # as Spark comes; another choice stays
        spark.conf.set(BATCH, BATCH_BYTES)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind: what they wrote is all that is read later."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str = "table", options: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet (with the writer's options) to the shared folder and read again: lineage and shuffle files end here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    small_batches(spark)
    with shuffles_dropped(spark):
        df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._settled)


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ranges_for(df: DataFrame) -> int:
    """Hash ranges for a packed shuffle of df: the shuffle partitions, or more where the input's stored size asks for it."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # rows from the driver have no known size
    return max(parts, -(-size // RANGE_BYTES)) if size < 1 << 56 else parts


def column(name: str):
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns as they are and the others in one struct __rest, so that no name clashes with an operator's."""
    rest = [column(c) for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("__rest"))


def together(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that apart() set aside and, of the others, df's, in the order given."""
    held = set(getattr(df.schema["__rest"].dataType, "names", ()))
    return df.select(*[F.col("__rest").getField(c).alias(c) if c in held else column(c) for c in columns])


def write_file(path: str, data: bytes) -> None:
    """Whole or not at all, also if two attempts of a task write at once."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
