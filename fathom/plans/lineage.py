"""Cuts in long plans: iterative operators write each round's table and read it again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and all tasks run in this process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='fathom-')}")
    return f"{root.rstrip('/')}/cut-{uuid.uuid4().hex}"


_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
