"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .publish import remove

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset, on a single machine, a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='dimweave-')}")
    return _own_dir[0]


def scratch_path(spark: SparkSession) -> str:
    """A new path for a table that goes when the driver's Python ends, as lazily read results may need it until then."""
    path = f"{shared_dir(spark)}/dimweave-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written once and reread: it comes out alike from then on, whatever made it."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone at exit
        pass
