"""Sinks: tables and tab-separated text, published by a swap.

An overwritten table is written beside its place first and takes it by
renames, so a failed load leaves the old table, and a table can be rebuilt
from itself.  What a crash between the two renames leaves behind is put right
by the next `recover`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _fs(spark, old)
    if not fs.rename(where, _fs(spark, new)[1]):
        raise OSError(f"{old} can't be renamed to {new}")


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.mkdirs(where)


def copy(spark: SparkSession, source: str, target: str) -> None:
    (a, x), (b, y) = _fs(spark, source), _fs(spark, target)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{source} can't be copied to {target}")


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files below `path`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def total_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return list_files(spark, path, pattern).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def count_lines(spark: SparkSession, *paths: str) -> int:
    return spark.read.text(list(paths)).count()


def copy_first_lines(spark: SparkSession, source: str, target: str, n: int) -> None:
    """The first n lines of the oldest file of a text, in their order; n is what the driver holds."""
    fs, where = _fs(spark, source)
    files = sorted((s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    lines = spark.read.text(files[0][1]).take(n) if files else []
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(target)


def drop_empty_files(spark: SparkSession, path: str) -> int:
    """Removes files of length 0 directly below `path`; their number."""
    fs, where = _fs(spark, path)
    empty = [s.getPath() for s in fs.listStatus(where) if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith("_")]
    for p in empty:
        fs.delete(p, False)
    return len(empty)


def recover(spark: SparkSession, path: str) -> None:
    """Ends a swap that was cut off: the old table comes back if the new one isn't in place."""
    path = path.rstrip("/")
    old = f"{path}.old"
    if exists(spark, old):
        if exists(spark, path):
            remove(spark, old)
        else:
            rename(spark, old, path)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    path = path.rstrip("/")
    recover(spark, path)
    had = exists(spark, path)
    if had:
        rename(spark, path, f"{path}.old")
    try:
        rename(spark, staged, path)
    except Exception:
        if had:
            rename(spark, f"{path}.old", path)
        raise
    if had:
        remove(spark, f"{path}.old")


def line_text(df: DataFrame, delimiter: str = "\t") -> Column:
    """A row as one line; null is nothing, and nothing is quoted or escaped."""
    cells = [F.coalesce(df[f"`{c}`"].cast("string"), F.lit("")) for c in df.columns]
    return F.concat_ws(delimiter, *cells)


def to_lines(df: DataFrame, delimiter: str = "\t") -> DataFrame:
    return df.select(line_text(df, delimiter).alias("value"))


def publish(df: DataFrame, path: str, mode: str = "overwrite", format: str = "parquet", compression: str | None = None, partition_by: tuple[str, ...] = (), delimiter: str = "\t") -> None:
    """Writes a table: mode overwrite (by a swap), append, or fail if there is one.

    format: parquet or another of Spark's, or tsv for delimited text.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if mode not in ("overwrite", "append", "error"):
        raise ValueError(f"no such mode: {mode}")

    def write(to: str, how: str) -> None:
        writer = (to_lines(df, delimiter) if format == "tsv" else df).write.mode(how).format("text" if format == "tsv" else format)
        if compression:
            writer = writer.option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(to)

    if mode != "overwrite":
        recover(spark, path)
        write(path, mode)
        return
    staged = f"{path}.new"
    remove(spark, staged)
    try:
        write(staged, "error")
    except Exception:
        remove(spark, staged)
        raise
    swap(spark, staged, path)


def fan_out(df: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[str, DataFrame], None]) -> dict[str, int]:
    """Several named targets from one parent that is computed once; the rows written to each."""
    kept, counts = df.persist(), {}
    try:
        for name, step in targets.items():
            seen = Observation(name)
            write(name, step(kept).observe(seen, F.count(F.lit(1)).alias("rows")))
            counts[name] = seen.get["rows"]
    finally:
        kept.unpersist()
    return counts
