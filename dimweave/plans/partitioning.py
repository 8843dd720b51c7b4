"""Layouts by key: partitioned files, bucketed tables, and merges without a shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dimensions import align, build_dimension
from ..operators.spec import Role, TargetSpec
from ..operators.transforms import q


def part_of(parts: int, *keys: str) -> Column:
    """The part of a key, from 0: Spark's own hash, so it is where hash partitioning and bucketing put it."""
    return F.pmod(F.hash(*map(q, keys)), F.lit(parts))


def prepartition(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows of one key in one partition, sorted by it."""
    return df.repartition(parts, *map(q, keys)).sortWithinPartitions(*map(q, keys))


def write_parts(df: DataFrame, path: str, parts: int, *keys: str, format: str = "parquet") -> None:
    """One folder for each part, sorted by key."""
    df.withColumn("part", part_of(parts, *keys)).repartition(parts, "part").sortWithinPartitions("part", *keys).write.partitionBy("part").format(format).save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str, mode: str = "overwrite", path: str | None = None) -> None:
    """A bucketed, sorted table, in the warehouse or at `path`: joins and windows by the key need no shuffle."""
    writer = df.repartition(buckets, *map(q, keys)).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def merge_bucketed(old: DataFrame, new: DataFrame, target: TargetSpec, load_date: dt.date | None = None) -> DataFrame:
    """A big dimension and its increment, as one load would give.

    Both sides are tables bucketed alike by the business key.  A union of
    bucketed scans, or a full outer join, loses their partitioning; so keys
    that the dimension has take their new rows by a left join, new keys are
    what an anti join leaves, and both keep their side's buckets: no shuffle.
    """
    keys = list(target.named(Role.LOOKUP))
    cols = [f.name for f in target.fields]
    rest = [c for c in cols if c not in keys]
    by_key = lambda df, name: df.select(*map(q, cols)).groupBy(*map(q, keys)).agg(F.collect_list(F.struct(*map(q, rest))).alias(name))
    met = by_key(align(old, target), "old_").join(by_key(align(new, target), "new_"), keys, "left")
    every = met.select(*map(q, keys), F.explode(F.concat("old_", F.coalesce("new_", F.slice("old_", 1, 0)))).alias("row_"))
    known = every.select(*(q(c) if c in keys else F.col("row_").getField(c).alias(c) for c in cols))
    fresh = new.select(*map(q, cols)).join(old.select(*map(q, keys)), keys, "left_anti")
    return build_dimension(known, target, load_date).unionByName(build_dimension(fresh.select(*map(q, cols)), target, load_date))
