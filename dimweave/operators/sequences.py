"""Surrogate-key sequences: dense numbers, and a table of what comes next.

Numbers are given without gathering rows in one task: each partition's rows are
counted, the counts are summed up to every partition's first number, and rows
take their place in it.  Rows are written once together with their partition
and place, as a frame that is computed twice need not come out in the same
partitions.  A sequence's next number is stored only after the data that used
its numbers is, so a failed load never gives a number away twice in published
data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.publish import exists, publish, recover
from ..plans.scratch import stored
from .transforms import Transform, q


def dense_ids(df: DataFrame, name: str = "sid", start: int = 0) -> DataFrame:
    """Numbers start, start + 1, ... in the order of the frame's partitions; `df` is computed and stored once."""
    at = F.monotonically_increasing_id()  # the partition in the high bits, the place in it in the low 33
    kept = stored(df.drop(name).withColumns({"part_": F.shiftright(at, 33), "place_": at.bitwiseAND((1 << 33) - 1)}))
    counts = kept.groupBy("part_").agg(F.count("*").alias("rows_"))
    # one row for each partition
    first = counts.withColumn("first_", F.sum("rows_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows_")).drop("rows_")
    return kept.join(F.broadcast(first), "part_").withColumn(name, (F.col("first_") + F.col("place_") + start).cast("long")).drop("part_", "place_", "first_")


def numbered_by(df: DataFrame, *order: str, name: str = "sid", start: int = 0) -> DataFrame:
    """Numbers in the order of `order`: rows are partitioned by ranges and sorted in them, one shuffle."""
    keys = [q(c) for c in order]
    return dense_ids(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name, start)


def add_sequence(name: str, *order: str, start: int = 0) -> Transform:
    """A field of dense numbers from `start` on: in the order of `order`, or that of the frame's partitions."""
    return lambda df: numbered_by(df, *order, name=name, start=start) if order else dense_ids(df, name, start)


class SequenceStore:
    """Sequences' next numbers and tables' row counts, kept as two small tables under `location`."""

    SEQUENCES = "name string, next long"
    COUNTS = "name string, rows long"

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def _load(self, table: str, schema: str, value: str) -> dict[str, int]:
        path = f"{self.location}/{table}"
        recover(self.spark, path)
        if not exists(self.spark, path):
            return {}
        return {r["name"]: r[value] for r in self.spark.read.schema(schema).parquet(path).collect()}  # one row for each name

    def _save(self, table: str, schema: str, values: dict[str, int]) -> None:
        publish(self.spark.createDataFrame(sorted(values.items()), schema).coalesce(1), f"{self.location}/{table}", "overwrite")

    def next_of(self, name: str) -> int:
        """What the sequence gives next; 0 at first."""
        return self._load("sequences", self.SEQUENCES, "next").get(name, 0)

    def commit(self, **next_numbers: int) -> None:
        """Stores what comes next; a sequence never goes back."""
        have = self._load("sequences", self.SEQUENCES, "next")
        self._save("sequences", self.SEQUENCES, have | {n: max(v, have.get(n, 0)) for n, v in next_numbers.items()})

    def row_counts(self) -> dict[str, int]:
        return self._load("counts", self.COUNTS, "rows")

    def set_row_counts(self, **counts: int) -> None:
        self._save("counts", self.COUNTS, self.row_counts() | counts)
