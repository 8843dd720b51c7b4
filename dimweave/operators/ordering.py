"""Orders over several fields, with nulls placed and collations, and row equality."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transforms import Transform, q, required


@dataclass(frozen=True)
class SortKey:
    name: str
    ascending: bool = True
    collation: str | None = None

    def column(self) -> Column:
        """Null comes before everything: first when ascending, last when descending."""
        col = F.collate(q(self.name), self.collation) if self.collation else q(self.name)
        return col.asc_nulls_first() if self.ascending else col.desc_nulls_last()


def ordering(df: DataFrame, *keys: SortKey | str) -> list[Column]:
    """Sort columns; without keys, all of the frame's columns."""
    found = [k if isinstance(k, SortKey) else SortKey(k) for k in keys or df.columns]
    required(df, *(k.name for k in found))
    return [k.column() for k in found]


def sort_rows(*keys: SortKey | str) -> Transform:
    return lambda df: df.orderBy(*ordering(df, *keys))


def secondary_sort(keys: list[str], *within: SortKey | str) -> Transform:
    """Rows of a key together, sorted within it."""
    return lambda df: df.repartition(*map(q, keys)).sortWithinPartitions(*map(q, keys), *ordering(df, *within))


def rows_equal(a: list[Column], b: list[Column]) -> Column:
    """Whether two rows are equal field by field; null equals null."""
    if len(a) != len(b):
        return F.lit(False)
    return reduce(lambda x, y: x & y, (m.eqNullSafe(n) for m, n in zip(a, b, strict=True)), F.lit(True))
