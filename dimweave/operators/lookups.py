"""Lookups: business keys to surrogate keys, by equality or as of a date.

Each lookup is a left join of its own, so two lookups into one dimension by
different columns don't meet; Spark reuses the broadcast.  The dimension is
broadcast only after its size has been checked; a larger one is joined by a
shuffle, where adaptive execution splits hot keys.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dimensions import as_date
from .transforms import Transform, column_name, q, required

#: Bytes of a dimension's keys that are broadcast at most, by the optimizer's statistics.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Lookup:
    """Where a dimension's surrogate keys are found.

    dimension: the loaded dimension; keys: its business key; sid: its
    surrogate key.  For versioned ones also valid_from and valid_to.
    """

    dimension: DataFrame
    keys: tuple[str, ...]
    sid: str
    valid_from: str | None = None
    valid_to: str | None = None

    @property
    def is_versioned(self) -> bool:
        return self.valid_from is not None


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, if the frame's estimated size allows it."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def _same(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType) -> Column:
    """Keys compare as text; equal types need no cast."""
    return a == b if kind_a == kind_b else a.cast("string") == b.cast("string")


def _joined(df: DataFrame, lookup: Lookup, columns: tuple[str, ...], extra: list[str], limit: int) -> tuple[DataFrame, list[str], list[Column]]:
    if len(columns) != len(lookup.keys):
        raise ValueError(f"{columns} can't be looked up by {lookup.keys}")
    dim = lookup.dimension
    keys = required(dim, *lookup.keys)
    small = dim.select(*(q(k).alias(f"key{i}_") for i, k in enumerate(keys)), q(required(dim, lookup.sid)[0]).alias("sid_"), *(q(c).alias(f"{n}_") for c, n in zip(extra, ("from", "to"), strict=False)))
    on = [_same(df[f"`{c}`"], F.col(f"key{i}_"), df.schema[c].dataType, dim.schema[k].dataType) for i, (c, k) in enumerate(zip(columns, keys, strict=True))]
    return sized(small, limit), [f"key{i}_" for i in range(len(keys))], on


def _source(df: DataFrame, by: str | tuple[str, ...], missing_default: bool) -> tuple[str, ...] | None:
    by = (by,) if isinstance(by, str) else tuple(by)
    found = [column_name(df, c) for c in by]
    if None in found:
        if missing_default:
            return None
        required(df, *by)
    return tuple(found)


def _finish(df: DataFrame, joined: DataFrame, into: str, default: int, overwrite: bool) -> DataFrame:
    have = column_name(df, into)
    sid = F.coalesce(F.col("sid_"), F.lit(default))
    if have is None:
        return joined.select(*(q(c) for c in df.columns), sid.alias(into))
    if overwrite:
        return joined.select(*(sid.alias(c) if c == have else q(c) for c in df.columns))
    return joined.select(*(q(c) for c in df.columns))


def look_up(lookup: Lookup, by: str | tuple[str, ...], into: str | None = None, default: int = -1, overwrite: bool = True, missing_default: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> Transform:
    """Adds the surrogate key of the row's business key; `default` for null and unknown keys.

    A versioned dimension has several surrogate keys for one business key, so
    it needs look_up_as_of.  missing_default: where the column isn't there at
    all, every row takes the default.
    """
    if lookup.is_versioned:
        raise ValueError("a versioned dimension is looked up as of a date")
    name = into or lookup.sid

    def step(df: DataFrame) -> DataFrame:
        columns = _source(df, by, missing_default)
        if columns is None:
            return df.withColumn(name, F.lit(default))
        dim, _, on = _joined(df, lookup, columns, [], broadcast_bytes)
        return _finish(df, df.join(dim, reduce(lambda a, b: a & b, on), "left"), name, default, overwrite)

    return step


def look_up_as_of(
    lookup: Lookup, by: str | tuple[str, ...], date: str, into: str | None = None, default: int = -1, as_of: dt.date | None = None, overwrite: bool = True, missing_default: bool = False, broadcast_bytes: int = BROADCAST_BYTES
) -> Transform:
    """Adds the surrogate key of the version that is valid on the row's date.

    A date before the first version gives `default`; no date means `as_of`
    (the day of the load), or the current version if that isn't given.
    """
    if not lookup.is_versioned:
        raise ValueError("only a versioned dimension is looked up as of a date")
    name = into or lookup.sid

    def step(df: DataFrame) -> DataFrame:
        columns = _source(df, by, missing_default)
        if columns is None:
            return df.withColumn(name, F.lit(default))
        (day,) = required(df, date)
        dim, _, on = _joined(df, lookup, columns, required(lookup.dimension, lookup.valid_from, lookup.valid_to), broadcast_bytes)
        when = F.coalesce(as_date(df[f"`{day}`"], df.schema[day].dataType), F.lit(as_of or dt.date(9999, 12, 31)))
        # versions of a key are disjoint, so at most one row matches
        valid = (F.col("from_") <= when) & (F.col("to_").isNull() | (when < F.col("to_")))
        return _finish(df, df.join(dim, reduce(lambda a, b: a & b, [*on, valid]), "left"), name, default, overwrite)

    return step


def lookup_index(dimension: DataFrame, lookup: Lookup) -> DataFrame:
    """A dimension's index as a table: key and surrogate key, or key and versions, newest first."""
    keys = [q(k) for k in lookup.keys]
    if not lookup.is_versioned:
        return dimension.select(*keys, q(lookup.sid))
    # the versions of one key only
    return dimension.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(q(lookup.valid_from).alias("validfrom"), q(lookup.sid).alias("sid"))), asc=False).alias("versions"))
