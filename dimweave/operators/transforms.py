"""Row transformations: each is a function from DataFrame to DataFrame.

Names match in any case, as in Spark.  A missing column is an error when the
plan is made, not a reason to drop rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_parts as parts_of
from ..functions.types import DataType, coerce, spark_type
from .spec import Role, TargetSpec

Transform = Callable[[DataFrame], DataFrame]


def chain(*steps: Transform) -> Transform:
    """The steps one after the other."""
    return lambda df: reduce(lambda d, f: d.transform(f), steps, df)


def column_name(df: DataFrame, name: str) -> str | None:
    """The column's own spelling of `name`; the first if several match."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def required(df: DataFrame, *names: str) -> list[str]:
    found = [column_name(df, n) for n in names]
    if missing := [n for n, f in zip(names, found, strict=True) if f is None]:
        raise ValueError(f"no such column: {missing}; there are {df.columns}")
    return found


def q(name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


_OF_PYTHON = {bool: DataType.BOOLEAN, int: DataType.LONG, float: DataType.DOUBLE, str: DataType.STRING, bytes: DataType.BLOB, dt.datetime: DataType.DATETIME, dt.date: DataType.DATE, dt.time: DataType.TIME}


def _constant(value: Any, kind: DataType) -> Column:
    if value is None:
        return F.lit(None).cast(spark_type(kind))
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, (dt.date, dt.time)):
        value = value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return F.lit(bytes(value))
    return coerce(F.lit(str(value)), kind) if not isinstance(value, str) or kind not in (DataType.STRING, DataType.UNDEFINED) else F.lit(value)


def add_field(name: str, value: Any, kind: DataType | None = None) -> Transform:
    """A constant, or a Column; an existing column of the name is overwritten in place.  Dates are ISO text."""

    def step(df: DataFrame) -> DataFrame:
        col = value if isinstance(value, Column) else _constant(value, kind or _OF_PYTHON.get(type(value), DataType.STRING))
        return df.withColumn(column_name(df, name) or name, col)

    return step


def rename_field(old: str, new: str) -> Transform:
    def step(df: DataFrame) -> DataFrame:
        (have,) = required(df, old)
        if column_name(df, new) not in (None, have):
            raise ValueError(f"{old} can't become {new}: there is one")
        return df.withColumnRenamed(have, new)

    return step


def exclude_fields(*names: str) -> Transform:
    """Without these columns; unknown ones are passed over."""
    return lambda df: df.drop(*(c for n in names if (c := column_name(df, n))))


def select_fields(*names: str) -> Transform:
    return lambda df: df.select(*map(q, required(df, *names)))


def move_field(name: str, position: int) -> Transform:
    """The column at another position, from 0."""

    def step(df: DataFrame) -> DataFrame:
        (have,) = required(df, name)
        order = [c for c in df.columns if c != have]
        order.insert(position, have)
        return df.select(*map(q, order))

    return step


def copy_field(name: str, new: str) -> Transform:
    return lambda df: df.withColumn(new, q(required(df, name)[0]))


def null_to_value(name: str, value: Any) -> Transform:
    """A constant for null; the column keeps its type."""

    def step(df: DataFrame) -> DataFrame:
        (have,) = required(df, name)
        return df.withColumn(have, F.coalesce(q(have), F.lit(value).cast(df.schema[have].dataType)))

    return step


def explode_field(name: str, regex: str, targets: Sequence[str]) -> Transform:
    """A pattern's groups as new text columns, from its first match.

    A pattern without groups gives its whole match to a single target.  Rows
    without a match, null ones included, are dropped.
    """
    import re

    groups = re.compile(regex).groups
    if len(targets) != max(groups, 1):
        raise ValueError(f"{regex} has {groups} groups, and there are {len(targets)} targets")

    def step(df: DataFrame) -> DataFrame:
        (have,) = required(df, name)
        text = q(have).cast("string")
        return df.where(text.rlike(regex)).withColumns({t: F.regexp_extract(text, regex, i + (groups > 0)) for i, t in enumerate(targets)})

    return step


def date_parts(name: str, prefix: str = "") -> Transform:
    """Columns day, month, year, week and weekyear of a date."""
    return lambda df: df.withColumns({prefix + k: v for k, v in parts_of(q(required(df, name)[0]).cast("date")).items()})


def project_to(target: TargetSpec) -> Transform:
    """The target's columns in its order, coerced to its types; columns that are missing are null.

    A business key must be there.  Valid-from and valid-to stay as they come:
    the versioning step reads them as dates.
    """

    def step(df: DataFrame) -> DataFrame:
        required(df, *target.named(Role.LOOKUP))
        out = []
        for f in target.fields:
            have = column_name(df, f.name)
            if have is None:
                out.append(F.lit(None).cast(f.struct_field().dataType).alias(f.name))
            elif f.role in (Role.SCD_VALIDFROM, Role.SCD_VALIDTO, Role.SCD_LASTSEEN):
                out.append(q(have).alias(f.name))
            else:
                out.append(coerce(q(have), f.type, df.schema[have].dataType).alias(f.name, metadata={"role": f.role.name}))
        return df.select(*out)

    return step


def map_rows(batches, schema) -> Transform:
    """A user's own step over Arrow batches (an iterator in, an iterator out), for what Columns can't express."""
    return lambda df: df.mapInArrow(batches, schema)
