"""Filters: rules on fields, in two-valued logic.

A rule is a function from a column and its type to a condition that is never
null, so that `negate` is its exact opposite: nulls pass a negated pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import DataType, spark_type
from .transforms import Transform, q, required

Rule = Callable[[Column, T.DataType], Column]


def not_null() -> Rule:
    return lambda col, kind: col.isNotNull()


def is_type(kind: DataType | T.DataType) -> Rule:
    """Whether the column has this type: a property of the schema, known when the plan is made."""
    wanted = spark_type(kind) if isinstance(kind, DataType) else kind
    return lambda col, have: F.lit(have == wanted)


_FITS = {
    bool: (T.BooleanType,),
    int: (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    float: (T.FloatType, T.DoubleType),
    str: (T.StringType,),
}


def value_match(*values: Any) -> Rule:
    """One of the values; null matches only where None is listed.  Values of another type than the column's are an error."""

    def rule(col: Column, kind: T.DataType) -> Column:
        there = [v for v in values if v is not None]
        for v in there:
            fits = _FITS.get(type(v))
            if fits and not isinstance(kind, fits):
                raise TypeError(f"{v!r} can't equal a {kind.simpleString()}")
        found = F.coalesce(col.isin(there), F.lit(False)) if there else F.lit(False)
        return found | col.isNull() if len(there) < len(values) else found

    return rule


_FLAGS = ((re.IGNORECASE, "i"), (re.DOTALL, "s"), (re.MULTILINE, "m"), (re.VERBOSE, "x"))


def pattern_match(*patterns: str, flags: int = 0) -> Rule:
    """The whole value matches one of the patterns; null matches none.  `flags` are those of `re`."""
    if not patterns:
        return lambda col, kind: F.lit(False)
    inline = "".join(c for f, c in _FLAGS if flags & f)
    head = f"(?{inline})" if inline else ""
    # a line end keeps a pattern's trailing comment from hiding the closing bracket
    tail = "\n)" if flags & re.VERBOSE else ")"
    whole = [rf"{head}\A(?:{p}{tail}\z" for p in patterns]
    return lambda col, kind: F.coalesce(reduce(lambda a, b: a | b, (col.cast("string").rlike(p) for p in whole)), F.lit(False))


def negate(rule: Rule) -> Rule:
    return lambda col, kind: ~rule(col, kind)


def condition(fn: Callable[[Column], Column]) -> Rule:
    """A user's own condition; null counts as false."""
    return lambda col, kind: F.coalesce(fn(col), F.lit(False))


def field_condition(df: DataFrame, name: str, *rules: Rule) -> Column:
    """All rules on one field."""
    (have,) = required(df, name)
    return reduce(lambda a, b: a & b, (r(q(have), df.schema[have].dataType) for r in rules), F.lit(True))


def filter_fields(**fields: Rule | tuple[Rule, ...] | list[Rule]) -> Transform:
    """Rows that pass all rules of all fields; the others are dropped."""
    return filter_by([(n, r if isinstance(r, (tuple, list)) else (r,)) for n, r in fields.items()])


def filter_by(fields: list[tuple[str, tuple[Rule, ...]]]) -> Transform:
    return lambda df: df.where(reduce(lambda a, b: a & b, (field_condition(df, n, *rs) for n, rs in fields), F.lit(True)))


def rejected_by(**fields: Rule | tuple[Rule, ...]) -> Transform:
    """The rows that filter_fields drops."""

    def step(df: DataFrame) -> DataFrame:
        kept = reduce(lambda a, b: a & b, (field_condition(df, n, *(r if isinstance(r, (tuple, list)) else (r,))) for n, r in fields.items()), F.lit(True))
        return df.where(~kept)

    return step
