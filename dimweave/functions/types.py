"""Logical types of declared fields, and coercion of text or numbers to them.

Null and the empty string are null for every type.  Coercion never raises:
`coerce` gives null for what cannot be read, and `coerces` tells the two
apart, so that loaders can set bad rows aside.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataType(Enum):
    UNDEFINED = "undefined"
    STRING = "string"
    INT = "int"
    LONG = "long"
    DOUBLE = "double"
    DATETIME = "datetime"
    BOOLEAN = "boolean"
    BYTE = "byte"
    FLOAT = "float"
    SHORT = "short"
    CHAR = "char"
    DATE = "date"
    TIME = "time"
    BLOB = "blob"


_SPARK = {
    DataType.INT: T.IntegerType(),
    DataType.LONG: T.LongType(),
    DataType.DOUBLE: T.DoubleType(),
    DataType.BOOLEAN: T.BooleanType(),
    DataType.BYTE: T.ByteType(),
    DataType.FLOAT: T.FloatType(),
    DataType.SHORT: T.ShortType(),
    DataType.BLOB: T.BinaryType(),
}

_WHOLE = {DataType.INT, DataType.LONG, DataType.SHORT, DataType.BYTE}
_REAL = {DataType.DOUBLE, DataType.FLOAT}


def spark_type(kind: DataType) -> T.DataType:
    """DATE, DATETIME and TIME are carried as text, and are read as dates where a dimension needs them."""
    return _SPARK.get(kind, T.StringType())


def coerce(col: Column, kind: DataType, source: T.DataType | None = None) -> Column:
    """`col` as `kind`; null for null, the empty string and what cannot be read.

    source: the column's type, text if not given.  Whole numbers take an
    optional minus and digits only; numbers are cut to whole ones and wrap
    around at the type's range; of text, only "true" in any case is true.
    """
    target = spark_type(kind)
    if source is not None and not isinstance(source, (T.StringType, T.CharType, T.VarcharType)):
        if type(source) is type(target):
            return col
        if isinstance(source, (T.NumericType, T.BooleanType)) and kind in _WHOLE | _REAL and not isinstance(source, T.BooleanType):
            return _wrap(col, kind) if kind in _WHOLE else col.cast(target)
        if isinstance(source, T.BinaryType) and kind == DataType.BLOB:
            return col
        col = col.cast("string")
    text = F.nullif(col, F.lit(""))
    if kind in _WHOLE:
        return F.when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast(target))
    if kind in _REAL:
        return F.trim(text).try_cast(target)
    if kind == DataType.BOOLEAN:
        return F.lower(text) == "true"
    if kind == DataType.CHAR:
        return F.substring(text, 1, 1)
    if kind == DataType.BLOB:
        return F.encode(text, "UTF-8")
    return text


_BITS = {DataType.INT: 32, DataType.SHORT: 16, DataType.BYTE: 8}


def _wrap(col: Column, kind: DataType) -> Column:
    """Cut to a whole number that keeps the type's low bits."""
    if kind == DataType.LONG:
        return col.try_cast("long")
    n = F.lit(1 << _BITS[kind])
    low = F.pmod(col.try_cast("long"), n)
    return F.when(low >= F.lit(1 << (_BITS[kind] - 1)), low - n).otherwise(low).cast(spark_type(kind))


def coerces(col: Column, kind: DataType, source: T.DataType | None = None) -> Column:
    """Whether `col` is null, empty or readable as `kind`; never null."""
    text = col.cast("string") if not isinstance(source, T.BinaryType) else F.lit("x")
    return F.coalesce(text == "", F.lit(True)) | coerce(col, kind, source).isNotNull()


def value_size(kind: DataType) -> int:
    """Bytes that a value takes, an estimate for plans."""
    return {DataType.INT: 4, DataType.LONG: 8, DataType.DOUBLE: 8, DataType.BOOLEAN: 1, DataType.BYTE: 1, DataType.FLOAT: 4, DataType.SHORT: 2, DataType.CHAR: 2}.get(kind, 16)


def parse_date(col: Column, lenient: bool = False) -> Column:
    """A date from ``yyyy-MM-dd`` text.

    lenient: short months and days and trailing text are taken, and months and
    days beyond the calendar roll over, as in 2012-13-45 = 2013-02-14.
    """
    text = col.cast("string")
    if not lenient:
        return F.try_to_date(text, "yyyy-MM-dd")
    part = lambda i: F.regexp_extract(text, r"\A\s*(\d{1,4})-(\d{1,4})-(\d{1,4})", i).try_cast("int")
    return F.when(part(1).isNotNull() & (part(1) > 0), F.date_add(F.add_months(F.make_date(part(1), F.lit(1), F.lit(1)), part(2) - 1), part(3) - 1))
