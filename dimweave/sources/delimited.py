"""Sources: delimited text with declared fields, tables and other frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import split_line
from ..functions.types import DataType, coerce, coerces
from ..operators.spec import FieldSpec


@dataclass(frozen=True)
class DelimitedSource:
    """Lines of `delimiter`-separated values: no header, quotes, escapes or comments.

    Values are taken by position.  Values beyond the declared fields are left
    out; lines with fewer values, and lines with a value that its field's type
    cannot read, are rejected.  Empty values are null.
    """

    paths: tuple[str, ...]
    fields: tuple[FieldSpec, ...]
    delimiter: str = "\t"
    pattern: str | None = None
    recursive: bool = False

    def lines(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.option("recursiveFileLookup", str(self.recursive).lower())
        if self.pattern:
            reader = reader.option("pathGlobFilter", self.pattern)
        return reader.text(list(self.paths))

    def read(self, spark: SparkSession) -> DataFrame:
        return parse_lines(self.lines(spark), self.fields, self.delimiter)

    def rejects(self, spark: SparkSession) -> DataFrame:
        """The lines that `read` leaves out, with the reason."""
        return rejected_lines(self.lines(spark), self.fields, self.delimiter)


def _checked(fields: tuple[FieldSpec, ...]) -> tuple[FieldSpec, ...]:
    names = [f.name.lower() for f in fields]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"fields are declared twice: {twice}")
    return fields


def parse_lines(lines: DataFrame, fields: tuple[FieldSpec, ...], delimiter: str = "\t", column: str = "value") -> DataFrame:
    """Typed rows of the lines that can be read."""
    split = lines.select(split_line(F.col(column), delimiter).alias("v"))
    value = lambda i: F.get("v", F.lit(i))
    ok = F.size("v") >= len(fields)
    for i, f in enumerate(_checked(fields)):
        ok = ok & coerces(value(i), f.type)
    return split.where(ok).select(*(coerce(value(i), f.type).alias(f.name) for i, f in enumerate(fields)))


def rejected_lines(lines: DataFrame, fields: tuple[FieldSpec, ...], delimiter: str = "\t", column: str = "value") -> DataFrame:
    """(line, reason) of the lines that cannot be read."""
    split = lines.select(F.col(column).alias("line"), split_line(F.col(column), delimiter).alias("v"))
    reason = F.when(F.size("v") < len(fields), F.lit("too few values"))
    for i, f in enumerate(_checked(fields)):
        reason = reason.when(~coerces(F.get("v", F.lit(i)), f.type), F.lit(f"{f.name} is no {f.type.value}"))
    return split.select("line", reason.alias("reason")).where("reason is not null")


def table_source(spark: SparkSession, path_or_name: str, format: str | None = "parquet") -> DataFrame:
    """A target that was loaded before, as a source."""
    return spark.read.format(format).load(path_or_name) if format else spark.table(path_or_name)


def text_fields(*names: str) -> tuple[FieldSpec, ...]:
    return tuple(FieldSpec(n, DataType.STRING) for n in names)
