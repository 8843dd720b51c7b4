"""Declared fields, their roles, and load targets."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from ..functions.types import DataType, spark_type


class Role(Enum):
    PRI = "surrogate key"
    LOOKUP = "business key"
    OTHER = "attribute"
    SCD_VALIDFROM = "valid from"
    SCD_VALIDTO = "valid to"
    SCD_VERSION = "version"
    SCD_LASTSEEN = "last seen"


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: DataType = DataType.STRING
    role: Role = Role.OTHER

    def struct_field(self) -> T.StructField:
        """The Spark field; the role travels in its metadata."""
        kind = T.DateType() if self.role in (Role.SCD_VALIDFROM, Role.SCD_VALIDTO, Role.SCD_LASTSEEN) else spark_type(self.type)
        return T.StructField(self.name, kind, True, {"role": self.role.name})


class TargetKind(Enum):
    DIMENSION = "one row for each business key"
    VERSIONED = "one row for each version of a business key"
    FACT = "facts"


@dataclass(frozen=True)
class TargetSpec:
    """A table to load: ordered fields with roles.

    Dimensions need a surrogate key and a business key, of one or more fields;
    versioned ones a valid-from field, and may have valid-to and version.  With
    `track`, a last-seen field keeps the date of the last row that changed nothing.
    """

    name: str
    kind: TargetKind
    fields: tuple[FieldSpec, ...]
    location: str | None = None
    track: tuple[str, ...] = field(default=())

    def __post_init__(self):
        names = [f.name.lower() for f in self.fields]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"{self.name}: fields are declared twice: {twice}")
        if self.kind != TargetKind.FACT:
            if len(self.named(Role.PRI)) != 1:
                raise ValueError(f"{self.name}: a dimension has one surrogate key")
            if not self.named(Role.LOOKUP):
                raise ValueError(f"{self.name}: a dimension has a business key")
        if self.kind == TargetKind.VERSIONED and len(self.named(Role.SCD_VALIDFROM)) != 1:
            raise ValueError(f"{self.name}: a versioned dimension has a valid-from field")

    def named(self, role: Role) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.role == role)

    def first(self, role: Role) -> str | None:
        return next(iter(self.named(role)), None)

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.named(Role.OTHER)

    def schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])


def dimension(name: str, *fields: FieldSpec, location: str | None = None) -> TargetSpec:
    return TargetSpec(name, TargetKind.DIMENSION, fields, location)


def versioned(name: str, *fields: FieldSpec, location: str | None = None, track: tuple[str, ...] = ()) -> TargetSpec:
    return TargetSpec(name, TargetKind.VERSIONED, fields, location, track)


def fact(name: str, *fields: FieldSpec, location: str | None = None) -> TargetSpec:
    return TargetSpec(name, TargetKind.FACT, fields, location)
