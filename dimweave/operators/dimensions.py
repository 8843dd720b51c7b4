"""Dimensions: one row for each key, or one for each version of it.

Both are a single shuffle by the business key.  Rows without a business key
are set aside by `without_key`, and take no part.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import parse_date
from .spec import Role, TargetKind, TargetSpec
from .transforms import q

#: The first version's date where none is given.
FIRST_DAY = dt.date(1900, 1, 1)


def has_key(keys: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (q(k).isNotNull() for k in keys))


def without_key(df: DataFrame, target: TargetSpec) -> DataFrame:
    """The rows that no dimension can take: a part of their business key is null."""
    return df.where(~has_key(target.named(Role.LOOKUP)))


def latest_by_key(df: DataFrame, keys: list[str], sid: str, attributes: list[str]) -> DataFrame:
    """One row for each key: the least surrogate key, the attributes of the row with the greatest.

    Aggregated before the shuffle, too.  Attributes are taken together, nulls
    included.
    """
    grouped = df.where(has_key(keys)).groupBy(*map(q, keys))
    # the struct makes rows of equal surrogate keys come out alike on every run
    last = F.max_by(F.struct(*map(q, attributes)), F.struct(q(sid), *map(q, attributes))) if attributes else None
    out = grouped.agg(F.min(q(sid)).alias(sid), *([last.alias("last_")] if attributes else []))
    return out.select(*map(q, keys), q(sid), *(F.col("last_").getField(a).alias(a) for a in attributes))


def distinct_keys(df: DataFrame, keys: list[str], sid: str | None = None) -> DataFrame:
    """A dimension of keys only."""
    return df.where(has_key(keys)).select(*map(q, keys)).distinct() if sid is None else latest_by_key(df, keys, sid, [])


def as_date(col: Column, kind: T.DataType, lenient: bool = False) -> Column:
    return parse_date(F.nullif(col, F.lit("")), lenient) if isinstance(kind, T.StringType) else col.cast("date")


def versions_by_key(
    df: DataFrame,
    keys: list[str],
    sid: str,
    valid_from: str,
    valid_to: str = "validto",
    version: str = "version",
    load_date: dt.date | None = None,
    order_by: list[str] | None = None,
    track: tuple[str, ...] = (),
    lenient_dates: bool = False,
    last_seen: str | None = None,
) -> DataFrame:
    """All versions of each key, numbered from 1, each valid until the next.

    Rows are visited in the order of `order_by` (the surrogate key by
    default).  The first row's missing date is FIRST_DAY, a later row's is
    `load_date`.  A row whose date isn't after every kept one's is late, and
    dropped; so is a row with a date that can't be read.  Every kept row is a
    version, even with the same attributes; with `track` only rows in which one
    of these columns differs from the kept row before are.  Rows that change
    nothing still make later ones late: `last_seen` names a column in which a
    version that was built before has the last such date, and gets it here.
    """
    kind = df.schema[valid_from].dataType
    order = [q(c) for c in (order_by or [sid])]
    w = Window.partitionBy(*map(q, keys)).orderBy(*order)
    given = q(valid_from)
    blank = given.isNull() | (given == "") if isinstance(kind, T.StringType) else given.isNull()
    missing = F.when(F.row_number().over(w) == 1, F.lit(FIRST_DAY)).otherwise(F.lit(load_date).cast("date"))
    dated = df.where(has_key(keys)).withColumn("day_", F.when(blank, missing).otherwise(as_date(given, kind, lenient_dates)))
    # kept dates rise strictly, and a dropped one never exceeds the last kept: so that is the greatest so far
    seen = F.greatest("day_", q(last_seen).cast("date")) if last_seen else F.col("day_")
    greatest = F.max("seen_").over(w.rowsBetween(Window.unboundedPreceding, -1))
    dated = dated.withColumn("seen_", seen)
    kept = dated.withColumn("last_", greatest).where("day_ is not null and (last_ is null or day_ > last_)")
    if track:
        changed = reduce(lambda a, b: a | b, (~q(c).eqNullSafe(F.lag(q(c)).over(w)) for c in track))
        kept = kept.withColumn("new_", (F.row_number().over(w) == 1) | changed)
        if last_seen:
            kept = kept.withColumn("nth_", F.sum(F.col("new_").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            kept = kept.withColumn("seen_", F.max("seen_").over(Window.partitionBy(*map(q, keys), "nth_"))).drop("nth_")
        kept = kept.where("new_").drop("new_")
    if last_seen:
        kept = kept.withColumn(last_seen, F.col("seen_"))
    out = kept.withColumns({valid_from: F.col("day_"), version: F.row_number().over(w), valid_to: F.lead("day_").over(w)})
    return out.drop("day_", "last_", "seen_")


def unreadable_dates(df: DataFrame, valid_from: str, lenient_dates: bool = False) -> DataFrame:
    """Rows whose date is given, but can't be read."""
    kind = df.schema[valid_from].dataType
    return df.where((q(valid_from).cast("string") != "") & as_date(q(valid_from), kind, lenient_dates).isNull())


def build_dimension(rows: DataFrame, target: TargetSpec, load_date: dt.date | None = None, existing: DataFrame | None = None, order_by: list[str] | None = None, lenient_dates: bool = False) -> DataFrame:
    """The dimension of `rows`, projected to `target`, and of what it held before.

    Existing rows come in with their own surrogate keys and dates; versions
    and valid-to are worked out anew, so loading in parts gives what loading at
    once gives, if surrogate keys rise from part to part.  (In an overwritten
    dimension that keeps only the least key, a later part otherwise counts as
    newer than all rows before.)  A tracked dimension needs a last-seen field
    for it; without one, adding to existing rows is an error.
    """
    if target.track and existing is not None and not target.first(Role.SCD_LASTSEEN):
        raise ValueError(f"{target.name} tracks changes: without a last-seen field it can't be loaded in parts")
    keys, sid = list(target.named(Role.LOOKUP)), target.first(Role.PRI)
    if existing is not None:
        rows = align(existing, target).unionByName(align(rows, target))
    if target.kind == TargetKind.DIMENSION:
        other = [f.name for f in target.fields if f.role not in (Role.PRI, Role.LOOKUP)]
        out = latest_by_key(rows, keys, sid, other)
    else:
        start, end, version = (target.first(r) for r in (Role.SCD_VALIDFROM, Role.SCD_VALIDTO, Role.SCD_VERSION))
        out = versions_by_key(rows, keys, sid, start, end or "validto_", version or "version_", load_date, order_by, target.track, lenient_dates, target.first(Role.SCD_LASTSEEN))
    return out.select(*(q(f.name).cast(f.struct_field().dataType).alias(f.name) for f in target.fields))


def align(df: DataFrame, target: TargetSpec) -> DataFrame:
    """The target's columns; dates as dates, so that old and new rows fit together."""
    out = []
    for f in target.fields:
        kind = df.schema[f.name].dataType
        dated = f.role in (Role.SCD_VALIDFROM, Role.SCD_VALIDTO, Role.SCD_LASTSEEN)
        out.append((as_date(q(f.name), kind) if dated else q(f.name)).alias(f.name))
    return df.select(*out)
