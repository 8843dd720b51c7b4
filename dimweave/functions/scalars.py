"""Scalar helpers as Columns: text, dates, arrays, URLs.

All are built-in expressions, so they stay inside generated code.  Text
helpers treat white space as every character up to U+0020.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import parse_date

_TRIM = r"\A[\x00-\x20]+|[\x00-\x20]+\z"


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- emptiness and equality -------------------------------------------------


def is_empty(col: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(F.regexp_replace(col, _TRIM, "") == "", F.lit(True))


def is_not_empty(col: Column) -> Column:
    return ~is_empty(col)


def is_empty_or_null_text(col: Column) -> Column:
    """As is_empty, and the text "null" in any case."""
    return is_empty(col) | F.coalesce(F.lower(F.regexp_replace(col, _TRIM, "")) == "null", F.lit(False))


def is_whitespace(char: Column, excepted: str | None = None) -> Column:
    """A blank or tab that is not `excepted`."""
    out = char.isin(" ", "\t")
    return F.coalesce(out & (char != excepted) if excepted is not None else out, F.lit(False))


def names_match(a: Column, b: Column) -> Column:
    """Equal names in any case; null equals null."""
    return F.lower(a).eqNullSafe(F.lower(b))


def null_safe_equals(a: Column, b: Column, collation: str | None = None) -> Column:
    return F.collate(a, collation).eqNullSafe(F.collate(b, collation)) if collation else a.eqNullSafe(b)


def compare(a: Column, b: Column, case_sensitive: bool = True, collation: str | None = None) -> Column:
    """-1, 0 or 1; null comes first."""
    if not case_sensitive:
        a, b = F.lower(a), F.lower(b)
    if collation:
        a, b = F.collate(a, collation), F.collate(b, collation)
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def text_matches(a: Column, b: Column, case_sensitive: bool = True, allow_empty: bool = True) -> Column:
    """Equality of texts, no pattern; without `allow_empty` empty texts match nothing."""
    x, y = (a, b) if case_sensitive else (F.lower(a), F.lower(b))
    same = x.eqNullSafe(y)
    return same if allow_empty else same & is_not_empty(a) & is_not_empty(b)


def if_null(col: Column, default: Any) -> Column:
    return F.coalesce(col, _col(default))


def is_integer(col: Column) -> Column:
    """Whether a text is a whole number of the 32-bit range."""
    return F.coalesce(col.rlike(r"\A-?[0-9]+\z") & col.try_cast("int").isNotNull(), F.lit(False))


# --- dates --------------------------------------------------------------------


def date_after(a: Column, b: Column, include: bool = False) -> Column:
    """Whether day a is after day b (or on it); false where either can't be read."""
    x, y = parse_date(a), parse_date(b)
    return F.coalesce(x >= y if include else x > y, F.lit(False))


def date_before(day: Column, when: Column) -> Column:
    """Whether `day` is before `when`; without a `when`, whether there is a day at all."""
    return (
        F.when(is_empty_or_null_text(when), ~is_empty_or_null_text(day))
        .when(is_empty_or_null_text(day), F.lit(False))
        .otherwise(F.coalesce(parse_date(day) < parse_date(when), F.lit(False)))
    )


def date_to_millis(col: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Milliseconds since 1970 in the session's time zone; null where it can't be read."""
    return F.unix_millis(F.try_to_timestamp(col, F.lit(pattern)))


def timestamp_text(now: dt.datetime | Column) -> Column:
    """``yyyyMMddHHmmss`` of a given time: the clock is always handed in."""
    return F.date_format(_col(now), "yyyyMMddHHmmss")


def today_text(today: dt.date | Column) -> Column:
    return F.date_format(_col(today), "yyyy-MM-dd")


def date_parts(col: Column) -> dict[str, Column]:
    """Day, month, year, ISO week and the year that the week belongs to."""
    return {"day": F.dayofmonth(col), "month": F.month(col), "year": F.year(col), "week": F.weekofyear(col), "weekyear": F.extract(F.lit("YEAROFWEEK"), col)}


# --- text ----------------------------------------------------------------------


def normalize_url(col: Column) -> Column:
    """Runs of three slashes or more, but those after a colon, become two."""
    return F.regexp_replace(col, r"([^:]/)/{2,}", "$1/")


def count_char(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def pad_left(col: Column, n: int, char: str) -> Column:
    """Padded to n characters; longer texts stay whole."""
    return F.when(F.length(col) >= n, col).otherwise(F.lpad(col, n, char))


def pad_right(col: Column, n: int, char: str) -> Column:
    return F.when(F.length(col) >= n, col).otherwise(F.rpad(col, n, char))


def repeat(col: Column, n: int) -> Column:
    """Nothing for a negative n."""
    return F.repeat(col, n)


def split_any(col: Column, delimiters: str, trim: bool = False) -> Column:
    """Tokens between any of the delimiters; empty ones are skipped."""
    inside = "".join("\\" + c if c in r"\]^-[&~|" else c for c in delimiters)
    parts = F.split(col, f"[{inside}]")
    if trim:
        parts = F.transform(parts, lambda x: F.regexp_replace(x, _TRIM, ""))
    return F.filter(parts, lambda x: x != "")


def split_quoted(col: Column) -> Column:
    """Fields of a line with commas; commas between double quotes don't count.  Null if quotes are unbalanced."""
    field = r'\G(?:^|,)((?:"[^"]*"|[^",])*)'
    parts = F.transform(F.regexp_extract_all(col, F.lit(field), 1), lambda x: F.regexp_replace(x, '"', ""))
    return F.when(count_char(col, '"') % 2 == 0, parts)


def token_at(col: Column, pattern: str, i: int) -> Column:
    """The i-th token from 0; null beyond the last."""
    return F.get(F.split(col, pattern, -1), F.lit(i))


def split_line(col: Column, delimiter: str) -> Column:
    """All tokens of a line, empty ones as null."""
    return F.transform(F.split(col, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda x: F.nullif(x, F.lit("")))


def column_name_of(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA: up to seven letters."""
    letter = lambda n: F.char(F.lit(65) + n)
    out, n = F.lit(""), index.cast("long")
    for _ in range(7):
        out = F.when(n >= 0, F.concat(letter(F.pmod(n, F.lit(26))), out)).otherwise(out)
        n = F.when(n >= 0, F.floor(n / 26) - 1).otherwise(F.lit(-1))
    return F.when(index >= 0, out)


def column_index_of(name: Column) -> Column:
    """The index of a column name of letters, the reverse of column_name_of."""
    value = F.aggregate(F.filter(F.split(F.upper(name), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.when(name.rlike(r"\A[A-Za-z]{1,7}\z"), value - 1)


def to_utf8(col: Column) -> Column:
    return F.encode(col, "UTF-8")


def from_utf8(col: Column) -> Column:
    return F.decode(col, "UTF-8")


def printable_char(char: Column) -> Column:
    """The character, or its code in hex where it is a control character."""
    return F.when(char.rlike(r"\A[\x00-\x1F\x7F]"), F.concat(F.lit("0x"), F.lpad(F.hex(F.ascii(char)), 2, "0"))).otherwise(char)


def random_text(n: int, seed: int | None = None) -> Column:
    """n of ``A-Z0-9`` at random."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    return F.concat(F.lit(""), *(F.substring(letters, (F.floor(F.rand(None if seed is None else seed + i) * 36) + 1).cast("int"), F.lit(1)) for i in range(n)))


def type_name(col: Column) -> Column:
    return F.typeof(col)


# --- arrays and maps ---------------------------------------------------------


def array_text(col: Column, separator: str) -> Column:
    """Joined elements; nulls print as "null", no array as nothing."""
    return F.coalesce(F.array_join(F.transform(col, lambda x: x.cast("string")), separator, "null"), F.lit(""))


def resize_array(col: Column, delta: int, fill: Any = None) -> Column:
    """Longer by delta elements of `fill`, or shorter."""
    if delta >= 0:
        return F.concat(col, F.array_repeat(_col(fill), delta)) if delta else col
    return F.slice(col, 1, F.greatest(F.size(col) + delta, F.lit(0)))


def merge_arrays(a: Column, b: Column) -> Column:
    """One after the other, repeats kept; a missing array is empty."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def key_for_value(mapping: Column, value: Any) -> Column:
    """The first key with this value; null without one."""
    return F.get(F.map_keys(F.map_filter(mapping, lambda k, v: v.eqNullSafe(_col(value)))), F.lit(0))
