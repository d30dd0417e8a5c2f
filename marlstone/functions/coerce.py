"""Text to numbers and dates, as tolerant as the raw feeds need and no more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How the sources write "missing".
MISSING = (".", "", "NA", "-")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"
_OFFSET = r"[0-9]{2}:[0-9]{2}.*(Z|[+-][0-9]{2}:?[0-9]{2})$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def number_from_text(c: Column, missing: tuple[str, ...] = MISSING) -> Column:
    """A double, or NULL for missing tokens, unparsable text, NaN and overflow; thousands separators are dropped.

    The pattern comes before the cast: a plain cast would also take suffixes such as 1.5d and the word nan.
    """
    t = F.regexp_replace(trimmed(c), ",", "")
    value = t.try_cast("double")
    finite = value.isNotNull() & (F.abs(value) != F.lit(float("inf")))
    return F.when(t.isin(*missing), None).when(t.rlike(_INFINITE), value).when(t.rlike(_NUMBER) & finite, value)


def clean_number(c: Column) -> Column:
    """A numeric column as double, NaN as NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def date_from_text(c: Column) -> Column:
    """A calendar date or NULL; a time with an offset is first moved to UTC (the session's zone)."""
    t = trimmed(c)
    return F.when(t.rlike(_OFFSET), F.to_date(t.try_cast("timestamp"))).otherwise(t.try_cast("date"))
