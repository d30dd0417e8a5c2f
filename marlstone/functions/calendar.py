"""Distances between dates in business days (Monday to Friday, no holidays) and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Monday; counts of weekdays run from here.
EPOCH = "1970-01-05"


def _weekdays_since_epoch(d: Column) -> Column:
    n = F.datediff(d, F.to_date(F.lit(EPOCH)))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days(a: Column, b: Column) -> Column:
    """Weekdays in [a, b)."""
    return (_weekdays_since_epoch(b) - _weekdays_since_epoch(a)).cast("long")


def months(a: Column, b: Column) -> Column:
    """Calendar months from a's to b's."""
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")
