"""Log moves between consecutive prices, with IEEE outcomes for zero and negative prices spelled out.

Division by zero raises under ANSI and NaN compares as the largest value, so both are kept from arising.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_move(price: Column, before: Column) -> Column:
    """ln(price / before): infinite where one of them is zero, NULL where the ratio is negative, 0/0 or unknown."""
    ratio = F.try_divide(price, before)
    infinite = F.lit(float("inf"))
    return (
        F.when((before == 0) & (price > 0), infinite)
        .when((before != 0) & (price == 0), -infinite)
        .when((F.abs(price) == infinite) & (F.abs(before) == infinite), None)
        .when((F.abs(before) == infinite), -infinite)
        .when(ratio > 0, F.ln(ratio))
    )


def is_extreme_move(price: Column, before: Column, threshold: float) -> Column:
    return F.coalesce(F.abs(log_move(price, before)) > F.lit(threshold), F.lit(False))
