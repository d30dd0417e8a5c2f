"""Scalar functions as Column expressions: no Python runs on the executors."""

from .calendar import business_days, months
from .coerce import date_from_text, number_from_text, trimmed
from .moves import is_extreme_move, log_move

__all__ = ["business_days", "date_from_text", "is_extreme_move", "log_move", "months", "number_from_text", "trimmed"]
