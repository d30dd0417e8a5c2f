"""Bars from ticks, price panels, returns, and the scalar rules of a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import BEFORE, with_previous

PRICES = ("open", "high", "low", "close", "adj_close")


def daily_bars(ticks: DataFrame, entity: str, time: str, value: str, tie: str) -> DataFrame:
    """entity, date, open, high, low, close, volume: one partial aggregation, first and last by (time, tie)."""
    at = F.struct(time, tie)
    return ticks.groupBy(F.col(entity), F.to_date(time).alias("date")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("volume")
    )


def panel(df: DataFrame, date: str, entity: str, value: str, entities: list[str], names: list[str] | None = None) -> DataFrame:
    """One column per listed entity: the greatest value of each date. The list is fixed, so nothing is scanned for it."""
    each = [F.max(F.when(F.col(entity) == e, F.col(value))).alias(n) for e, n in zip(entities, names or [e.lower() for e in entities], strict=True)]
    return df.where(F.col(entity).isin(*entities)).groupBy(date).agg(*each)


def pivot_last(df: DataFrame, date: str, entity: str, value: str, order: str, entities: list[str]) -> DataFrame:
    """One column per entity with its last known value of each date in order of arrival."""
    return df.where(F.col(value).isNotNull()).groupBy(date).pivot(entity, entities).agg(F.max_by(value, order))


def simple_returns(df: DataFrame, entity: str, date: str, price: str) -> DataFrame:
    """entity, date, ret: price / previous price - 1, without padding of gaps; first rows and zero bases have none."""
    rows = with_previous(df.select(entity, date, price), entity, [date], price)
    return rows.select(entity, date, (F.try_divide(F.col(price), F.col(BEFORE)) - 1).alias("ret")).where("ret is not null")


def cumulative_returns(returns: DataFrame, entity: str, date: str, ret: str = "ret") -> DataFrame:
    """entity, date, cumulative: the compounded return up to each date; NULL from a loss of everything on."""
    so_far = Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    ruined = F.max(F.col(ret) <= -1).over(so_far)
    grown = F.exp(F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(so_far)) - 1
    return returns.select(entity, date, F.when(~ruined, grown).alias("cumulative"))


def high_violation() -> Column:
    """high below any of the others; unknown prices are passed over."""
    return F.coalesce(F.col("high") < F.greatest("open", "close", "low"), F.lit(False))


def low_violation() -> Column:
    return F.coalesce(F.col("low") > F.least("open", "close"), F.lit(False))
