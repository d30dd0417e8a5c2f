"""Operators on many time series at once: one row per entity out, or the offending rows.

Windows over calendars are partitioned by the entity: rows are reduced to distinct dates or counted before them, so what
one task sorts is one series' calendar. Where the rows themselves are the subject, a series is cut into chunks along its
order, windows run inside a chunk, and the last row of every chunk, one small row, is carried to the next one: a series
of any number of rows is spread over as many tasks as it has chunks, and its rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import business_days, is_extreme_move, log_move, months


#: A chunk: 2 to this power of whole numbers, a day of timestamps, a year of dates; anything else is one chunk.
CHUNK_BITS = 20
CHUNK, BEFORE = "__chunk", "__before"


def in_chunks(df: DataFrame, by: str) -> DataFrame:
    kind = df.schema[by].dataType
    if isinstance(kind, T.IntegralType):
        chunk = F.shiftright(F.col(by).cast("long"), CHUNK_BITS)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        chunk = F.unix_date(F.to_date(by)).cast("long")
    elif isinstance(kind, T.DateType):
        chunk = F.year(by).cast("long")
    else:
        chunk = F.lit(0).cast("long")
    return df.withColumn(CHUNK, F.coalesce(chunk, F.lit(-(2**62))))  # nulls come first


def with_previous(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """Rows of known entities with the value of the entity's row before (BEFORE, NULL for the first) and their CHUNK."""
    keyed = in_chunks(df.where(F.col(entity).isNotNull()), order[0])
    last = keyed.groupBy(entity, CHUNK).agg(F.max(F.struct(F.struct(*order), F.struct(value).alias("v"))).alias("last"))
    border = last.select(entity, CHUNK, F.lag("last.v").over(Window.partitionBy(entity).orderBy(CHUNK)).alias("__border"))
    inside = Window.partitionBy(entity, CHUNK).orderBy(*order)
    rows = keyed.withColumn(BEFORE, F.lag(value).over(inside)).withColumn("__place", F.row_number().over(inside))
    before = F.when(F.col("__place") == 1, F.col(f"__border.{value}")).otherwise(F.col(BEFORE))
    return rows.join(border, [entity, CHUNK], "left").withColumn(BEFORE, before).drop("__place", "__border").select(*df.columns, CHUNK, BEFORE)


def out_of_order(df: DataFrame, entity: str, date: str, order: str) -> DataFrame:
    """Entities with a date before its predecessor's in order of arrival (a missing date counts): n_out_of_order."""
    wrong = F.col(date).isNull() | F.coalesce(F.col(date) < F.col(BEFORE), F.lit(False))
    rows = with_previous(df.select(*dict.fromkeys([entity, date, order])), entity, [order], date)
    return rows.groupBy(entity).agg(F.count_if(wrong).alias("n_out_of_order")).where("n_out_of_order > 0")


def observed_dates(df: DataFrame, entity: str, date: str, frequency: str | None = None, order: str | None = None) -> DataFrame:
    """Distinct dates per entity, with the entity's first known frequency if it has that column."""
    known = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull())
    if frequency is None:
        return known.select(F.col(entity), F.to_date(date).alias("day")).distinct()
    # The first known one in order of arrival, or the smallest without an order.
    first = F.min(F.when(F.col(frequency).isNotNull(), F.struct(*([order] if order else []), frequency)))
    days = known.groupBy(F.col(entity), F.to_date(date).alias("day")).agg(first.alias("f"))
    return days.select(entity, "day", F.min("f").over(Window.partitionBy(entity))[frequency].alias("frequency"))


def calendar_gaps(df: DataFrame, entity: str, date: str, frequency: str | None = None, default: str = "B", order: str | None = None, least: int = 3) -> DataFrame:
    """Per entity with `least` dates or more: n_observations, missing, max_gap, expected, missing_ratio, unit.

    Monthly and quarterly series step by months, all others by business days.
    """
    days = observed_dates(df, entity, date, frequency, order)
    how = F.coalesce(F.col("frequency"), F.lit(default)) if frequency else F.lit(default)
    step = F.when(how == "M", 1).when(how == "Q", 3)
    before = F.lag("day").over(Window.partitionBy(entity).orderBy("day"))
    moved = F.when(step.isNotNull(), months(before, F.col("day"))).otherwise(business_days(before, F.col("day")))
    gap = F.greatest(moved - F.coalesce(step, F.lit(1)), F.lit(0))
    per = days.withColumn("step", step).withColumn("gap", gap).groupBy(entity).agg(
        F.count("*").alias("n_observations"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("missing"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap"),
        F.min("day").alias("first"), F.max("day").alias("last"), F.max("step").alias("step"),
    ).where(F.col("n_observations") >= least)
    span = F.when(F.col("step").isNotNull(), F.floor(months(F.col("first"), F.col("last")) / F.col("step"))).otherwise(business_days(F.col("first"), F.col("last")))
    expected = (span + 1).cast("long")
    return per.select(
        entity, "n_observations", "missing", "max_gap", expected.alias("expected"), (F.col("missing") / F.greatest(expected, F.lit(1))).alias("missing_ratio"),
        F.when(F.col("step").isNotNull(), "months").otherwise("business days").alias("unit"),
    )


def step_consistency(df: DataFrame, entity: str, date: str, least: int = 10, slack: int = 3) -> DataFrame:
    """Per entity with `least` dates or more: n_steps, modal_step (smallest on ties), n_irregular, irregular_share."""
    days = observed_dates(df, entity, date)
    step = F.datediff("day", F.lag("day").over(Window.partitionBy(entity).orderBy("day")))
    counted = days.withColumn("step", step).where("step is not null").groupBy(entity, "step").agg(F.count("*").alias("n"))
    modal = F.first("step").over(Window.partitionBy(entity).orderBy(F.desc("n"), "step"))
    irregular = ~F.col("step").between(F.col("modal"), F.col("modal") + slack)
    per = counted.withColumn("modal", modal).groupBy(entity).agg(
        F.sum("n").alias("n_steps"), F.max("modal").cast("long").alias("modal_step"), F.coalesce(F.sum(F.when(irregular, F.col("n"))), F.lit(0)).alias("n_irregular"),
        F.slice(F.sort_array(F.collect_set(F.when(irregular, F.col("step")))), 1, 5).alias("example_steps"),
    ).where(F.col("n_steps") >= least - 1)
    return per.withColumn("irregular_share", F.col("n_irregular") / F.col("n_steps"))


def stale_runs(df: DataFrame, entity: str, value: str, order: list[str]) -> DataFrame:
    """Per entity: the longest run of equal values in order (ties: the earliest): run_length, value."""
    rows = with_previous(df.where(F.col(value).isNotNull()).select(*dict.fromkeys([entity, value, *order])), entity, order, value)
    rows = rows.withColumn("changed", (~F.col(value).eqNullSafe(F.col(BEFORE))).cast("int"))
    earlier = Window.partitionBy(entity).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(entity, CHUNK).agg(F.sum("changed").alias("n")).select(entity, CHUNK, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = rows.withColumn("run", F.sum("changed").over(Window.partitionBy(entity, CHUNK).orderBy(*order))).join(base, [entity, CHUNK])
    runs = numbered.groupBy(entity, (F.col("run") + F.col("base")).alias("run")).agg(F.count("*").alias("run_length"), F.first(value).alias("value"))
    longest = F.max_by(F.struct("run_length", "value"), F.struct("run_length", -F.col("run"))).alias("longest")
    return runs.groupBy(entity).agg(longest).select(entity, "longest.*")


def moves(df: DataFrame, entity: str, price: str, order: list[str], threshold: float) -> DataFrame:
    """Every row of a known entity with the log move since the entity's previous row, and whether it is extreme."""
    rows = with_previous(df, entity, order, price)
    return rows.withColumn("log_move", log_move(F.col(price), F.col(BEFORE))).withColumn("extreme", is_extreme_move(F.col(price), F.col(BEFORE), threshold)).drop(BEFORE, CHUNK)


def missingness(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Per entity with missing values: missing, n_observations, missing_ratio."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count_if(F.col(value).isNull()).alias("missing"), F.count("*").alias("n_observations"))
    return per.where("missing > 0").withColumn("missing_ratio", F.col("missing") / F.col("n_observations"))
