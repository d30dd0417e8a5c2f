"""The same quantity from several sources, compared pair by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mixed_units(df: DataFrame, entity: str = "indicator", source: str = "source", unit: str = "unit") -> DataFrame:
    """Entities that several sources report in different units: units, sources."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.sort_array(F.collect_set(unit)).alias("units"), F.sort_array(F.collect_set(source)).alias("sources"))
    return per.where((F.size("units") > 1) & (F.size("sources") > 1))


def source_pairs(df: DataFrame, tolerance_bp: float, *, entity: str = "indicator", date: str = "date", value: str = "value", source: str = "source", unit: str = "unit", order: str | None = None) -> DataFrame:
    """Per entity and pair of its sources (left < right): overlap, and over shared dates the absolute difference's
    median, 95th percentile, maximum (in basis points where the unit is percent), breach_share, n_breach, correlation.

    The last known value of each (entity, date, source) counts. Pairs come from the sources, so a pair without a shared
    date is there with overlap 0. Percentiles are exact; a pair has one row per date, which bounds them.
    """
    known = df.where(F.col(entity).isNotNull() & F.col(value).isNotNull() & F.col(source).isNotNull() & F.col(date).isNotNull())
    last = F.max_by(value, order) if order else F.max(value)
    one = known.groupBy(entity, date, source).agg(last.alias("value"))
    left = one.select(F.col(entity), F.col(date), F.col(source).alias("left"), F.col("value").alias("a"))
    right = one.select(F.col(entity), F.col(date), F.col(source).alias("right"), F.col("value").alias("b"))
    units = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(unit).alias("unit"))  # a broadcast if it is small
    both = left.join(right, [entity, date]).where("left < right").join(units, entity)
    difference = F.abs(F.col("a") - F.col("b")) * F.when(F.col("unit") == "percent", 100.0).otherwise(1.0)
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    stats = both.withColumn("d", difference).groupBy(entity, "left", "right").agg(
        F.count("*").alias("overlap"), F.percentile("d", 0.5).alias("median_abs_diff_bp"), F.percentile("d", 0.95).alias("p95_abs_diff_bp"), F.max("d").alias("max_abs_diff_bp"),
        F.avg((F.col("d") > tolerance_bp).cast("double")).alias("breach_share"), F.count_if(F.col("d") > tolerance_bp).alias("n_breach"),
        F.try_divide(F.covar_pop("a", "b"), F.when(spread > 0, spread)).alias("correlation"),
    )
    names = known.groupBy(entity).agg(F.sort_array(F.collect_set(source)).alias("all"))  # the sources of one entity: a handful
    pairs = names.select(entity, F.explode("all").alias("left"), "all").select(entity, "left", F.explode("all").alias("right")).where("left < right")
    return pairs.join(stats, [entity, "left", "right"], "left").join(units, entity, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def verdicts(compared: DataFrame, tolerance_bp: float, least_overlap: int, most_breaches: float, mismatch: float) -> DataFrame:
    """source_pairs with a level: 2 if the median is `mismatch` tolerances and more apart, 1 if the median or the share
    of breaches is above what is allowed, else 0; a pair with fewer shared dates than `least_overlap` is 0."""
    median, enough = F.col("median_abs_diff_bp"), F.col("overlap") >= least_overlap
    level = F.when(enough & (median > tolerance_bp * mismatch), 2).when(enough & ((median > tolerance_bp) | (F.col("breach_share") > most_breaches)), 1).otherwise(0)
    return compared.withColumn("level", level)


def coverage_summary(df: DataFrame, entity: str = "indicator", source: str = "source", value: str = "value", date: str = "date") -> DataFrame:
    """Per entity and source: n_observations, n_missing, first_date, last_date."""
    return df.groupBy(entity, source).agg(F.count("*").alias("n_observations"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def multi_source_entities(df: DataFrame, entity: str, source: str) -> DataFrame:
    """Entities that more than one source observes: n_sources, sources joined by commas in order."""
    per = df.groupBy(entity).agg(F.sort_array(F.collect_set(source)).alias("all")).where(F.size("all") > 1)
    return per.select(entity, F.size("all").cast("long").alias("n_sources"), F.array_join("all", ",").alias("sources"))
