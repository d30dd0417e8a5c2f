"""The research API: filtered tables, SQL, named queries, the load log and the check log. Everything stays lazy."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import ENTITY, get_contract
from .operators.bars import panel
from .plans.findings import SPELLED, totals
from .plans.lake import Lake
from .registries import declared
from .settings import get_settings


def lake(spark: SparkSession, warehouse: str | None = None) -> Lake:
    opened = Lake(spark, warehouse or get_settings().warehouse_dir)
    for name, build in NAMED.items():
        build(opened).createOrReplaceTempView(name)  # so that SQL can read a named query like a table
    return opened


def select_rows(table: DataFrame, entity: str, *, entities: list[str] | None = None, sources: list[str] | None = None, start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """The conjunction of the given filters, in order of date, source, entity; all reach the scan."""
    df = table
    if entities:
        df = df.where(F.col(entity).isin(*entities))
    if sources:
        df = df.where(F.col("source").isin(*sources))
    if start:
        df = df.where(F.col("date") >= F.lit(str(start)).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(str(end)).cast("date"))
    return df.orderBy("date", "source", entity)


def load_dataset(spark: SparkSession, dataset: str, *, indicators: list[str] | None = None, tickers: list[str] | None = None, sources: list[str] | None = None, start: str | None = None, end: str | None = None, warehouse: str | None = None) -> DataFrame:
    """A canonical table: `indicators` filter macro_data, `tickers` market_prices."""
    get_contract(dataset)
    entity = ENTITY[dataset]
    return select_rows(lake(spark, warehouse).table(dataset), entity, entities=tickers if entity == "ticker" else indicators, sources=sources, start=start, end=end)


def query(spark: SparkSession, sql: str, params: list | dict | None = None, *, warehouse: str | None = None) -> DataFrame:
    return lake(spark, warehouse).query(sql, params)


def price_panel(own: Lake) -> DataFrame:
    """Closing prices, one column per instrument."""
    return panel(own.table("market_prices"), "date", "ticker", "close", list(dict.fromkeys(d.entity for d in declared(dataset="market_prices")))).orderBy("date")


def us10y_cross_source(own: Lake) -> DataFrame:
    """The US 10-year yield of every source, newest first."""
    rows = own.table("macro_data").where(F.col("indicator") == "US_TREASURY_10Y")
    return rows.select("source", "date", "value", "unit").orderBy(F.desc("date"), "source")


def summarize_checks(results: DataFrame) -> DataFrame:
    """Checks, passed, errors and warnings per run, dataset, source and stage, newest run first."""
    return totals(results, "run_id", "dataset", "source", "stage").orderBy(F.desc("run_id"), "dataset", "source")


NAMED: dict[str, Callable[[Lake], DataFrame]] = {
    "price_panel": price_panel,
    "us10y_cross_source": us10y_cross_source,
    "validation_summary": lambda own: summarize_checks(own.table("validation_results")),
}


def named_query(spark: SparkSession, name: str, *, warehouse: str | None = None) -> DataFrame:
    if name not in NAMED:
        raise FileNotFoundError(f"no named query {name!r}; known: {sorted(NAMED)}")
    return NAMED[name](lake(spark, warehouse))


def list_datasets(spark: SparkSession, *, warehouse: str | None = None) -> list[str]:
    """Datasets loaded at least once."""
    return [r.dataset for r in lake(spark, warehouse).table("dataset_metadata").select("dataset").distinct().orderBy("dataset").collect()]


def dataset_metadata(spark: SparkSession, name: str | None = None, *, warehouse: str | None = None) -> DataFrame:
    """The load log: of one dataset, or of all, newest first."""
    log = lake(spark, warehouse).table("dataset_metadata")
    return log.where(F.col("dataset") == name) if name else log.orderBy(F.desc("loaded_at_utc"))


def validation_report(spark: SparkSession, run_id: str | None = None, *, dataset: str | None = None, source: str | None = None, worst_first: bool = True, warehouse: str | None = None) -> DataFrame:
    """The check log, worst first within run and stage; worst_first=False orders severities by name, descending."""
    rows = lake(spark, warehouse).table("validation_results")
    for column, wanted in (("run_id", run_id), ("dataset", dataset), ("source", source)):
        if wanted:
            rows = rows.where(F.col(column) == wanted)
    rank = F.array_position(F.array(*map(F.lit, SPELLED)), F.col("severity")) if worst_first else F.col("severity")
    return rows.orderBy("run_id", "stage", rank.desc(), "check_name")


def last_run(spark: SparkSession, *, warehouse: str | None = None) -> str | None:
    return lake(spark, warehouse).table("validation_results").agg(F.max("run_id")).first()[0]
