"""Raw text payloads to canonical tables: one select chain and two broadcast joins each, no loop over series."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CURVE_DATE, MACRO_DATA, MARKET_PRICES, TableContract
from ..functions import date_from_text, number_from_text, trimmed
from ..registries import conversion, registry
from ..settings import logger, utc_now
from ..sources.rawzone import ORDER, RawZone, Snapshot, arrival


#: A table of symbols up to this many rows is broadcast; a larger one is joined as Spark plans it.
BROADCAST_ROWS = 10_000


def _of_source(known: DataFrame, source: str) -> DataFrame:
    """A source's symbols, broadcast only if their number, which is counted, allows it."""
    own = known.where(F.col("source") == source).drop("source").withColumnRenamed("symbol", "__symbol")
    return F.broadcast(own) if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else own


def mapped(df: DataFrame, known: DataFrame, source: str, symbol: str) -> DataFrame:
    """Rows joined with their row of a table of symbols (left: unmapped rows have NULLs)."""
    return df.withColumn("__symbol", trimmed(F.col(f"`{symbol}`"))).join(_of_source(known, source), "__symbol", "left").drop("__symbol")


def unmapped(df: DataFrame, known: DataFrame, source: str, symbol: str) -> DataFrame:
    """The rows whose symbol is not in a table of symbols."""
    return df.withColumn("__symbol", trimmed(F.col(f"`{symbol}`"))).join(_of_source(known, source), "__symbol", "left_anti").drop("__symbol")


def unpivot(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Wide to long: one row per key and remaining column.

    By explode, not DataFrame.unpivot: what follows can then share its subexpressions in generated code, which Spark
    4.1 can't compile over the latter's Expand.
    """
    kept = [F.col(f"`{k}`") for k in keys]
    each = [F.struct(F.lit(c).alias(label), F.col(f"`{c}`").alias(value)) for c in df.columns if c not in keys]
    if not each:
        return df.select(*kept, F.lit(None).cast("string").alias(label), F.lit(None).cast("string").alias(value)).where("false")
    return df.select(*kept, F.explode(F.array(*each)).alias("__each")).select(*kept, f"__each.{label}", f"__each.{value}")


def convert(value: Column, factor: Column, scale: Column) -> Column:
    """A value in its canonical unit, multiplied in one fixed order."""
    return value * factor * scale


def convert_unit(value: Column, source_unit: str, extra_scale: float = 1.0) -> tuple[Column, str]:
    """The value in the canonical unit of a declared source unit, and that unit; UndeclaredUnit for any other."""
    unit, factor = conversion(source_unit)
    return convert(value, F.lit(factor), F.lit(extra_scale)), unit


def _ordered(df: DataFrame) -> DataFrame:
    return df if ORDER in df.columns else df.withColumn(ORDER, arrival())


def _stamped(df: DataFrame, contract: TableContract, source: str, snapshot_id: str, run_id: str, ingested_at: dt.datetime) -> DataFrame:
    full = df.withColumns({"source": F.lit(source), "snapshot_id": F.lit(snapshot_id), "run_id": F.lit(run_id), "ingested_at": F.lit(ingested_at)})
    return full.select(*[F.col(f.name).cast(t.dataType).alias(f.name) for f, t in zip(contract.fields, contract.to_struct(), strict=True)], ORDER)


def market(raw: DataFrame, *, source: str, snapshot_id: str, run_id: str, ingested_at: dt.datetime) -> DataFrame | None:
    """Bars; rows of undeclared symbols are dropped, rows without a readable date stay."""
    if not {"date", "ticker"} <= set(raw.columns):
        logger().warning("%s has no date or ticker column", snapshot_id)
        return None
    known = registry(raw.sparkSession, MARKET_PRICES.name).select("source", "symbol", F.col("entity").alias("ticker"), "currency")
    joined = mapped(_ordered(raw).withColumnRenamed("ticker", "__raw"), known, source, "__raw").where("ticker is not null")
    prices = {c: number_from_text(F.col(c)) if c in raw.columns else F.lit(None).cast("double") for c in ("open", "high", "low", "close", "adj_close", "volume")}
    return _stamped(joined.withColumns({"date": date_from_text(F.col("date")), **prices}), MARKET_PRICES, source, snapshot_id, run_id, ingested_at)


def macro(raw: DataFrame, *, source: str, snapshot_id: str, run_id: str, ingested_at: dt.datetime) -> DataFrame | None:
    """Observations in canonical units; undeclared series and rows without a readable date are dropped."""
    raw = _ordered(raw)
    shape = {"yahoo": ("date", "ticker", "close"), "fred": ("date", "series_id", "value"), "akshare": (CURVE_DATE, "label", "value")}.get(source)
    if shape is None:
        logger().warning("no normalizer for the source %s", source)
        return None
    if source == "akshare" and CURVE_DATE in raw.columns:
        raw = unpivot(raw, [CURVE_DATE, ORDER], "label", "value")
    if not set(shape) <= set(raw.columns):
        logger().warning("%s lacks some of the columns %s", snapshot_id, shape)
        return None
    date, symbol, value = shape
    long = raw.select(date_from_text(F.col(f"`{date}`")).alias("date"), F.col(symbol).alias("symbol"), F.col(value).alias("text"), ORDER).where("date is not null")
    known = registry(raw.sparkSession, MACRO_DATA.name).select("source", "symbol", F.col("entity").alias("indicator"), "unit", "factor", "scale", "frequency")
    joined = mapped(long, known, source, "symbol").where("indicator is not null")
    return _stamped(joined.withColumn("value", convert(number_from_text(F.col("text")), F.col("factor"), F.col("scale"))), MACRO_DATA, source, snapshot_id, run_id, ingested_at)


NORMALIZERS = {"market_prices": (market, MARKET_PRICES), "macro_data": (macro, MACRO_DATA)}


def normalize_snapshots(zone: RawZone, snapshots: list[Snapshot], run_id: str, ingested_at: dt.datetime) -> dict[str, DataFrame]:
    """Canonical tables (with the arrival order) of all snapshots' datasets; typed and empty if nothing is usable."""
    out: dict[str, list[DataFrame]] = {}
    for place, s in enumerate(snapshots):
        if s.dataset in NORMALIZERS:
            part = NORMALIZERS[s.dataset][0](zone.read(s, place), source=s.source, snapshot_id=s.snapshot_id, run_id=run_id, ingested_at=ingested_at)
            out.setdefault(s.dataset, []).extend([part] if part is not None else [])
    return {d: reduce(DataFrame.unionByName, parts) if parts else empty(zone.spark, NORMALIZERS[d][1]) for d, parts in out.items()}


def normalize_latest(zone: RawZone, run_id: str, ingested_at: dt.datetime | None = None) -> dict[str, DataFrame]:
    """The canonical tables of the latest snapshot of every source and dataset in a raw zone."""
    found = {(s.source, s.dataset) for s in zone.list_snapshots()}
    if not found:
        raise FileNotFoundError(f"no snapshots under {zone.root}")
    latest = [s for key in sorted(found) if (s := zone.latest(*key)) is not None]
    return normalize_snapshots(zone, latest, run_id, ingested_at or utc_now())


def empty(spark: SparkSession, contract: TableContract) -> DataFrame:
    return _ordered(spark.createDataFrame([], contract.to_struct()))
