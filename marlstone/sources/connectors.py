"""Connectors deliver a source's payload untouched; the plan says what to fetch from whom.

Live connectors talk HTTP or a client library on the driver (payloads are small and rate-limited); replay reads the raw
zone. No connector cleans or renames anything beyond what the payload's shape needs.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.parse
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.util import find_spec
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CURVE_DATE, CURVE_LABELS, RawContract, get_raw_contract
from ..settings import Settings, get_settings, logger
from .rawzone import ORDER, ChecksumError, RawZone

DEFAULT_START = dt.date(2019, 1, 1)


@dataclass(frozen=True)
class FetchRequest:
    dataset: str
    symbols: tuple[str, ...] = ()
    start: dt.date = DEFAULT_START
    end: dt.date = field(default_factory=dt.date.today)

    def as_params(self) -> dict[str, Any]:
        return {"dataset": self.dataset, "symbols": list(self.symbols), "start": self.start.isoformat(), "end": self.end.isoformat()}


@dataclass(frozen=True)
class Payload:
    columns: tuple[str, ...]
    rows: list[tuple]
    params: dict[str, Any]
    notes: str = ""


class Connector(ABC):
    """One source and dataset."""

    source = ""
    dataset = ""
    description = ""
    requires_api_key = False

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or get_settings()

    @property
    def raw_contract(self) -> RawContract | None:
        return get_raw_contract(self.source, self.dataset)

    @abstractmethod
    def unavailable(self) -> str | None:
        """Why nothing can be fetched now, or None."""

    @abstractmethod
    def fetch(self, request: FetchRequest) -> Payload: ...

    def read(self, spark: SparkSession, request: FetchRequest) -> DataFrame:
        """The payload as an all-text DataFrame."""
        p = self.fetch(request)
        schema = ", ".join(f"`{c}` string" for c in p.columns)
        return spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in p.rows], schema)


#: The bar payload's columns, as published and as stored.
BAR_COLUMNS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}


class YahooBars(Connector):
    """Daily bars per symbol: the end date is inclusive, close and adjusted close stay apart."""

    source, dataset, description = "yahoo", "market_prices", "daily bars of ETFs"

    def unavailable(self) -> str | None:
        return None if find_spec("yfinance") else "the package yfinance is not installed"

    def download(self, symbol: str, start: dt.date, end: dt.date) -> list[dict[str, Any]]:
        import yfinance

        frame = yfinance.download(symbol, start=start.isoformat(), end=(end + dt.timedelta(days=1)).isoformat(), auto_adjust=False, progress=False, threads=False)
        if frame is None or not len(frame):
            return []
        if frame.columns.nlevels > 1:
            frame.columns = frame.columns.get_level_values(0)
        return [{"date": day, **dict(zip(frame.columns, values, strict=True))} for day, values in zip(frame.index, frame.itertuples(index=False, name=None), strict=True)]

    def fetch(self, request: FetchRequest) -> Payload:
        rows = []
        for symbol in request.symbols:
            bars = self.download(symbol, request.start, request.end)
            if not bars:
                logger().warning("yahoo has no rows for %s", symbol)
            rows += [(b["date"], symbol, *(b.get(published) for published in BAR_COLUMNS)) for b in bars]
        return Payload(("date", "ticker", *BAR_COLUMNS.values()), rows, request.as_params())


class YahooYields(YahooBars):
    """A yield index in the shape of bars."""

    dataset, description = "macro_data", "10-year Treasury yield index, in tenths of a percent"


class FredSeries(Connector):
    """Series observations over HTTP, one request per series, with retries; "." for missing stays as it is."""

    source, dataset, description, requires_api_key = "fred", "macro_data", "Treasury yields, CPI and VIX series", True
    endpoint = "https://api.stlouisfed.org/fred/series/observations"
    sleep: Callable[[float], None] = staticmethod(time.sleep)

    def unavailable(self) -> str | None:
        return None if self.settings.fred_api_key else "MARL_FRED_API_KEY is not set"

    def get(self, query: dict[str, str]) -> dict[str, Any]:
        with urllib.request.urlopen(f"{self.endpoint}?{urllib.parse.urlencode(query)}", timeout=self.settings.http_timeout) as response:
            return json.load(response)

    def observations(self, series: str, request: FetchRequest) -> list[dict[str, Any]]:
        query = {"series_id": series, "api_key": self.settings.fred_api_key or "", "file_type": "json", "observation_start": request.start.isoformat(), "observation_end": request.end.isoformat()}
        failure: Exception | None = None
        for attempt in range(self.settings.max_retries):
            try:
                return list(self.get(query).get("observations", []))
            except (OSError, ValueError) as e:
                failure = e
                logger().warning("fred %s, attempt %d: %s", series, attempt + 1, e)
                self.sleep(min(2**attempt, 8))
        raise RuntimeError(f"fred did not answer for {series}") from failure

    def fetch(self, request: FetchRequest) -> Payload:
        if not self.settings.fred_api_key:
            raise RuntimeError("MARL_FRED_API_KEY is needed")
        rows = [(o.get("date"), s, o.get("value")) for s in request.symbols for o in self.observations(s, request)]
        return Payload(("date", "series_id", "value"), rows, request.as_params() | {"endpoint": self.endpoint})


class YieldCurve(Connector):
    """The published wide table, cut to the requested columns and dates, labels untouched."""

    source, dataset, description = "akshare", "macro_data", "China government bond yield curve and the US 10-year yield"

    def unavailable(self) -> str | None:
        return None if find_spec("akshare") else "the package akshare is not installed"

    def table(self, start: dt.date) -> tuple[list[str], list[tuple]]:
        import akshare

        frame = akshare.bond_zh_us_rate(start_date=f"{start:%Y%m%d}")
        return ([], []) if frame is None else (list(frame.columns), list(frame.itertuples(index=False, name=None)))

    def fetch(self, request: FetchRequest) -> Payload:
        labels, rows = self.table(request.start)
        wanted = [CURVE_LABELS[s] for s in request.symbols if s in CURVE_LABELS]
        if not rows:
            return Payload((CURVE_DATE, *wanted), [], request.as_params(), "empty payload")
        keep = [CURVE_DATE, *[c for c in wanted if c in labels]]
        at = [labels.index(c) for c in keep]
        inside = [r for r in rows if request.start.isoformat() <= str(r[at[0]])[:10] <= request.end.isoformat()]
        return Payload(tuple(keep), [tuple(r[i] for i in at) for r in inside], request.as_params() | {"function": "bond_zh_us_rate"})


class Replay(Connector):
    """The latest snapshot of a source from a raw zone, its checksum verified first."""

    def __init__(self, source: str, dataset: str, zone: RawZone):
        super().__init__()
        self.source, self.dataset, self.zone = source, dataset, zone
        self.description = f"replay of {source}/{dataset}"

    def unavailable(self) -> str | None:
        return None if self.zone.latest(self.source, self.dataset) else f"no snapshot of {self.source}/{self.dataset} under {self.zone.root}"

    def read(self, spark: SparkSession, request: FetchRequest) -> DataFrame:
        snapshot = self.zone.latest(self.source, self.dataset)
        if snapshot is None:
            raise FileNotFoundError(self.unavailable())
        if self.zone.verify([snapshot]):
            raise ChecksumError(f"{snapshot.snapshot_id} is not what was written")
        df = self.zone.read(snapshot).drop(ORDER)
        if not request.symbols:
            return df
        if CURVE_DATE in df.columns:
            wanted = [CURVE_LABELS.get(s, s) for s in request.symbols]
            return df.select(CURVE_DATE, *[c for c in df.columns if c in wanted])
        key = next((c for c in ("ticker", "series_id") if c in df.columns), None)
        return df.where(F.trim(F.col(key)).isin(*request.symbols)) if key else df

    def fetch(self, request: FetchRequest) -> Payload:
        df = self.read(self.zone.spark, request)
        return Payload(tuple(df.columns), [tuple(r) for r in df.collect()], request.as_params())


LIVE: dict[tuple[str, str], type[Connector]] = {(c.source, c.dataset): c for c in (YahooBars, YahooYields, FredSeries, YieldCurve)}


def connector_for(source: str, dataset: str, mode: str = "live", *, zone: RawZone | None = None, settings: Settings | None = None) -> Connector:
    if mode not in ("live", "offline"):
        raise ValueError(f"mode is live or offline, not {mode!r}")
    if (source, dataset) not in LIVE:
        raise KeyError(f"no connector for {source}/{dataset}; known: {sorted(LIVE)}")
    if mode == "live":
        return LIVE[source, dataset](settings)
    if zone is None:
        raise ValueError("a replay needs a raw zone")
    return Replay(source, dataset, zone)


LISTING = "source string, dataset string, description string, requires_api_key boolean, available boolean, reason string"


def list_connectors(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    rows = []
    for (source, dataset), kind in sorted(LIVE.items()):
        c = kind(settings)
        why = c.unavailable()
        rows.append((source, dataset, c.description, c.requires_api_key, why is None, why or ""))
    return spark.createDataFrame(rows, LISTING)


@dataclass(frozen=True)
class PlanItem:
    source: str
    dataset: str
    symbols: tuple[str, ...]
    description: str


PLAN = (
    PlanItem("yahoo", "market_prices", ("SPY", "TLT", "GLD"), "US equity, long Treasury and gold ETFs"),
    PlanItem("yahoo", "macro_data", ("^TNX",), "10-year Treasury yield index"),
    PlanItem("fred", "macro_data", ("DGS10", "DGS2", "CPIAUCSL", "VIXCLS"), "US yields, prices and volatility"),
    PlanItem("akshare", "macro_data", ("CN2Y", "CN5Y", "CN10Y", "CN30Y", "US10Y"), "China yield curve, and the US 10-year yield"),
)


def plan_for(sources: tuple[str, ...] | list[str] | None = None) -> tuple[PlanItem, ...]:
    wanted = {s.lower() for s in sources or ()}
    return tuple(p for p in PLAN if not wanted or p.source in wanted)
