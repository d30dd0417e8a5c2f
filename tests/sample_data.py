"""The four raw snapshots that the expected findings refer to, regenerated from their recipe (FIXTURES.md, section 1)."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from marlstone.contracts import CURVE_DATE, CURVE_LABELS
from marlstone.settings import Run
from marlstone.sources import RawZone, Snapshot

DAYS = [d.date().isoformat() for d in pd.bdate_range("2019-01-01", "2024-12-31")]
N = len(DAYS)
STAMP = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
SHA = {
    ("yahoo", "market_prices"): "72b60b20c9fa20c38a141af1fab312cd8f547562b0746b40630114c15092f766",
    ("yahoo", "macro_data"): "e745e8e049b6d4b3b621aa76d23d84842276bc2b48ebe2175dde230890dcaf92",
    ("fred", "macro_data"): "b380a19129c5a6d564848d8d6728ae4b8dc937aa4e63088ddf50df24cb30b00c",
    ("akshare", "macro_data"): "be1258e0d1959f0cddfa69024c3d8dcb71041cf10623d62d6b90a7702c098a19",
}


def walk(level, vol, drift, rng):
    return level * np.exp(np.cumsum(rng.normal(0, vol, N)) + np.linspace(0, drift, N))


def bars(close, rng, volume):
    """Columns of a bar table around closing prices, drawn in the recipe's order."""
    opening = np.r_[close[0], close[:-1]] * (1 + rng.normal(0, 0.002, N))
    high = np.maximum(opening, close) * (1 + abs(rng.normal(0, 0.003, N)))
    low = np.minimum(opening, close) * (1 - abs(rng.normal(0, 0.003, N)))
    size = np.round(volume * (1 + rng.normal(0, 0.3, N)))
    return [x.round(3) for x in (opening, high, low, close)] + [close.round(3), size]


def payloads():
    truth = walk(4.25, 0.006, 0.3, np.random.default_rng(141))
    rng, rows = np.random.default_rng(42), []
    for ticker, price in (("SPY", 250.0), ("TLT", 105.0), ("GLD", 130.0)):
        columns = bars(walk(price, 0.012, 0.2, rng), rng, 1e7)
        if ticker == "SPY":
            for c in columns[:5]:
                c[N // 3] = float(c[N // 3 - 1]) * 1.5
        gone = range(N // 2, N // 2 + 12) if ticker == "GLD" else ()
        rows += [(DAYS[i], ticker, *(float(c[i]) for c in columns[:5]), int(columns[5][i])) for i in range(N) if i not in gone]
    names = ["date", "ticker", "open", "high", "low", "close", "adj_close", "volume"]
    yield "yahoo", "market_prices", names, rows
    rng = np.random.default_rng(43)
    columns = bars((truth * 10 + rng.normal(0, 0.02, N)).round(3), rng, 5e6)
    yield "yahoo", "macro_data", names, [(DAYS[i], "^TNX", *(float(c[i]) for c in columns[:5]), int(columns[5][i])) for i in range(N)]
    rng = np.random.default_rng(44)
    series = {"DGS10": (truth + rng.normal(0, 0.02, N)).round(3), "DGS2": walk(1.5, 0.008, 0.3, rng).round(3), "CPIAUCSL": walk(250, 0.001, 0.25, rng).round(3), "VIXCLS": walk(18, 0.03, 0, rng).round(2)}
    missing = range(N // 4, N // 4 + 8)
    yield "fred", "macro_data", ["date", "series_id", "value"], [(DAYS[i], s, "." if s == "VIXCLS" and i in missing else f"{v[i]:.3f}") for i in range(N) for s, v in series.items()]
    rng = np.random.default_rng(45)
    curve = [walk(p, 0.008, d, rng).round(3) for p, d in ((2.2, 0.2), (2.4, 0.25), (2.5, 0.3), (3.0, 0.35))] + [(truth * 100).round(3)]
    curve[3][100:112] = curve[3][100]
    kept = [i for i in range(N) if not N // 3 <= i < N // 3 + 9]
    yield "akshare", "macro_data", [CURVE_DATE, *CURVE_LABELS.values()], [(DAYS[i], *(float(c[i]) for c in curve)) for i in kept]


def write_all(zone: RawZone) -> list[Snapshot]:
    run = Run("sample", STAMP, "offline", "")
    return [zone.write(source, dataset, columns, rows, run, synthetic=True, retrieved_at=STAMP) for source, dataset, columns, rows in payloads()]
