"""Settings from the environment (prefix MARL_), provenance of a run, and stable hashes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import logging
import os
import sys
import uuid
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

PREFIX = "MARL_"
VERSION = "1.0.0"


def _text(name: str) -> str | None:
    return (os.environ.get(PREFIX + name) or "").strip() or None


def _number(name: str, default: float) -> float:
    try:
        return float(_text(name) or default)
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    """Folders, connector options and check thresholds."""

    data_dir: str
    sample_dir: str
    fred_api_key: str | None = None
    http_timeout: float = 30.0
    max_retries: int = 3
    cross_source_tolerance_bp: float = 5.0
    missing_ratio_error: float = 0.05
    extreme_return_threshold: float = 0.25
    min_expected_rows: int = 20

    @property
    def raw_dir(self) -> str:
        return f"{self.data_dir}/raw"

    @property
    def warehouse_dir(self) -> str:
        return f"{self.data_dir}/warehouse"

    def fingerprint(self) -> dict[str, Any]:
        """What decides a run's results; the key only as present or not."""
        names = ("cross_source_tolerance_bp", "missing_ratio_error", "extreme_return_threshold", "min_expected_rows")
        return {n: getattr(self, n) for n in names} | {"fred_api_key_present": self.fred_api_key is not None}


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    """Settings of this process; `get_settings.cache_clear()` after a change of the environment."""
    data = _text("DATA_DIR") or str(Path.cwd() / "data")
    return Settings(
        data_dir=data,
        sample_dir=_text("SAMPLE_RAW_DIR") or f"{data}/sample/raw",
        fred_api_key=_text("FRED_API_KEY"),
        http_timeout=_number("HTTP_TIMEOUT", 30.0),
        max_retries=int(_number("MAX_RETRIES", 3)),
        cross_source_tolerance_bp=_number("CROSS_SOURCE_TOLERANCE_BP", 5.0),
        missing_ratio_error=_number("MISSING_RATIO_ERROR", 0.05),
        extreme_return_threshold=_number("EXTREME_RETURN_THRESHOLD", 0.25),
        min_expected_rows=int(_number("MIN_EXPECTED_ROWS", 20)),
    )


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def stable_hash(value: Any) -> str:
    """16 hex digits of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Run:
    """Who produced a row: stamped into every load and report."""

    run_id: str
    started_at: dt.datetime
    mode: str
    fingerprint: str
    params: dict[str, Any] = field(default_factory=dict)
    version: str = VERSION

    @classmethod
    def new(cls, mode: str, config: dict[str, Any], **params: Any) -> Run:
        now = utc_now()
        return cls(f"{now:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}", now, mode, stable_hash(config), params)


def logger(name: str = "marlstone") -> logging.Logger:
    """One handler on standard output, its level from MARL_LOG_LEVEL."""
    root = logging.getLogger("marlstone")
    if not root.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        root.addHandler(handler)
        root.setLevel((_text("LOG_LEVEL") or "WARNING").upper())
    return logging.getLogger(name)
