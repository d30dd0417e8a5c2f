"""The check log: every check is one row of the table `validation_results`, whether it holds or not.

A finding is a level on one scale, with a text and evidence: HOLDS, SUSPECT (the table is loaded and the finding kept
beside it) or BROKEN (the table is quarantined). What the levels add up to is asked of Spark (`totals`), by the same
expression for findings that are about to be stored and for the stored log.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from itertools import chain
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import validation_struct
from ..settings import utc_now

HOLDS, SUSPECT, BROKEN = range(3)
#: How the levels are spelled in the stored log.
SPELLED = ("INFO", "WARNING", "ERROR")


class Finding(NamedTuple):
    check: str
    level: int
    text: str
    column: str | None
    n: int
    evidence: dict[str, Any]


def finding(check: str, level: int, text: str, column: str | None = None, n: int = 0, **evidence: Any) -> Finding:
    return Finding(check, level, text, column, int(n), evidence)


class Subject(NamedTuple):
    """What was checked: one dataset of one source at a stage (raw, normalized or cross_source) of a run."""

    run_id: str
    dataset: str
    source: str
    stage: str


class Checked(NamedTuple):
    """A subject, its number of rows, and what the checks found, in their order."""

    subject: Subject
    n_rows: int
    found: tuple[Finding, ...]
    at: dt.datetime

    @classmethod
    def now(cls, subject: Subject, n_rows: int, found: Iterable[Finding | Iterable[Finding]]) -> Checked:
        """Checks may give one finding or several."""
        return cls(subject, n_rows, tuple(chain.from_iterable([x] if isinstance(x, Finding) else x for x in found)), utc_now())

    def level(self) -> int:
        """The highest level found; a subject without findings holds."""
        return max((f.level for f in self.found), default=HOLDS)

    def reaching(self, level: int) -> list[Finding]:
        return [f for f in self.found if f.level >= level]

    def log_rows(self) -> list[tuple]:
        evidence = lambda f: json.dumps(f.evidence, default=str, ensure_ascii=False)
        return [(*self.subject, f.check, f.column, f.level == HOLDS, SPELLED[f.level], f.n, f.text, evidence(f), self.at) for f in self.found]


def log_table(spark: SparkSession, checked: Iterable[Checked]) -> DataFrame:
    """All findings in the shape of the stored log."""
    return spark.createDataFrame([row for c in checked for row in c.log_rows()], validation_struct())


def totals(log: DataFrame, *by: str) -> DataFrame:
    """Checks, passed, errors and warnings per group of a check log."""
    failed = lambda level: F.count_if(~F.col("passed") & (F.col("severity") == SPELLED[level]))
    return log.groupBy(*by).agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), failed(BROKEN).alias("errors"), failed(SUSPECT).alias("warnings"))
