import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import business_days, date_from_text, is_extreme_move, months, number_from_text, trimmed


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


NUMBERS = {" 1,234.5 ": 1234.5, "1e7": 1e7, "+3": 3.0, "5.": 5.0, ".5": 0.5, "-2E-1": -0.2, "inf": float("inf"), "-Infinity": float("-inf")} | dict.fromkeys(
    [".", "", "NA", "-", "1.5d", "2f", "nan", "NaN", "1e400", "1_000", "0x10", "abc", "1 2", None]
)


def test_number_from_text(spark):
    got = {r.x: r.y for r in column(spark, list(NUMBERS)).select("x", number_from_text(F.col("x")).alias("y")).collect()}
    assert got == NUMBERS


DATES = {
    "2024-02-29": dt.date(2024, 2, 29), " 2024-01-05 ": dt.date(2024, 1, 5), "2024-01-05 23:59:59": dt.date(2024, 1, 5), "2024-01-05T23:30:00-05:00": dt.date(2024, 1, 6), "2024-01-05T00:30:00+01:00": dt.date(2024, 1, 4),
    "2024-01-05T10:00:00Z": dt.date(2024, 1, 5), "2024-13-01": None, "05/01/2024": None, "soon": None, "": None, None: None,
}


def test_date_from_text(spark):
    got = {r.x: r.y for r in column(spark, list(DATES)).select("x", date_from_text(F.col("x")).alias("y")).collect()}
    assert got == DATES


def test_trimmed(spark):
    assert [r.y for r in column(spark, ["\t a b \n", ""]).orderBy("i").select(trimmed(F.col("x")).alias("y")).collect()] == ["a b", ""]


def test_business_days_and_months_equal_numpy(spark):
    rng = np.random.default_rng(0)
    days = [(dt.date(1960, 1, 1) + dt.timedelta(int(a)), dt.date(1960, 1, 1) + dt.timedelta(int(b))) for a, b in np.sort(rng.integers(0, 40000, (300, 2)), axis=1)]
    rows = spark.createDataFrame(days, "a date, b date").select("a", "b", business_days(F.col("a"), F.col("b")).alias("w"), months(F.col("a"), F.col("b")).alias("m")).collect()
    for r in rows:
        assert r.w == np.busday_count(r.a, r.b) and r.m == (r.b.year - r.a.year) * 12 + r.b.month - r.a.month


inf = float("inf")


@pytest.mark.parametrize(
    ("before", "price", "extreme"),
    [(100.0, 101.0, False), (100.0, 200.0, True), (100.0, 60.0, True), (0.0, 5.0, True), (0.0, -5.0, False), (0.0, 0.0, False), (5.0, 0.0, True), (-5.0, 0.0, True), (5.0, -5.0, False), (-5.0, -6.0, False), (None, 5.0, False), (5.0, None, False), (5.0, inf, True), (inf, 5.0, True), (inf, inf, False)],
)
def test_extreme_moves_follow_ieee_arithmetic(spark, before, price, extreme):
    assert spark.createDataFrame([(before, price)], "b double, p double").select(is_extreme_move(F.col("p"), F.col("b"), 0.25)).first()[0] is extreme
