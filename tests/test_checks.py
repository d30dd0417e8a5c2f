import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.contracts import CURVE_DATE, MACRO_DATA, MARKET_PRICES, get_raw_contract
from marlstone.operators import pairs, series
from marlstone.plans import checks
from marlstone.plans.findings import BROKEN, HOLDS, SUSPECT, Checked, Subject, finding, log_table, totals
from marlstone.sources.rawzone import ORDER

DAY = dt.date(2024, 1, 1)
MARKET = "date date, ticker string, source string, open double, high double, low double, close double, adj_close double, volume double, currency string, snapshot_id string, run_id string, ingested_at timestamp"
NOW = dt.datetime(2024, 2, 1)


def bdays(n, start=DAY):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def market(spark, rows):
    """(date, ticker, open, high, low, close[, adj_close, volume])"""
    full = [(r[0], r[1], "yahoo", *r[2:6], *(r[6:8] if len(r) > 6 else (r[5], 10.0)), "USD", "s", "r", NOW) for r in rows]
    return ordered(spark.createDataFrame(full, MARKET))


def macro(spark, rows, schema="date date, indicator string, source string, value double, unit string, frequency string"):
    """(date, indicator, source, value, unit, frequency)"""
    return ordered(spark.createDataFrame(rows, schema))


def ordered(df):
    return df.coalesce(1).withColumn(ORDER, F.monotonically_increasing_id())


TWO = [(DAY, "SPY", 100.0, 102.0, 99.0, 101.0), (DAY + dt.timedelta(1), "SPY", 101.0, 103.0, 100.0, 102.0)]


def test_clean_bars_pass(spark):
    report = checks.validate_normalized(market(spark, TWO), dataset="market_prices", source="yahoo", run_id="r")
    assert not report.reaching(SUSPECT) and len(report.found) == 16 and report.n_rows == 2 and report.level() == HOLDS


def one(df, name):
    report = checks.validate_normalized(df, dataset="market_prices", source="yahoo", run_id="r")
    return next(r for r in report.found if r.check == name), report


def test_impossible_bar(spark):
    c, report = one(market(spark, [TWO[0], (*TWO[1][:3], 98.0, *TWO[1][4:])]), "ohlc_consistency")
    assert c.level and c.level == BROKEN and c.n == 1 and report.level() == BROKEN
    assert c.evidence["n_high_violations"] == 1 and c.evidence["n_low_violations"] == 0 and c.evidence["examples"][0]["high"] == "98.0"


def test_non_positive_price_and_record_contract(spark):
    df = market(spark, [TWO[0], (*TWO[1][:5], 0.0)])
    c, report = one(df, "positive_prices")
    assert c.level and c.evidence["per_column"] == {"close": 1, "adj_close": 1}
    assert next(r for r in report.found if r.check == "record_contract").level
    assert one(df, "ohlc_consistency")[0].evidence["n_low_violations"] == 1


def test_duplicates(spark):
    c, report = one(market(spark, [*TWO, TWO[0]]), "duplicate_timestamps")
    assert c.level and c.n == 2 and c.evidence["examples"] == [{"ticker": "SPY", "date": "2024-01-01"}]
    assert next(r for r in report.found if r.check == "primary_key_unique").level


def test_nulls_by_share(spark):
    rows = [(d, "SPY", 100.0, 102.0, 99.0, 101.0 if i else None) for i, d in enumerate(bdays(40))]
    c, _ = one(market(spark, rows), "nullability")
    assert c.column == "close" and c.level == SUSPECT and c.n == 1 and c.evidence["missing_ratio"] == 0.025
    assert one(market(spark, rows[:10]), "nullability")[0].level == BROKEN


def test_volume(spark):
    rows = [(d, "SPY", 100.0, 102.0, 99.0, 101.0, 101.0, 0.0 if i < 2 else 5.0) for i, d in enumerate(bdays(10))]
    assert one(market(spark, rows), "volume_zero_share")[0].evidence["zero_share"] == 0.2
    rows[5] = (*rows[5][:7], -1.0)
    c, _ = one(market(spark, rows), "volume_non_negative")
    assert c.level and c.level == BROKEN
    assert not checks.volume_sanity({"n": 1})[0].level


def test_infinite_values(spark):
    c, _ = one(market(spark, [TWO[0], (*TWO[1][:6], float("inf"), 1.0)]), "finite_values")
    assert c.level and c.evidence["per_column"] == {"adj_close": 1}


def test_extreme_returns_see_the_previous_row(spark):
    days = bdays(6)
    prices = [100.0, 150.0, None, 151.0, 100.0, 101.0]
    rows = [(d, "SPY", 1.0, 2.0, 0.5, 1.0, p, 1.0) for d, p in zip(days, prices)]
    c, _ = one(market(spark, rows[::-1]), "extreme_returns")
    assert c.n == 2 and [e["log_return"] for e in c.evidence["examples"]] == [0.4055, -0.4121]


def test_order_of_arrival(spark):
    c, _ = one(market(spark, TWO[::-1]), "monotonic_timestamps")
    assert c.level and c.level == SUSPECT and c.evidence["entities"] == ["SPY"]
    same = market(spark, [TWO[0], TWO[0], (None, *TWO[1][1:])])
    assert series.out_of_order(same, "ticker", "date", ORDER).first().n_out_of_order == 1


def observed(spark, days, entity="X", frequency="B", value=None):
    return macro(spark, [(d, entity, "s", value if value is not None else float(i), "percent", frequency) for i, d in enumerate(days)])


def test_calendar_gaps(spark):
    days = bdays(60)
    c = checks.calendar_gaps(observed(spark, days[:20] + days[26:]), "indicator", frequency="frequency")
    assert c.level and c.evidence["per_series"]["X"] == {"missing": 6, "max_gap": 6, "unit": "business days", "missing_ratio": 0.1, "n_observations": 54}
    c = checks.calendar_gaps(observed(spark, days[:20] + days[21:]), "indicator")
    assert not c.level and c.evidence["per_series"]["X"]["missing"] == 1
    assert checks.calendar_gaps(observed(spark, [days[0], days[50]]), "indicator").evidence == {}
    weekend = [dt.date(2024, 1, 5), dt.date(2024, 1, 6), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
    assert series.calendar_gaps(observed(spark, weekend), "indicator", "date").first().missing == 0


@pytest.mark.parametrize(("frequency", "skip", "want"), [("M", 1, (1, 1, 12)), ("Q", 0, (0, 0, 4))])
def test_month_based_gaps(spark, frequency, skip, want):
    step = 3 if frequency == "Q" else 1
    days = [dt.date(2023, m, 28) for m in range(1, 13, step)]
    if skip:
        del days[4]
    r = series.calendar_gaps(observed(spark, days, frequency=frequency), "indicator", "date", "frequency").first()
    assert (r.missing, r.max_gap, r.expected, r.unit) == (*want, "months")


def test_spacing(spark):
    days = bdays(30) + [bdays(30)[-1] + dt.timedelta(7 * (i + 1)) for i in range(4)]
    c = checks.frequency_consistency(observed(spark, days), "indicator")
    assert c.level and c.evidence["per_series"]["X"] == {"modal_step_days": 1, "irregular_share": round(4 / 33, 4), "example_steps": [7]}
    assert not checks.frequency_consistency(observed(spark, bdays(30)), "indicator").level
    tie = [DAY + dt.timedelta(n) for n in (0, 1, 2, 3, 4, 12, 20, 28, 36, 37)]  # steps 1 and 8, five and four times
    assert series.step_consistency(observed(spark, tie), "indicator", "date").first().modal_step == 1
    assert series.step_consistency(observed(spark, tie[:9]), "indicator", "date").count() == 0


@pytest.mark.parametrize(("n", "passed"), [(10, True), (11, False)])
def test_stale_runs(spark, n, passed):
    days = bdays(30)
    values = [1.0, 2.0] + [5.0] * n + [6.0 + i for i in range(28 - n)]
    values[2 + n // 2 : 2 + n // 2] = [None]
    df = macro(spark, [(d, "X", "s", v, "percent", "B") for d, v in zip(days, values)])
    c = checks.stale_values(df, "indicator", "value")
    assert (c.level == HOLDS) is passed and (passed or c.evidence["per_series"]["X"] == {"run_length": n, "value": 5.0})
    twice = macro(spark, [(d, "X", "s", v, "percent", "B") for d, v in zip(days, [1.0, 1.0, 2.0, 2.0])])
    assert series.stale_runs(twice, "indicator", "value", ["date"]).first().value == 1.0


@pytest.mark.parametrize(("n", "severity"), [(10, BROKEN), (1, SUSPECT)])
def test_value_missingness(spark, n, severity):
    df = macro(spark, [(DAY + dt.timedelta(i), "X", "s", None if i < n else 1.0, "percent", "B") for i in range(100)])
    c = checks.value_missingness(df, "indicator")
    assert c.level and c.level == severity and c.n == n and c.evidence["per_series"]["X"]["missing_ratio"] == n / 100


def two_sources(spark, scale=1.0, unit="percent", n=40):
    days = bdays(40)
    return macro(spark, [(d, "Y", "fred", 4.25, "percent", "B") for d in days] + [(d, "Y", "akshare", 4.25 * scale, unit, "B") for d in days[:n]])


def test_cross_source(spark):
    (c,) = checks.cross_source_consistency(two_sources(spark), 5.0)
    assert not c.level and c.evidence["overlap"] == 40 and c.evidence["correlation"] is None and c.evidence["pair"] == ["akshare", "fred"]
    (c,) = checks.cross_source_consistency(two_sources(spark, 100), 5.0)
    assert c.level and c.level == BROKEN and c.n == 40 and c.column == "Y"
    (c,) = checks.cross_source_consistency(two_sources(spark, 1.02), 5.0)
    assert c.level and c.level == SUSPECT
    c = checks.cross_source_consistency(two_sources(spark, unit="tenths_of_percent"), 5.0)[0]
    assert c.check == "cross_source_units" and c.level == BROKEN and c.evidence["units"] == ["percent", "tenths_of_percent"]


def test_cross_source_overlap_and_absent_values(spark):
    assert checks.cross_source_consistency(two_sources(spark, 100, n=19), 5.0)[0].evidence["overlap"] == 19
    assert checks.cross_source_consistency(two_sources(spark, 100, n=20), 5.0)[0].level
    days = bdays(10)
    apart = macro(spark, [(days[0], "Y", "a", 1.0, "percent", "B"), (days[1], "Y", "b", 1.0, "percent", "B"), (days[1], "Y", "c", None, "percent", "B")])
    (c,) = checks.cross_source_consistency(apart, 5.0)
    assert not c.level and c.evidence == {"indicator": "Y", "pair": ["a", "b"], "overlap": 0}
    (c,) = checks.cross_source_consistency(observed(spark, days), 5.0)
    assert not c.level and not c.evidence
    assert checks.cross_source_consistency(observed(spark, days).drop("value"), 5.0)[0].check == "cross_source_inputs"
    last = macro(spark, [(days[0], "Y", "a", 1.0, "percent", "B"), (days[0], "Y", "a", 3.0, "percent", "B"), (days[0], "Y", "a", None, "percent", "B"), (days[0], "Y", "b", 3.0, "percent", "B")])
    assert pairs.source_pairs(last, 5.0, order=ORDER).first().max_abs_diff_bp == 0.0


def test_raw_stage(spark):
    contract = get_raw_contract("yahoo", "market_prices")
    names = [r.check for r in checks.raw_schema_drift(["date", "ticker", "open", "high", "low", "close", "new"], contract)]
    assert names == ["raw_required_columns", "raw_optional_columns", "raw_unexpected_columns"]
    assert checks.raw_schema_drift([], None)[0].level
    assert checks.duplicate_columns(["a", "b", "a"]).level and not checks.duplicate_columns(["a", "b"]).level
    assert checks.payload_not_empty(0).level == BROKEN and checks.min_rows(19, 20).level and not checks.min_rows(20, 20).level
    df = spark.createDataFrame([], f"`{CURVE_DATE}` string")
    report = checks.validate_raw(df, source="akshare", dataset="macro_data", run_id="r")
    assert report.level() == BROKEN and report.n_rows == 0


def test_schema_stage(spark):
    df = market(spark, TWO).drop(ORDER)
    assert checks.dtypes(df.withColumn("open", F.col("open").cast("string")).schema, MARKET_PRICES).level
    assert not checks.dtypes(df.withColumn("volume", F.col("volume").cast("long")).schema, MARKET_PRICES).level
    assert [c.check for c in checks.canonical_columns([*MACRO_DATA.column_names[1:], "x"], MACRO_DATA)] == ["canonical_columns", "canonical_extra_columns"]
    assert checks.timestamp_timezone(df.withColumn("date", F.col("date").cast("timestamp")).schema).level
    assert not checks.timestamp_timezone(df.withColumn("date", F.col("date").cast("timestamp_ntz")).schema).level


def test_the_check_log(spark):
    c = Checked.now(Subject("r", "d", "s", "raw"), 3, [finding("a", HOLDS, "fine"), [finding("b", BROKEN, "bad", n=2), finding("c", SUSPECT, "so so", "x")]])
    assert c.level() == BROKEN and [f.check for f in c.reaching(BROKEN)] == ["b"] and [f.check for f in c.reaching(SUSPECT)] == ["b", "c"]
    assert Checked.now(Subject("r", "d", "s", "raw"), 0, []).level() == HOLDS
    log = log_table(spark, [c, c])
    assert [(r.check_name, r.severity, r.passed, r.n_offending, r.column_name) for r in log.limit(3).collect()] == [("a", "INFO", True, 0, None), ("b", "ERROR", False, 2, None), ("c", "WARNING", False, 0, "x")]
    assert tuple(totals(log, "run_id").first()) == ("r", 6, 2, 2, 2)



def test_a_report_does_not_depend_on_partitioning(spark):
    days = bdays(50)
    df = macro(spark, [(d, f"I{i % 3}", "s", float(i % 7), "percent", "B") for i, d in enumerate(days)])
    rows = [sorted((r.check, r.level, str(r.evidence)) for r in checks.validate_normalized(x, dataset="macro_data", source="s", run_id="r").found) for x in (df, df.repartition(5))]
    assert rows[0] == rows[1] and len(rows[0]) == 13


def test_cross_source_judges_every_pair_and_unit(spark):
    """Errors after the thousandth indicator by name are reported, and all mixed units leave the comparison."""
    from pyspark.sql import functions as F

    from marlstone.plans import checks

    n = checks.DETAILS + 3
    base = spark.range(n * 40).select((F.col("id") % n).alias("k"), F.floor(F.col("id") / n).cast("int").alias("d"))
    side = F.when(F.col("d") % 2 == 0, "left").otherwise("right")
    wrong = F.when((F.col("k") == n - 1) & (side == "right"), 50.0).otherwise(1.0)
    date = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("d") / 2).cast("int"))
    good = base.select(F.format_string("p%05d", "k").alias("indicator"), date.alias("date"), wrong.alias("value"), side.alias("source"), F.lit("percent").alias("unit"))
    mixed = base.where("d < 2").select(F.format_string("m%05d", "k").alias("indicator"), date.alias("date"), F.lit(1.0).alias("value"), side.alias("source"), side.alias("unit"))
    found = checks.cross_source_consistency(good.union(mixed), 5.0)
    units = [c for c in found if c.check == "cross_source_units"]
    assert len(units) == checks.DETAILS + 1 and units[-1].n == 3 and all(c.level == BROKEN for c in units)
    compared = [c for c in found if c.check == "cross_source_consistency"]
    (broken,) = [c for c in compared if c.level]
    assert broken.level == BROKEN and broken.column == f"p{n - 1:05d}"
    assert len(compared) == checks.DETAILS + 1 and compared[-1].evidence["pairs"] == 3 and not compared[-1].level


def test_chunks_change_nothing(spark, monkeypatch):
    """Series cut into many chunks, against plain windows over whole series; nulls, ties by a second key, one-row chunks."""
    from pyspark.sql import Window

    rows = [(i, f"e{i % 3}" if i % 17 else None, (i * 7919) % 400, float((i // 4) % 3) if i % 11 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 37) % 900)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, e string, at long, v double, ts timestamp_ntz").repartition(5)
    for order in (["at"], ["ts", "id"]):
        lag = F.lag("v").over(Window.partitionBy("e").orderBy(*order))
        want = {r.id: r.b for r in df.where("e is not null").withColumn("b", lag).collect()}
        results = []
        for bits in (2, 20):
            monkeypatch.setattr(series, "CHUNK_BITS", bits)
            got = series.with_previous(df, "e", order, "v")
            assert {r.id: r[series.BEFORE] for r in got.collect()} == want
            results.append((sorted(map(tuple, series.stale_runs(df, "e", "v", order).collect())), sorted(map(tuple, series.out_of_order(df, "e", "id", "at").collect())), sorted(map(tuple, series.moves(df, "e", "v", order, 0.1).where("extreme").select("id").collect()))))
        assert results[0] == results[1] and all(results[0])
