import datetime as dt
import json
from pathlib import Path

import pytest
import sample_data
from pyspark.sql import functions as F

import marlstone
from marlstone import api, cli
from marlstone.operators import normalize
from marlstone.plans.ingest import run_pipeline
from marlstone.plans.lake import ContractViolation, Lake
from marlstone.settings import Run, Settings, get_settings, stable_hash
from marlstone.sources import FetchRequest, RawZone, connector_for, list_connectors, plan_for
from marlstone.sources.connectors import FredSeries, YahooBars, YieldCurve
from marlstone.sources.rawzone import ORDER, ChecksumError
from marlstone.streaming import load_stream

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
RUN = Run("r1", NOW, "offline", "f")


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sample")
    zone = RawZone(spark, f"{root}/raw")
    return zone, sample_data.write_all(zone), Settings(data_dir=f"{root}/data", sample_dir=f"{root}/raw")


@pytest.fixture(scope="module")
def result(spark, sample):
    return run_pipeline(spark, settings=sample[2])


def test_sample_payloads_are_the_published_ones(sample):
    assert {(s.source, s.dataset): s.checksum_sha256 for s in sample[1]} == sample_data.SHA
    assert [s.row_count for s in sample[1]] == [4686, 1566, 6264, 1557]


def test_run_loads_everything_and_finds_the_planted_defects(spark, sample, result):
    assert result.loaded_rows == {"market_prices": 4686, "macro_data": 15615} and not result.quarantined
    assert sum(len(c.found) for c in result.checked) == 78 == result.n_checks and result.n_errors == 2 and result.n_warnings == 5
    found = {(c.subject.dataset, c.subject.source, f.check): f for c in result.checked for f in c.reaching(1) if c.subject.stage == "normalized"}
    moves = found["market_prices", "yahoo", "extreme_returns"]
    assert moves.n == 2 and [e["log_return"] for e in moves.evidence["examples"]] == [0.4055, -0.3915]
    assert found["market_prices", "yahoo", "calendar_gaps"].evidence["per_series"] == {"GLD": {"missing": 12, "max_gap": 12, "unit": "business days", "missing_ratio": 0.0077, "n_observations": 1554}}
    assert found["macro_data", "fred", "value_missingness"].evidence["per_series"] == {"US_VIX": {"missing": 8, "n_observations": 1566, "missing_ratio": 0.0051}}
    assert {k: v["run_length"] for k, v in found["macro_data", "akshare", "stale_values"].evidence["per_series"].items()} == {"CN_TREASURY_30Y": 12}
    gaps = found["macro_data", "akshare", "calendar_gaps"].evidence["per_series"]
    assert len(gaps) == 5 and all((g["missing"], g["max_gap"], g["missing_ratio"]) == (9, 9, 0.0057) for g in gaps.values())
    keys = ("overlap", "median_abs_diff_bp", "p95_abs_diff_bp", "max_abs_diff_bp", "breach_share", "correlation")
    got = {tuple(c.evidence["pair"]): (not c.level, *(c.evidence[k] for k in keys)) for c in result.cross_source.found}
    assert got == {
        ("akshare", "fred"): (False, 1557, 43058.9, 57296.72, 58799.4, 1.0, 0.999529),
        ("akshare", "yahoo"): (False, 1557, 43058.27, 57295.562, 58799.61, 1.0, 0.999995),
        ("fred", "yahoo"): (True, 1566, 1.38, 3.7325, 7.24, 0.0102, 0.999525),
    }


def test_api(spark, sample, result):
    w = {"warehouse": result.warehouse}
    assert marlstone.list_datasets(spark, **w) == ["macro_data", "market_prices"]
    rows = marlstone.load_dataset(spark, "macro_data", indicators=["US_TREASURY_10Y"], sources=["fred", "yahoo"], start="2024-01-01", end="2024-01-05", **w).collect()
    assert [(str(r.date), r.source) for r in rows[:2]] == [("2024-01-01", "fred"), ("2024-01-01", "yahoo")] and len(rows) == 10 and {r.unit for r in rows} == {"percent"}
    assert marlstone.load_dataset(spark, "market_prices", tickers=["SPY"], indicators=["x"], **w).count() == 1566
    with pytest.raises(KeyError):
        marlstone.load_dataset(spark, "nope", **w)
    panel = marlstone.named_query(spark, "price_panel", **w)
    assert panel.columns == ["date", "spy", "tlt", "gld"] and panel.where("gld is null").count() == 12
    assert marlstone.query(spark, "SELECT * FROM price_panel", **w).count() == 1566
    assert marlstone.query(spark, "SELECT count(*) AS n FROM macro_data WHERE source = ? AND value > ?", ["fred", 100.0], **w).first().n > 1000
    assert marlstone.query(spark, "SELECT count(*) AS n FROM macro_data WHERE source = :s", {"s": "yahoo"}, **w).first().n == 1566
    newest = marlstone.named_query(spark, "us10y_cross_source", **w).take(3)
    assert [r.source for r in newest] == ["akshare", "fred", "yahoo"] and str(newest[0].date) == "2024-12-31"
    summary = marlstone.named_query(spark, "validation_summary", **w).collect()
    assert sum(r.checks for r in summary) == 78 and sum(r.errors for r in summary) == 2
    with pytest.raises(FileNotFoundError):
        marlstone.named_query(spark, "nope", **w)
    log = marlstone.dataset_metadata(spark, "macro_data", **w).collect()
    assert {r.source: r.row_count for r in log} == {"yahoo": 1566, "fred": 6264, "akshare": 7785} and {str(r.date_max) for r in log} == {"2024-12-31"}
    checks = marlstone.validation_report(spark, result.run_id, dataset="macro_data", source="__cross_source__", **w).collect()
    assert [r.severity for r in checks] == ["ERROR", "ERROR", "INFO"] and json.loads(checks[0].details_json)["overlap"] == 1557
    assert [r.severity for r in api.validation_report(spark, source="__cross_source__", worst_first=False, **w).collect()] == ["INFO", "ERROR", "ERROR"]
    assert api.last_run(spark, **w) == result.run_id


def test_scan_prunes_partitions_and_columns(spark, result):
    df = marlstone.load_dataset(spark, "macro_data", sources=["fred"], start="2024-01-01", warehouse=result.warehouse).select("date", "value", "source", "indicator")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [source" in plan.replace("isnotnull(source#", "source#") or "PartitionFilters: [isnotnull(source" in plan
    assert "GreaterThanOrEqual(date" in plan and "snapshot_id" not in plan.split("ReadSchema")[1]


def test_second_run_and_source_filter(spark, sample, result):
    again = run_pipeline(spark, settings=sample[2], sources=("FRED",))
    assert again.loaded_rows == {"macro_data": 6264}
    lake = Lake(spark, result.warehouse)
    assert lake.row_count("macro_data") == 15615 and lake.table("dataset_metadata").count() == 5


def test_cli(spark, sample, result, monkeypatch, capsys):
    monkeypatch.setenv("MARL_DATA_DIR", sample[2].data_dir)
    monkeypatch.setenv("MARL_SAMPLE_RAW_DIR", sample[2].sample_dir)
    get_settings.cache_clear()
    try:
        for argv, said in ((["datasets"], "market_prices"), (["query", "price_panel"], "spy"), (["query", "SELECT 41 + 1 AS x"], "42"), (["sources"], "yfinance"), (["load", "macro_data", "--sources", "fred", "--end", "2019-01-02"], "US_VIX"), (["report"], "check_name"), (["metadata"], "row_count"), (["run", "--sources", "akshare"], "7785 rows in macro_data")):
            assert cli.main(argv, spark) == 0
            assert said in capsys.readouterr().out
        monkeypatch.setenv("MARL_DATA_DIR", sample[2].data_dir + "-none")
        get_settings.cache_clear()
        assert cli.main(["report"], spark) == 1
    finally:
        get_settings.cache_clear()
    with pytest.raises(SystemExit):
        cli.main(["--version"], spark)


def test_bad_payloads(spark, tmp_path):
    zone = RawZone(spark, f"{tmp_path}/raw")
    names = ["date", "ticker", "open", "high", "low", "close", "volume"]
    day = lambda i: (dt.date(2024, 1, 1) + dt.timedelta(i)).isoformat()
    zone.write("yahoo", "market_prices", names, [(day(i), "SPY", 10, 9, 8, 10, 5) for i in range(30)], RUN, retrieved_at=NOW)
    zone.write("yahoo", "macro_data", ["date", "ticker"], [(day(0), "^TNX")], RUN, retrieved_at=NOW)
    zone.write("fred", "macro_data", ["date", "series_id", "value"], [(day(i), "NOPE", 1) for i in range(30)], RUN, retrieved_at=NOW)
    settings = Settings(data_dir=f"{tmp_path}/data", sample_dir=f"{tmp_path}/raw")
    out = run_pipeline(spark, settings=settings)
    assert out.quarantined == [("market_prices", "yahoo")] and out.loaded_rows == {}
    assert spark.read.option("header", True).csv(f"{out.warehouse}/quarantine/*").count() == 30
    stages = {c.subject[1:]: c.level() == 2 for c in out.checked}
    assert stages["macro_data", "yahoo", "raw"] and ("macro_data", "yahoo", "normalized") not in stages
    snapshot = zone.latest("yahoo", "market_prices")
    path = Path(snapshot.path.removeprefix("file:"))
    (path.parent / f".{path.name}.crc").unlink()  # the local file system's own check, which other stores don't have
    with path.open("a") as f:
        f.write("2030-01-01,SPY,1,1,1,1,1\n")
    assert [s.snapshot_id for s in zone.verify(zone.list_snapshots())] == [snapshot.snapshot_id]
    with pytest.raises(ChecksumError):
        run_pipeline(spark, settings=settings)
    with pytest.raises(ValueError):
        run_pipeline(spark, mode="nope", settings=settings)


def test_raw_zone(spark, tmp_path):
    zone = RawZone(spark, f"{tmp_path}/raw")
    rows = [("1", 'say "hi", you', ""), ("2", "two\nlines", None), ("3", " padded ", "\\back")]
    first = zone.write("x", "y", ["a", "b", "c"], rows, RUN, params={"p": 1}, retrieved_at=NOW)
    got = zone.read(first).orderBy(ORDER).collect()
    assert [(r.a, r.b, r.c) for r in got] == [("1", 'say "hi", you', ""), ("2", "two\nlines", ""), ("3", " padded ", "\\back")]
    with pytest.raises(FileExistsError):
        zone.write("x", "y", ["a", "b", "c"], rows, RUN, params={"p": 1}, retrieved_at=NOW)
    later = zone.write("x", "y", ["a", "a"], [("1", "2")], RUN, retrieved_at=NOW + dt.timedelta(days=1))
    assert zone.latest("x", "y").snapshot_id == later.snapshot_id and zone.latest("x", "z") is None and len(zone.list_snapshots("x")) == 2
    assert zone.header(later) == ["a", "a"] and [c for c in zone.read(later).columns if c != ORDER] == ["a", "a.1"]
    assert not zone.verify([first, later]) and zone.list_snapshots()[0].params == {"p": 1}
    assert first.line_breaks and not later.line_breaks and zone.list_snapshots("x")[0].manifest() == first.manifest()
    n = 150_000  # over a block, from a generator, read by many tasks in the order of delivery
    big = zone.write("x", "big", ["i", "t"], ((i, f"text {i}, {'y' * 20}") for i in range(n)), RUN, retrieved_at=NOW)
    assert big.row_count == n and zone.files.size(big.path) > 5 * (1 << 20) and zone.files.sha256(big.path) == big.checksum_sha256 and not zone.verify([big])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = zone.read(big)
        assert df.rdd.getNumPartitions() > 3 and [int(r.i) for r in df.orderBy(ORDER).collect()] == list(range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert not [f for f in zone.files.glob(f"{zone.root}/x/big/*/.*") if not f.endswith(".crc")]


def normalized(spark, source, dataset, columns, rows):
    raw = spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"`{c}` string" for c in columns))
    return normalize.NORMALIZERS[dataset][0](raw, source=source, snapshot_id="s", run_id="r", ingested_at=NOW)


def test_normalizers(spark):
    names = ["date", "ticker", "open", "high", "low", "close", "volume"]
    df = normalized(spark, "yahoo", "market_prices", names, [("2024-01-02", " SPY", "1", "2", "0.5", "1.5", "1e7"), ("2024-01-03", "NOTREAL", 1, 1, 1, 1, 1), ("soon", "TLT", "1,000", ".", "NA", "", "-")])
    rows = {r.ticker: r for r in df.collect()}
    assert set(rows) == {"SPY", "TLT"} and rows["SPY"].volume == 1e7 and rows["SPY"].currency == "USD" and rows["SPY"].adj_close is None and rows["TLT"].date is None and rows["TLT"].open == 1000.0
    df = normalized(spark, "yahoo", "macro_data", ["date", "ticker", "close"], [("2024-01-02", "^TNX", "42.5"), ("bad", "^TNX", "1")])
    (r,) = df.collect()
    assert (r.indicator, r.unit, round(r.value, 9), r.frequency, r.source) == ("US_TREASURY_10Y", "percent", 4.25, "B", "yahoo")
    label = "中国国债收益率10年"
    df = normalized(spark, "akshare", "macro_data", ["日期", label, "别的"], [("2024-01-02", "2.5", "9"), ("2024-01-03", "", "9")])
    assert [(r.indicator, r.value) for r in df.orderBy("date").collect()] == [("CN_TREASURY_10Y", 2.5), ("CN_TREASURY_10Y", None)]
    assert normalized(spark, "nobody", "macro_data", ["date"], [("2024-01-02",)]) is None and normalized(spark, "yahoo", "market_prices", ["date"], [("2024-01-02",)]) is None
    assert normalize.empty(spark, normalize.MACRO_DATA).count() == 0


def test_units(spark):
    df = spark.createDataFrame([(42.5,)], "x double")
    value, unit = normalize.convert_unit(F.col("x"), "tenths_of_percent")
    assert unit == "percent" and df.select(value).first()[0] == 42.5 * 0.1
    with pytest.raises(ValueError):
        normalize.convert_unit(F.col("x"), "furlongs")


def test_normalize_latest(spark, sample, tmp_path):
    tables = normalize.normalize_latest(sample[0], "r")
    assert {k: df.count() for k, df in tables.items()} == {"market_prices": 4686, "macro_data": 15615}
    with pytest.raises(FileNotFoundError):
        normalize.normalize_latest(RawZone(spark, f"{tmp_path}/none"), "r")


def macro_rows(spark, source, n=5, value=1.0):
    return spark.range(n).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit("X").alias("indicator"), F.lit(source).alias("source"), F.lit(value).alias("value"), F.lit("percent").alias("unit"), F.lit("B").alias("frequency"),
        F.lit("s").alias("snapshot_id"), F.lit("r").alias("run_id"), F.lit(NOW).alias("ingested_at"),
    )


def test_idempotent_load(spark, tmp_path):
    with Lake(spark, f"{tmp_path}/lake") as lake:
        assert lake.row_count("macro_data") == 0 and lake.tables() == ["dataset_metadata", "macro_data", "market_prices", "validation_results"]
        for _ in range(2):
            assert lake.load_dataset("macro_data", macro_rows(spark, "a"), RUN) == 5 and lake.row_count("macro_data") == 5
        lake.load_dataset("macro_data", macro_rows(spark, "b"), RUN)
        lake.load_dataset("macro_data", macro_rows(spark, "a", 3, 9.0), RUN)
        assert {r.source: (r.n, r.v) for r in lake.query("SELECT source, count(*) AS n, max(value) AS v FROM macro_data GROUP BY source").collect()} == {"a": (3, 9.0), "b": (5, 1.0)}
        assert lake.load_dataset("macro_data", macro_rows(spark, "a", 0), RUN) == 0 and lake.row_count("macro_data") == 8
        with pytest.raises(ContractViolation):
            lake.load_dataset("macro_data", macro_rows(spark, "a").withColumn("unit", F.lit(None).cast("string")), RUN)
        assert lake.row_count("macro_data") == 8 and lake.persist_validation([]) == 0


def test_stream_loads_like_a_batch(spark, tmp_path):
    lake = Lake(spark, f"{tmp_path}/lake")
    lake.load_dataset("macro_data", macro_rows(spark, "a"), RUN)
    for k, rows in enumerate((macro_rows(spark, "a", 7, 2.0), macro_rows(spark, "b", 2))):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        load_stream(stream, lake, "macro_data", RUN, f"{tmp_path}/ckpt").awaitTermination()
        assert lake.row_count("macro_data") == (7, 9)[k]
    assert {r.value for r in lake.table("macro_data").where("source = 'a'").collect()} == {2.0}


def test_connectors(spark, sample):
    zone, _, settings = sample
    assert [p.source for p in plan_for(("Fred",))] == ["fred"] and len(plan_for()) == 4
    with pytest.raises(ValueError):
        connector_for("fred", "macro_data", "nope")
    with pytest.raises(KeyError):
        connector_for("fred", "nope")
    replay = connector_for("akshare", "macro_data", "offline", zone=zone)
    request = FetchRequest("macro_data", ("CN10Y", "NOPE"))
    assert replay.unavailable() is None and replay.read(spark, request).columns == ["日期", "中国国债收益率10年"]
    assert connector_for("fred", "macro_data", "offline", zone=zone).read(spark, FetchRequest("macro_data", ("DGS2",))).count() == 1566
    assert len(connector_for("yahoo", "macro_data", "offline", zone=zone).fetch(FetchRequest("macro_data")).rows) == 1566
    listed = {(r.source, r.dataset): r for r in list_connectors(spark, settings).collect()}
    assert listed["fred", "macro_data"].requires_api_key and not listed["fred", "macro_data"].available and "FRED_API_KEY" in listed["fred", "macro_data"].reason


def test_live_connectors_without_a_network(spark):
    settings = Settings(data_dir="d", sample_dir="s", fred_api_key="k")

    class Bars(YahooBars):
        def download(self, symbol, start, end):
            return [{"date": "2024-01-02", "Open": 1.0, "Close": 2.0}] if symbol == "SPY" else []

    p = Bars(settings).fetch(FetchRequest("market_prices", ("SPY", "NONE")))
    assert p.rows == [("2024-01-02", "SPY", 1.0, None, None, 2.0, None, None)] and Bars(settings).read(spark, FetchRequest("market_prices", ("SPY",))).first().close == "2.0"

    class Fred(FredSeries):
        tries, waits = 0, []
        sleep = staticmethod(lambda s: Fred.waits.append(s))

        def get(self, query):
            Fred.tries += 1
            if Fred.tries < 3:
                raise OSError("busy")
            return {"observations": [{"date": query["observation_start"], "value": "."}]}

    assert Fred(settings).fetch(FetchRequest("macro_data", ("DGS2",))).rows == [("2019-01-01", "DGS2", ".")] and Fred.waits == [1, 2]
    Fred.tries = -100
    with pytest.raises(RuntimeError):
        Fred(settings).fetch(FetchRequest("macro_data", ("DGS2",)))

    class Curve(YieldCurve):
        def table(self, start):
            return ["日期", "中国国债收益率2年", "x"], [("2018-01-01", 1, 2), ("2024-01-02", 3, 4)]

    p = Curve(settings).fetch(FetchRequest("macro_data", ("CN2Y", "CN5Y")))
    assert p.columns == ("日期", "中国国债收益率2年") and p.rows == [("2024-01-02", 3)]


def test_settings(monkeypatch):
    monkeypatch.setenv("MARL_MISSING_RATIO_ERROR", "nonsense")
    monkeypatch.setenv("MARL_MIN_EXPECTED_ROWS", "7")
    monkeypatch.setenv("MARL_FRED_API_KEY", " secret ")
    get_settings.cache_clear()
    s = get_settings()
    get_settings.cache_clear()
    assert (s.missing_ratio_error, s.min_expected_rows, s.fred_api_key) == (0.05, 7, "secret") and "secret" not in str(s.fingerprint())
    assert stable_hash({"a": 1, "b": 2}) == stable_hash({"b": 2, "a": 1}) and len(stable_hash(1)) == 16
