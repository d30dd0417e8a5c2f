"""The driver's queries: every operator applied to whole tables of the test data, with equivalent SQL.

`events` stand in for ticks, `orders` for dated observations; a synthetic source is user_id % 3. Doubles are rounded to
six places on both sides.
"""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registries
from .api import list_datasets, named_query, select_rows, summarize_checks, validation_report
from .contracts import CONTRACTS, CURVE_DATE, CURVE_LABELS, MACRO_DATA, MARKET_PRICES, get_raw_contract, type_family
from .functions import business_days, date_from_text, months, number_from_text
from .operators import bars, dedup, normalize, pairs, series
from .plans import checks
from .plans.findings import HOLDS, SPELLED, Checked, Subject
from .plans.ingest import run_pipeline
from .plans.lake import Lake
from .settings import Run, Settings, utc_now
from .sources.connectors import FetchRequest, connector_for, list_connectors, plan_for
from .sources.rawzone import ORDER, RawZone, arrival

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, *dates: str) -> Callable[[Query], Query]:
    """Register a query and its SQL; date columns are shown as text on both sides."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in dates}) if dates else f(spark, d)
        shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
        SQL[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if dates else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for written tables, where all executors reach it; it goes when the driver ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    folder = f"{(named or tempfile.mkdtemp(prefix='marlstone-')).rstrip('/')}/lake-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


TYPES = ["click", "error", "purchase", "signup", "view"]
BARS = """
  SELECT event_type, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2"""


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return bars.daily_bars(table(spark, d, "events"), "event_type", "ts", "value", "event_id")


@query(f"SELECT event_type, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM ({BARS})", "date")
def daily_bars(spark, d):
    return _bars(spark, d).select("event_type", "date", *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query(f"""SELECT date, round(max(CASE WHEN event_type = 'click' THEN close END), 6) AS click, round(max(CASE WHEN event_type = 'purchase' THEN close END), 6) AS purchase,
  round(max(CASE WHEN event_type = 'view' THEN close END), 6) AS view FROM ({BARS}) WHERE event_type IN ('click', 'purchase', 'view') GROUP BY date""", "date")
def price_panel(spark, d):
    wide = bars.panel(_bars(spark, d), "date", "event_type", "close", ["click", "purchase", "view"])
    return wide.select("date", *[r6(c).alias(c) for c in ("click", "purchase", "view")])


@query("""SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS F, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS O,
  arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) > 0""", "date")
def pivot_last(spark, d):
    rows = table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    return bars.pivot_last(rows, "date", "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O", "P"]).where("F is not null or O is not null or P is not null")


NUMBER_TEXT = "CASE event_id % 9 WHEN 0 THEN n WHEN 1 THEN n || '.25' WHEN 2 THEN ' 1,' || lpad(n, 3, '0') || ' ' WHEN 3 THEN '.' WHEN 4 THEN 'NA' WHEN 5 THEN n || 'd' WHEN 6 THEN '-' || n || 'e2' WHEN 7 THEN 'nan' ELSE '1e400' END"
NUMBER = "CASE event_id % 9 WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CAST(n AS DOUBLE) + 0.25 WHEN 2 THEN 1000.0 + CAST(right(lpad(n, 3, '0'), 3) AS DOUBLE) WHEN 6 THEN -100.0 * CAST(n AS DOUBLE) END"


@query(f"SELECT event_id, CAST({NUMBER} AS DOUBLE) AS number FROM (SELECT event_id, CAST(event_id % 1000 AS VARCHAR) AS n FROM events)")
def coerce_numeric_text(spark, d):
    text = table(spark, d, "events").select("event_id", (F.col("event_id") % 1000).cast("string").alias("n"))
    return text.select("event_id", number_from_text(F.expr(NUMBER_TEXT)).alias("number"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) WHEN 2 THEN CAST(date_trunc('second', ts) - INTERVAL 5 HOUR AS DATE) END AS day FROM events""", "day")
def coerce_date_text(spark, d):
    form = lambda f: F.date_format("ts", f)
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, form("yyyy-MM-dd")).when(kind == 1, form("yyyy-MM-dd HH:mm:ss")).when(kind == 2, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))).when(kind == 3, "soon").otherwise("")
    return table(spark, d, "events").select("event_id", date_from_text(text).alias("day"))


REGISTRY = [("app", "click", "ACTION_CLICK", 0.1), ("app", "purchase", "ACTION_BUY", 100.0), ("app", "view", "ACTION_VIEW", 1.0), ("web", "signup", "ACTION_JOIN", 1.0)]
REGISTRY_SQL = "(VALUES " + ", ".join(str(r) for r in REGISTRY) + ") AS r(source, symbol, indicator, factor)"


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "source string, symbol string, indicator string, factor double")


@query(f"SELECT event_id, indicator, round(value * factor, 6) AS value FROM events JOIN {REGISTRY_SQL} ON source = 'app' AND symbol = event_type")
def symbol_map_join(spark, d):
    joined = normalize.mapped(table(spark, d, "events"), _registry(spark), "app", "event_type").where("indicator is not null")
    return joined.select("event_id", "indicator", r6(normalize.convert(F.col("value"), F.col("factor"), F.lit(1.0))).alias("value"))


@query(f"SELECT event_type, count(*) AS n_dropped FROM events WHERE event_type NOT IN (SELECT symbol FROM {REGISTRY_SQL} WHERE source = 'app') GROUP BY 1")
def unmapped_symbols(spark, d):
    return normalize.unmapped(table(spark, d, "events"), _registry(spark), "app", "event_type").groupBy("event_type").agg(F.count("*").alias("n_dropped"))


@query("""SELECT o_orderpriority, s AS status, (SELECT count(*) FROM orders x WHERE x.o_orderpriority = p.o_orderpriority AND x.o_orderstatus = s) AS n_orders
  FROM (SELECT DISTINCT o_orderpriority FROM orders) p, (VALUES ('F'), ('O'), ('P')) v(s)""")
def unpivot_long(spark, d):
    wide = table(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"])
    return normalize.unpivot(wide, ["o_orderpriority"], "status", "n_orders")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS priority, o_orderstatus AS source FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'""", "date")
def load_filtered(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("source"))
    return select_rows(rows, "priority", entities=["1-URGENT", "2-HIGH"], sources=["F", "O"], start="1996-01-01", end="1997-06-30")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id")
def latest_per_source(spark, d):
    return dedup.latest_per(table(spark, d, "events").withColumn("value", r6("value")), ["user_id"], F.struct("ts", "event_id"), ["event_type", "value"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_duplicates(spark, d):
    return dedup.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_rows FROM events GROUP BY 1, 2 HAVING count(*) > 1", "day")
def duplicate_timestamps(spark, d):
    return dedup.duplicate_keys(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"])


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE}) AS place FROM lineitem) WHERE place = 1")
def dedup_keep_first(spark, d):
    kept = dedup.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], LINE.split(", "))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _market(spark: SparkSession, d: str) -> DataFrame:
    """Bars in the shape of market_prices, with defects by a rule on the day of the month."""
    day = F.dayofmonth("date")
    b = _bars(spark, d)
    return b.select(
        "date", F.col("event_type").alias("ticker"), F.lit("test").alias("source"), F.when(day % 10 == 3, 0.0).otherwise(F.col("open")).alias("open"), F.when(day % 7 == 2, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low", F.when(day % 11 != 5, F.col("close")).alias("close"), F.lit(None).cast("double").alias("adj_close"), F.when(day % 9 == 4, -1.0).when(day % 5 == 0, 0.0).otherwise(F.col("volume").cast("double")).alias("volume"),
        F.when(day % 13 == 6, "US").otherwise("USD").alias("currency"),
    )


MARKET = f"""(SELECT date, event_type AS ticker, CASE WHEN day(date) % 10 = 3 THEN 0.0 ELSE open END AS open, CASE WHEN day(date) % 7 = 2 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN day(date) % 11 <> 5 THEN close END AS close, CASE WHEN day(date) % 9 = 4 THEN -1.0 WHEN day(date) % 5 = 0 THEN 0.0 ELSE volume::DOUBLE END AS volume,
  CASE WHEN day(date) % 13 = 6 THEN 'US' ELSE 'USD' END AS currency FROM ({BARS}))"""


def _measures(spark: SparkSession, profile: dict, wanted: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(name, int(profile[key])) for name, key in wanted.items()], "measure string, n long")


def _one(names: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS measure, count(*) FILTER ({v}) AS n FROM {source}" for k, v in names.items())


@query(_one({"close": "close IS NULL", "open": "open IS NULL", "rows": "true", "volume": "volume IS NULL"}, MARKET))
def null_profile(spark, d):
    return _measures(spark, checks.scalar_profile(_market(spark, d), MARKET_PRICES), {"close": "null:close", "open": "null:open", "rows": "n", "volume": "null:volume"})


@query(f"""SELECT ticker, count(*) FILTER (NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND length(currency) = 3, false)) AS n_invalid FROM {MARKET} GROUP BY ticker""")
def record_contract(spark, d):
    rows = _market(spark, d)
    return rows.groupBy("ticker").agg(F.count_if(~MARKET_PRICES.row_is_valid(rows.columns)).alias("n_invalid"))


@query(_one({c: f"{c} <= 0" for c in ("open", "high", "low", "close")}, MARKET))
def positive_prices(spark, d):
    return _measures(spark, checks.scalar_profile(_market(spark, d), MARKET_PRICES), {c: f"low:{c}" for c in ("open", "high", "low", "close")})


INFINITE = "(SELECT CASE WHEN c_custkey % 50 = 0 THEN 'inf'::DOUBLE WHEN c_custkey % 50 = 1 THEN '-inf'::DOUBLE WHEN c_custkey % 50 = 2 THEN NULL ELSE c_acctbal END AS value FROM customer)"


@query(_one({"value": "abs(value) = 'inf'::DOUBLE"}, INFINITE))
def finite_values(spark, d):
    k = F.col("c_custkey") % 50
    rows = table(spark, d, "customer").select(F.when(k == 0, float("inf")).when(k == 1, float("-inf")).when(k != 2, F.col("c_acctbal")).alias("value"))
    return _measures(spark, checks.scalar_profile(rows, MACRO_DATA), {"value": "inf:value"})


HIGH, LOW = "coalesce(high < greatest(open, close, low), false)", "coalesce(low > least(open, close), false)"


@query(_one({"any": f"{HIGH} OR {LOW}", "high": HIGH, "low": LOW}, MARKET))
def ohlc_consistency(spark, d):
    return _measures(spark, checks.scalar_profile(_market(spark, d), MARKET_PRICES), {"any": "bars", "high": "bars_high", "low": "bars_low"})


@query(_one({"negative": "volume < 0", "observed": "volume IS NOT NULL", "zero": "volume = 0"}, MARKET))
def volume_sanity(spark, d):
    return _measures(spark, checks.scalar_profile(_market(spark, d), MARKET_PRICES), {"negative": "negative_volume", "observed": "volumes", "zero": "zero_volume"})


@query("""SELECT event_type, count(*) FILTER (v IS NULL) AS missing, count(*) AS n_observations, round(count(*) FILTER (v IS NULL) / count(*), 6) AS missing_ratio
  FROM (SELECT event_type, CASE WHEN event_id % 17 <> 3 THEN value END AS v FROM events) GROUP BY 1 HAVING count(*) FILTER (v IS NULL) > 0""")
def value_missingness(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 17 != 3, F.col("value")))
    return series.missingness(rows, "event_type", "v").withColumn("missing_ratio", r6("missing_ratio"))


@query("""SELECT user_id, event_id, round(ln(value / before), 6) AS log_move FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  WHERE before > 0 AND value > 0 AND abs(ln(value / before)) > 2.5""")
def extreme_returns(spark, d):
    found = series.moves(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"], 2.5).where("extreme and abs(log_move) < double('inf')")
    return found.select("user_id", "event_id", r6("log_move").alias("log_move"))


@query("""SELECT user_id, event_id, CASE WHEN v = 0 THEN 'to zero' ELSE 'from zero' END AS move FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
  FROM (SELECT *, CASE WHEN event_id % 23 = 0 THEN 0.0 ELSE value END AS v FROM events)) WHERE (v = 0) <> (before = 0) AND v >= 0 AND before >= 0""")
def infinite_returns(spark, d):
    """Moves to zero and from it are infinite in logs, and reported."""
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 23 == 0, 0.0).otherwise(F.col("value")))
    found = series.moves(rows, "user_id", "v", ["ts", "event_id"], 2.5).where("extreme and abs(log_move) = double('inf')")
    return found.select("user_id", "event_id", F.when(F.col("log_move") < 0, "to zero").otherwise("from zero").alias("move"))


@query("""SELECT o_custkey, count(*) AS n_out_of_order FROM (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
  WHERE o_orderdate < before GROUP BY 1""")
def monotonic_timestamps(spark, d):
    return series.out_of_order(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


def _weekdays(day: str) -> str:
    n = f"date_diff('day', DATE '1970-01-05', {day})"
    return f"(5 * (({n} - (({n} % 7 + 7) % 7)) // 7) + least(({n} % 7 + 7) % 7, 5))"


def _gaps(entity: str, step: str, expected: str, unit: str) -> str:
    return f"""SELECT {entity}, count(*) AS n_observations, coalesce(sum(greatest(step - {1 if unit != 'quarters' else 3}, 0)), 0)::BIGINT AS missing, coalesce(max(greatest(step - 1, 0)), 0)::BIGINT AS max_gap,
      ({expected} + 1)::BIGINT AS expected, round(coalesce(sum(greatest(step - 1, 0)), 0) / greatest({expected} + 1, 1), 6) AS missing_ratio, '{unit}' AS unit
    FROM (SELECT {entity}, day, {step} AS step FROM (SELECT {entity}, day, lag(day) OVER (PARTITION BY {entity} ORDER BY day) AS before FROM (SELECT DISTINCT {entity}, CAST(o_orderdate AS DATE) AS day FROM orders)))
    GROUP BY 1 HAVING count(*) >= 3"""


@query(_gaps("o_orderpriority", f"{_weekdays('day')} - {_weekdays('before')}", f"{_weekdays('max(day)')} - {_weekdays('min(day)')}", "business days"))
def calendar_gaps_business(spark, d):
    return series.calendar_gaps(table(spark, d, "orders"), "o_orderpriority", "o_orderdate").withColumn("missing_ratio", r6("missing_ratio"))


def _month(day: str) -> str:
    return f"(year({day}) * 12 + month({day}))"


@query(_gaps("o_custkey", f"{_month('day')} - {_month('before')}", f"{_month('max(day)')} - {_month('min(day)')}", "months"))
def calendar_gaps_monthly(spark, d):
    return series.calendar_gaps(table(spark, d, "orders").withColumn("frequency", F.lit("M")), "o_custkey", "o_orderdate", "frequency").withColumn("missing_ratio", r6("missing_ratio"))


@query("""WITH s AS (SELECT o_custkey, date_diff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day) AS step FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)),
  h AS (SELECT o_custkey, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, first_value(step) OVER (PARTITION BY o_custkey ORDER BY n DESC, step) AS modal FROM h)
  SELECT o_custkey, sum(n)::BIGINT AS n_steps, max(modal)::BIGINT AS modal_step, coalesce(sum(n) FILTER (step NOT BETWEEN modal AND modal + 3), 0)::BIGINT AS n_irregular,
    round(coalesce(sum(n) FILTER (step NOT BETWEEN modal AND modal + 3), 0) / sum(n), 6) AS irregular_share FROM m GROUP BY 1 HAVING sum(n) >= 9""")
def frequency_consistency(spark, d):
    return series.step_consistency(table(spark, d, "orders"), "o_custkey", "o_orderdate").drop("example_steps").withColumn("irregular_share", r6("irregular_share"))


@query("""WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT user_id, event_type, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c), l AS (SELECT user_id, run, count(*) AS n, min(event_type) AS event_type FROM r GROUP BY 1, 2)
  SELECT user_id, max(n) AS run_length, arg_max(event_type, (n, -run)) AS value FROM l GROUP BY 1""")
def stale_runs(spark, d):
    return series.stale_runs(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


OBSERVED = """(SELECT event_type AS indicator, CAST(ts AS DATE) AS date, 's' || CAST(user_id % 3 AS VARCHAR) AS source, avg(value) AS value FROM events GROUP BY 1, 2, 3)"""


def _observed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    source = F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))
    return e.groupBy(F.col("event_type").alias("indicator"), F.to_date("ts").alias("date"), source.alias("source")).agg(F.avg("value").alias("value"))


@query(f"""WITH o AS {OBSERVED}, p AS (SELECT a.indicator, a.source AS "left", b.source AS "right", abs(a.value - b.value) * 100 AS d, a.value AS x, b.value AS y
    FROM o a JOIN o b ON a.indicator = b.indicator AND a.date = b.date AND a.source < b.source)
  SELECT indicator, "left", "right", count(*) AS overlap, round(quantile_cont(d, 0.5), 4) AS median_abs_diff_bp, round(quantile_cont(d, 0.95), 4) AS p95_abs_diff_bp, round(max(d), 4) AS max_abs_diff_bp,
    round(avg((d > 500)::INT), 6) AS breach_share, count(*) FILTER (d > 500) AS n_breach, round(corr(x, y), 6) AS correlation FROM p GROUP BY 1, 2, 3""")
def cross_source_pairs(spark, d):
    found = pairs.source_pairs(_observed(spark, d).withColumn("unit", F.lit("percent")), 500.0).drop("unit")
    return found.withColumns({c: F.round(c, 4) for c in ("median_abs_diff_bp", "p95_abs_diff_bp", "max_abs_diff_bp")} | {c: r6(c) for c in ("breach_share", "correlation")})


@query("""SELECT event_type AS indicator, string_agg(DISTINCT u, ',' ORDER BY u) AS units, string_agg(DISTINCT s, ',' ORDER BY s) AS sources
  FROM (SELECT event_type, CASE WHEN event_type IN ('click', 'view') AND user_id % 3 = 1 THEN 'index' ELSE 'percent' END AS u, 's' || CAST(user_id % 3 AS VARCHAR) AS s FROM events)
  GROUP BY 1 HAVING count(DISTINCT u) > 1 AND count(DISTINCT s) > 1""")
def cross_source_units(spark, d):
    unit = F.when(F.col("event_type").isin("click", "view") & (F.col("user_id") % 3 == 1), "index").otherwise("percent")
    rows = table(spark, d, "events").select(F.col("event_type").alias("indicator"), unit.alias("unit"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"))
    return pairs.mixed_units(rows).select("indicator", F.array_join("units", ",").alias("units"), F.array_join("sources", ",").alias("sources"))


@query("""SELECT user_id, count(DISTINCT event_type) AS n_sources, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1""")
def multi_source_indicators(spark, d):
    return pairs.multi_source_entities(table(spark, d, "events"), "user_id", "event_type")


@query(f"SELECT indicator, source, count(*) AS n_observations, count(*) FILTER (value IS NULL) AS n_missing, min(date) AS first_date, max(date) AS last_date FROM {OBSERVED} GROUP BY 1, 2", "first_date", "last_date")
def coverage_summary(spark, d):
    return pairs.coverage_summary(_observed(spark, d))


CHECK_ROWS = """(SELECT 'run' || CAST(o_custkey % 7 AS VARCHAR) AS run_id, o_orderpriority AS dataset, o_orderstatus AS source, 'raw' AS stage, o_totalprice < 100000 AS passed,
  CASE WHEN o_totalprice < 100000 THEN 'INFO' WHEN o_totalprice < 200000 THEN 'WARNING' ELSE 'ERROR' END AS severity FROM orders)"""


@query(f"""SELECT run_id, dataset, source, stage, count(*) AS checks, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed AND severity = 'ERROR') AS errors,
  count(*) FILTER (NOT passed AND severity = 'WARNING') AS warnings FROM {CHECK_ROWS} GROUP BY 1, 2, 3, 4""")
def validation_summary(spark, d):
    price = F.col("o_totalprice")
    severity = F.when(price < 100000, "INFO").when(price < 200000, "WARNING").otherwise("ERROR")
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("run"), (F.col("o_custkey") % 7).cast("string")).alias("run_id"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("source"), F.lit("raw").alias("stage"), (price < 100000).alias("passed"), severity.alias("severity")
    )
    return summarize_checks(rows)


RETURNS = f"(SELECT event_type, date, close / lag(close) OVER (PARTITION BY event_type ORDER BY date) - 1 AS ret FROM ({BARS}))"


@query(f"SELECT event_type, date, round(ret, 6) AS ret FROM {RETURNS} WHERE ret IS NOT NULL", "date")
def returns_panel(spark, d):
    return bars.simple_returns(_bars(spark, d), "event_type", "date", "close").withColumn("ret", r6("ret"))


@query(f"SELECT event_type, date, round(exp(sum(ln(1 + ret)) OVER (PARTITION BY event_type ORDER BY date)) - 1, 4) AS cumulative FROM {RETURNS} WHERE ret IS NOT NULL", "date")
def cumulative_returns(spark, d):
    returns = bars.simple_returns(_bars(spark, d), "event_type", "date", "close")
    return bars.cumulative_returns(returns, "event_type", "date").withColumn("cumulative", F.round("cumulative", 4))


@query("""SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::BIGINT AS days, ("""
       + f"{_weekdays('CAST(o_orderdate AS DATE)')} - {_weekdays(chr(68) + 'ATE ' + chr(39) + '1995-01-01' + chr(39))})::BIGINT AS weekdays, ({_month('o_orderdate')} - {1995 * 12 + 1})::BIGINT AS months FROM orders")
def calendar_distances(spark, d):
    day, start = F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.datediff(day, start).cast("long").alias("days"), business_days(start, day).alias("weekdays"), months(start, day).alias("months"))


def _macro_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every order as an observation of its own indicator, from five sources."""
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.to_date("o_orderdate").alias("date"), F.concat(F.lit("i"), key.cast("string")).alias("indicator"), F.concat(F.lit("r"), (key % 5).cast("string")).alias("source"), F.col("o_totalprice").alias("value"),
        F.lit("index").alias("unit"), F.lit("B").alias("frequency"), F.lit("snap").alias("snapshot_id"), F.lit("run").alias("run_id"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("ingested_at"),
    )


def _loaded(spark: SparkSession, d: str) -> Lake:
    """Everything, then two sources again with other values and a repeated key."""
    lake, rows, run = Lake(spark, shared_folder(spark)), _macro_rows(spark, d), Run.new("offline", {})
    lake.load_dataset("macro_data", rows, run)
    again = rows.where("source in ('r1', 'r3')")
    twice = again.withColumn("value", F.col("value") + 100).withColumn(ORDER, arrival(0)).unionByName(again.withColumn(ORDER, arrival(1)))
    for _ in range(2):
        lake.load_dataset("macro_data", twice, run)
    return lake


@query("""SELECT CAST(o_orderdate AS DATE) AS date, 'i' || CAST(o_orderkey AS VARCHAR) AS indicator, 'r' || CAST(o_orderkey % 5 AS VARCHAR) AS source,
  round(o_totalprice + CASE WHEN o_orderkey % 5 IN (1, 3) THEN 100 ELSE 0 END, 6) AS value FROM orders""", "date")
def idempotent_load(spark, d):
    return _loaded(spark, d).table("macro_data").select("date", "indicator", "source", r6("value").alias("value"))


@query("""WITH n AS (SELECT o_orderkey % 5 AS r, CAST(o_orderdate AS DATE) AS day FROM orders), two AS (SELECT * FROM n WHERE r IN (1, 3)),
  loads AS (SELECT 1 AS k, r, (SELECT min(day) FROM n) AS lo, (SELECT max(day) FROM n) AS hi FROM n UNION ALL SELECT k, r, (SELECT min(day) FROM two), (SELECT max(day) FROM two) FROM two, (VALUES (2), (3)) v(k))
  SELECT 'macro_data' AS dataset, 'r' || CAST(r AS VARCHAR) AS source, count(*) AS row_count, min(lo) AS date_min, max(hi) AS date_max FROM loads GROUP BY k, r""", "date_min", "date_max")
def load_metadata(spark, d):
    return _loaded(spark, d).table("dataset_metadata").select("dataset", "source", "row_count", "date_min", "date_max")


@query("""SELECT 'dataset_metadata' AS name, 13 - 4 AS n_rows UNION ALL SELECT 'macro_data', (SELECT count(*) FROM orders)::INT UNION ALL SELECT 'market_prices', 0 UNION ALL SELECT 'validation_results', 0""")
def table_counts(spark, d):
    """Tables of a lake and their rows; five sources are loaded, then two of them twice."""
    lake = _loaded(spark, d)
    return spark.createDataFrame([(name, lake.row_count(name)) for name in lake.tables()], "name string, n_rows int")


@query("SELECT 'macro_data' AS dataset")
def loaded_datasets(spark, d):
    """Datasets that were loaded at least once."""
    return spark.createDataFrame([(x,) for x in list_datasets(spark, warehouse=_loaded(spark, d).root)], "dataset string")


@query("""SELECT * FROM (VALUES ('macro_data', 'key', 'date,indicator,source', false), ('macro_data', 'provenance', 'snapshot_id,run_id,ingested_at', false), ('macro_data', 'value', 'unit,frequency', false), ('macro_data', 'value', 'value', true),
  ('market_prices', 'key', 'date,ticker,source', false), ('market_prices', 'provenance', 'snapshot_id,run_id,ingested_at', false), ('market_prices', 'value', 'open,high,low,close,currency', false), ('market_prices', 'value', 'adj_close,volume', true)) v(table_name, role, columns, nullable)""")
def contract_columns(spark, d):
    """What the contracts declare: columns by role, and whether they may be null."""
    rows = []
    for name, c in sorted(CONTRACTS.items()):
        for role in ("key", "provenance", "value"):
            for nullable in (False, True):
                some = [x for x in c.columns_by_role(role) if c.spec(x).nullable is nullable]
                rows += [(name, role, ",".join(some), nullable)] if some else []
    return spark.createDataFrame(rows, "table_name string, role string, columns string, nullable boolean")


@query("""SELECT source, count(*) AS n, round(max(value), 6) AS most FROM (SELECT 'r' || CAST(o_orderkey % 5 AS VARCHAR) AS source, o_totalprice + CASE WHEN o_orderkey % 5 IN (1, 3) THEN 100 ELSE 0 END AS value FROM orders)
  WHERE value > 100000 GROUP BY 1""")
def query_sql(spark, d):
    """Any SQL over the tables of a lake, with parameters."""
    return _loaded(spark, d).query("SELECT source, count(*) AS n, round(max(value), 6) AS most FROM macro_data WHERE value > ? GROUP BY source", [100000.0])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority || ', \"' || o_orderstatus || '\"' END AS label FROM orders")
def raw_roundtrip(spark, d):
    """A payload as a connector hands it over, row by row, through the raw zone."""
    quoted = F.concat(F.col("o_orderpriority"), F.lit(', "'), F.col("o_orderstatus"), F.lit('"'))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(quoted)).toLocalIterator()
    zone = RawZone(spark, shared_folder(spark))
    snapshot = zone.write("test", "macro_data", ["id", "label"], rows, Run.new("offline", {}), retrieved_at=utc_now())
    if zone.verify([snapshot]) or zone.files.sha256(snapshot.path) != snapshot.checksum_sha256:
        raise ValueError("the payload changed on its way")
    return zone.read(snapshot).drop(ORDER)


@query("""SELECT CAST(l_shipdate AS DATE) AS date, CASE l_partkey % 5 WHEN 0 THEN 'SPY' WHEN 1 THEN 'TLT' ELSE 'GLD' END AS ticker, 'yahoo' AS source, l_extendedprice AS open, 1000 + l_linenumber::DOUBLE AS high,
  CASE WHEN l_linenumber > 1 THEN l_discount END AS low, l_tax AS close, NULL::DOUBLE AS adj_close, l_quantity * 10 AS volume, 'USD' AS currency FROM lineitem WHERE l_partkey % 5 < 3""", "date")
def normalize_market(spark, d):
    """Text payloads of bars to the canonical table: padded and undeclared symbols, numbers as text, missing tokens."""
    text = lambda c: F.col(c).cast("string")
    symbol = F.element_at(F.array(*map(F.lit, (" SPY ", "TLT", "GLD\t", "spy", "NOPE"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    raw = table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), symbol.alias("ticker"), text("l_extendedprice").alias("open"), F.concat(F.lit(" 1,00"), text("l_linenumber")).alias("high"),
        F.when(F.col("l_linenumber") == 1, "NA").otherwise(text("l_discount")).alias("low"), text("l_tax").alias("close"), F.lit(".").alias("adj_close"), F.concat(text("l_quantity"), F.lit("e1")).alias("volume"),
    )
    done = normalize.market(raw, source="yahoo", snapshot_id="s", run_id="r", ingested_at=utc_now())
    return done.select("date", "ticker", "source", "open", "high", "low", "close", "adj_close", "volume", "currency")


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS date FROM orders)
  SELECT date, 'US_TREASURY_10Y' AS indicator, 'yahoo' AS source, round(o_totalprice * 0.1, 6) AS value, 'percent' AS unit, 'B' AS frequency FROM o WHERE o_custkey % 2 = 0
  UNION ALL SELECT date, CASE o_custkey % 4 WHEN 0 THEN 'US_TREASURY_10Y' WHEN 1 THEN 'US_TREASURY_2Y' ELSE 'US_CPI_LEVEL' END, 'fred', CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END,
    CASE o_custkey % 4 WHEN 2 THEN 'index' ELSE 'percent' END, CASE o_custkey % 4 WHEN 2 THEN 'M' ELSE 'B' END FROM o WHERE o_custkey % 4 < 3 AND o_orderkey % 7 <> 0
  UNION ALL SELECT date, i, 'akshare', CASE i WHEN 'CN_TREASURY_2Y' THEN o_totalprice ELSE o_orderkey::DOUBLE END, 'percent', 'B' FROM o, (VALUES ('CN_TREASURY_2Y'), ('US_TREASURY_10Y')) v(i)""", "date")
def normalize_macro(spark, d):
    """Three shapes of payload to one table: bars, long with missing values and unreadable dates, wide with labels."""
    orders = table(spark, d, "orders")
    day, price = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("string")
    series_id = F.element_at(F.array(*map(F.lit, ("DGS10", " DGS2", "CPIAUCSL", "NOPE"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    raw = {
        "yahoo": orders.select(day.alias("date"), F.when(F.col("o_custkey") % 2 == 0, "^TNX").otherwise("^X").alias("ticker"), price.alias("close")),
        "fred": orders.select(F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(day).alias("date"), series_id.alias("series_id"), F.when(F.col("o_orderkey") % 10 == 0, ".").otherwise(price).alias("value")),
        "akshare": orders.select(day.alias(CURVE_DATE), price.alias(CURVE_LABELS["CN2Y"]), F.col("o_orderkey").cast("string").alias(CURVE_LABELS["US10Y"]), F.lit("1").alias("another column")),
    }
    parts = [normalize.macro(df, source=s, snapshot_id="s", run_id="r", ingested_at=utc_now()).select("date", "indicator", "source", r6("value").alias("value"), "unit", "frequency") for s, df in raw.items()]
    return parts[0].union(parts[1]).union(parts[2])


UNIT_VALUES = "(VALUES (0, 'percent', 'percent', 1.0), (1, 'tenths_of_percent', 'percent', 0.1), (2, 'basis_points', 'percent', 0.01), (3, 'decimal_rate', 'percent', 100.0), (4, 'index', 'index', 1.0), (5, 'ratio', 'ratio', 1.0)) u(k, source_unit, unit, factor)"


@query(f"SELECT o_orderkey, source_unit, unit, round(o_totalprice * factor, 4) AS value FROM orders JOIN {UNIT_VALUES} ON o_orderkey % 6 = k")
def convert_units(spark, d):
    known = registries.units(spark)
    names = F.element_at(F.array(*map(F.lit, registries.conversions())), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "orders").withColumn("source_unit", names).join(F.broadcast(known), "source_unit")  # six rows
    return rows.select("o_orderkey", "source_unit", "unit", F.round(normalize.convert(F.col("o_totalprice"), F.col("factor"), F.lit(1.0)), 4).alias("value"))


@query("SELECT 'US_TREASURY_10Y' AS entity, 3::BIGINT AS n_sources, 'akshare,fred,yahoo' AS sources")
def registry_overlap(spark, d):
    return registries.observed_by_several(spark)


DAILY = "(SELECT CAST(o_orderdate AS DATE) AS date, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)"
RUN_AT = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def _zone(spark: SparkSession, d: str) -> RawZone:
    """Snapshots of daily extremes (one row a day): two deliveries of one source, one of another."""
    daily = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).orderBy("day")
    rows, run, zone = [(r.day, r.lo, r.hi) for r in daily.toLocalIterator()], Run.new("offline", {}), RawZone(spark, shared_folder(spark))
    zone.write("fred", "macro_data", ["date", "series_id", "value"], ((day, "DGS10", hi) for day, _, hi in rows), run, retrieved_at=RUN_AT)
    zone.write("fred", "macro_data", ["date", "series_id", "value"], ((day, "DGS10" if i else "DGS2", lo) for i, (day, lo, _) in enumerate(rows)), run, retrieved_at=RUN_AT + dt.timedelta(days=1))
    zone.write("yahoo", "macro_data", ["date", "ticker", "close"], ((day, "^TNX", hi) for day, _, hi in rows), run, retrieved_at=RUN_AT)
    return zone


def _run(spark: SparkSession, d: str) -> Lake:
    zone = _zone(spark, d)
    done = run_pipeline(spark, settings=Settings(data_dir=shared_folder(spark), sample_dir=zone.root))
    if done.quarantined:
        raise ValueError(f"quarantined: {done.quarantined}")
    return Lake(spark, done.warehouse)


@query(f"""SELECT date, CASE WHEN date = (SELECT min(date) FROM {DAILY}) THEN 'US_TREASURY_2Y' ELSE 'US_TREASURY_10Y' END AS indicator, 'fred' AS source, lo AS value, 'percent' AS unit FROM {DAILY}
  UNION ALL SELECT date, 'US_TREASURY_10Y', 'fred', hi, 'percent' FROM {DAILY} WHERE date = (SELECT min(date) FROM {DAILY}) UNION ALL SELECT date, 'US_TREASURY_10Y', 'yahoo', round(hi * 0.1, 6), 'percent' FROM {DAILY}""", "date")
def run_offline(spark, d):
    """A whole run over a raw zone; where two deliveries of a source have one key, the later one counts."""
    return _run(spark, d).table("macro_data").select("date", "indicator", "source", F.when(F.col("source") == "yahoo", r6("value")).otherwise(F.col("value")).alias("value"), "unit")


@query("""SELECT * FROM (VALUES ('raw', 'fred', 'payload_not_empty', 2), ('raw', 'fred', 'duplicate_columns', 2), ('raw', 'fred', 'raw_required_columns', 2), ('raw', 'fred', 'raw_unexpected_columns', 2), ('raw', 'fred', 'min_rows', 2),
  ('raw', 'yahoo', 'payload_not_empty', 1), ('raw', 'yahoo', 'duplicate_columns', 1), ('raw', 'yahoo', 'raw_required_columns', 1), ('raw', 'yahoo', 'raw_unexpected_columns', 1), ('raw', 'yahoo', 'min_rows', 1),
  ('normalized', 'fred', 'canonical_columns', 2), ('normalized', 'fred', 'dtypes', 2), ('normalized', 'fred', 'primary_key_unique', 2), ('normalized', 'fred', 'timestamp_timezone', 2),
  ('normalized', 'yahoo', 'canonical_columns', 1), ('normalized', 'yahoo', 'dtypes', 1), ('normalized', 'yahoo', 'primary_key_unique', 1), ('normalized', 'yahoo', 'timestamp_timezone', 1)) v(stage, source, check_name, n)""")
def run_log(spark, d):
    """Checks of a run that hold whatever the values are, from the stored log."""
    always = ["payload_not_empty", "duplicate_columns", "raw_required_columns", "raw_unexpected_columns", "min_rows", "canonical_columns", "dtypes", "primary_key_unique", "timestamp_timezone"]
    log = validation_report(spark, warehouse=_run(spark, d).root)
    return log.where(F.col("check_name").isin(*always) & F.col("passed")).groupBy("stage", "source", "check_name").agg(F.count("*").cast("int").alias("n"))


@query(f"""SELECT 'fred' AS source, date, CASE WHEN date = (SELECT min(date) FROM {DAILY}) THEN hi ELSE lo END AS value, 'percent' AS unit FROM {DAILY} UNION ALL SELECT 'yahoo', date, round(hi * 0.1, 6), 'percent' FROM {DAILY}""", "date")
def us10y_cross_source(spark, d):
    found = named_query(spark, "us10y_cross_source", warehouse=_run(spark, d).root)
    return found.withColumn("value", F.when(F.col("source") == "yahoo", r6("value")).otherwise(F.col("value")))


@query(f"SELECT date, CASE WHEN date = (SELECT min(date) FROM {DAILY}) THEN 'US_TREASURY_2Y' ELSE 'US_TREASURY_10Y' END AS indicator, 'fred' AS source, lo AS value FROM {DAILY} UNION ALL SELECT date, 'US_TREASURY_10Y', 'yahoo', round(hi * 0.1, 6) FROM {DAILY}", "date")
def normalize_latest(spark, d):
    """The canonical table of the latest snapshot of every source."""
    done = normalize.normalize_latest(_zone(spark, d), "r")["macro_data"]
    return done.select("date", "indicator", "source", F.when(F.col("source") == "yahoo", r6("value")).otherwise(F.col("value")).alias("value"))


@query(f"SELECT CAST(date AS VARCHAR) AS date, 'DGS10' AS series_id, lo AS value FROM {DAILY} WHERE date > (SELECT min(date) FROM {DAILY})")
def replay_filtered(spark, d):
    """A connector that replays the latest snapshot, one symbol of it."""
    found = connector_for("fred", "macro_data", "offline", zone=_zone(spark, d)).read(spark, FetchRequest("macro_data", ("DGS10",)))
    return found.withColumn("value", F.col("value").cast("double"))


@query(f"""SELECT source, dataset, n::BIGINT AS row_count, latest, true AS intact FROM (VALUES ('fred', 'macro_data', false), ('fred', 'macro_data', true), ('yahoo', 'macro_data', true)) v(source, dataset, latest), (SELECT count(*) AS n FROM {DAILY})""")
def snapshot_list(spark, d):
    """Manifests of a raw zone: which snapshot is the latest of its source, and whether payloads are what was written."""
    zone = _zone(spark, d)
    found = zone.list_snapshots()
    changed = {s.snapshot_id for s in zone.verify(found)}
    rows = [(s.source, s.dataset, s.row_count, zone.latest(s.source, s.dataset) == s, s.snapshot_id not in changed) for s in found]
    return spark.createDataFrame(rows, "source string, dataset string, row_count long, latest boolean, intact boolean")


@query("""SELECT * FROM (VALUES ('akshare', 'macro_data', false, 'CN2Y,CN5Y,CN10Y,CN30Y,US10Y'), ('fred', 'macro_data', true, 'DGS10,DGS2,CPIAUCSL,VIXCLS'), ('yahoo', 'macro_data', false, '^TNX'), ('yahoo', 'market_prices', false, 'SPY,TLT,GLD')) v(source, dataset, requires_api_key, symbols)""")
def connector_plan(spark, d):
    """Connectors with what the ingestion plan asks of them."""
    plan = spark.createDataFrame([(p.source, p.dataset, ",".join(p.symbols)) for p in plan_for()], "source string, dataset string, symbols string")
    return list_connectors(spark).join(plan, ["source", "dataset"]).select("source", "dataset", "requires_api_key", "symbols")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 40")
def quarantine_rows(spark, d):
    """Rejected rows, kept for inspection and read back."""
    bad = table(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = Lake(spark, shared_folder(spark)).quarantine("lineitem", "test", Run.new("offline", {}), bad)
    return spark.read.schema(bad.schema).option("header", True).csv(path)


GROUPS = "(SELECT o_orderpriority AS dataset, o_orderstatus AS source, count(*) AS n FROM orders GROUP BY 1, 2)"


@query(f"""SELECT dataset, source, 'payload_not_empty' AS check_name, true AS passed, 'INFO' AS severity, 0::BIGINT AS n_offending FROM {GROUPS}
  UNION ALL SELECT dataset, source, 'min_rows', n >= 1000, CASE WHEN n >= 1000 THEN 'INFO' ELSE 'WARNING' END, CASE WHEN n >= 1000 THEN 0 ELSE n END FROM {GROUPS}""")
def validation_log(spark, d):
    """Findings appended to the check log, read back as a report."""
    lake = Lake(spark, shared_folder(spark))
    groups = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").count().collect()  # priorities and statuses
    lake.persist_validation([Checked.now(Subject("run", r[0], r[1], "raw"), r[2], [checks.payload_not_empty(r[2]), checks.min_rows(r[2], 1000)]) for r in groups])
    return validation_report(spark, "run", warehouse=lake.root).select("dataset", "source", "check_name", "passed", "severity", "n_offending")


@query("""SELECT * FROM (VALUES ('whole', 'duplicate_columns', 'INFO', 0), ('whole', 'min_rows', 'INFO', 0), ('whole', 'payload_not_empty', 'INFO', 0), ('whole', 'raw_optional_columns', 'WARNING', 1), ('whole', 'raw_required_columns', 'INFO', 0),
  ('whole', 'raw_unexpected_columns', 'WARNING', 1), ('empty', 'duplicate_columns', 'ERROR', 1), ('empty', 'min_rows', 'WARNING', 0), ('empty', 'payload_not_empty', 'ERROR', 0), ('empty', 'raw_optional_columns', 'WARNING', 1),
  ('empty', 'raw_required_columns', 'ERROR', 6), ('empty', 'raw_unexpected_columns', 'INFO', 0), ('other', 'duplicate_columns', 'INFO', 0), ('other', 'min_rows', 'INFO', 0), ('other', 'payload_not_empty', 'INFO', 0), ('other', 'raw_schema_registered', 'WARNING', 0))
  v(payload, check_name, severity, n)""")
def raw_drift(spark, d):
    """Raw checks on a payload with a new column and without an optional one, on an empty one with a label twice, and on one without a contract."""
    own = table(spark, d, "lineitem").selectExpr("l_shipdate AS date", "l_partkey AS ticker", "l_extendedprice AS open", "l_extendedprice AS high", "l_extendedprice AS low", "l_extendedprice AS close", "l_quantity AS volume", "l_tax AS tax")
    found = {
        "whole": checks.validate_raw(own, source="yahoo", dataset="market_prices", run_id="r"),
        "empty": checks.validate_raw(own.select("date").where("false"), source="yahoo", dataset="market_prices", run_id="r", header=["date", "date"], contract=get_raw_contract("yahoo", "market_prices")),
        "other": checks.validate_raw(own, source="nobody", dataset="market_prices", run_id="r"),
    }
    return spark.createDataFrame([(name, f.check, SPELLED[f.level], f.n) for name, c in found.items() for f in c.found], "payload string, check_name string, severity string, n int")


def _described(name: str) -> str:
    return f"""SELECT '{name}' AS table_name, column_name, CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'float' WHEN column_type = 'VARCHAR' THEN 'string'
      WHEN column_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'other' END AS family, CASE WHEN column_type LIKE 'TIMESTAMP%' THEN true END AS without_zone FROM (DESCRIBE {name})"""


TABLES = ("orders", "lineitem", "events", "embeddings", "documents")


@query(" UNION ALL ".join(map(_described, TABLES)))
def dtype_report(spark, d):
    """The type family of every column, and of dates whether they are free of a time zone."""
    rows = []
    for name in TABLES:
        schema = table(spark, d, name).schema
        for f in schema:
            family = type_family(f.dataType)
            rows.append((name, f.name, family, checks.timestamp_timezone(schema, f.name).level == HOLDS if family.startswith("datetime") else None))
    return spark.createDataFrame(rows, "table_name string, column_name string, family string, without_zone boolean")


PER_USER = "(SELECT 'u' || CAST(user_id AS VARCHAR) AS indicator, CAST(ts AS DATE) AS date, CASE WHEN event_type IN ('click', 'view') THEN 'a' WHEN event_type = 'purchase' THEN 'b' ELSE 'c' END AS source, max(value) AS value FROM events GROUP BY 1, 2, 3)"


@query(f"""WITH o AS {PER_USER}, n AS (SELECT DISTINCT indicator, source FROM o), q AS (SELECT x.indicator, x.source AS "left", y.source AS "right" FROM n x JOIN n y ON x.indicator = y.indicator AND x.source < y.source),
  p AS (SELECT x.indicator, x.source AS "left", y.source AS "right", abs(x.value - y.value) * 100 AS d FROM o x JOIN o y ON x.indicator = y.indicator AND x.date = y.date AND x.source < y.source),
  s AS (SELECT indicator, "left", "right", count(*) AS n, quantile_cont(d, 0.5) AS median, avg((d > 800)::INT) AS share FROM p GROUP BY 1, 2, 3)
  SELECT q.indicator, q."left", q."right", coalesce(s.n, 0) AS overlap, CASE WHEN coalesce(s.n, 0) < 20 THEN 0 WHEN s.median > 800 * 20.0 THEN 2 WHEN s.median > 800 OR s.share > 0.1 THEN 1 ELSE 0 END AS level
  FROM q LEFT JOIN s ON q.indicator = s.indicator AND q."left" = s."left" AND q."right" = s."right" """)
def cross_source_verdict(spark, d):
    """The judgement on every pair of sources of every indicator."""
    e = table(spark, d, "events")
    source = F.when(F.col("event_type").isin("click", "view"), "a").when(F.col("event_type") == "purchase", "b").otherwise("c")
    seen = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("indicator"), F.to_date("ts").alias("date"), source.alias("source")).agg(F.max("value").alias("value"))
    return checks.cross_source_verdicts(seen.withColumn("unit", F.lit("percent")), 800.0).select("indicator", "left", "right", "overlap", "level")


@query(f"SELECT event_type AS ticker, 's' || CAST(day(date) % 2 AS VARCHAR) AS source, date, row_number() OVER (ORDER BY date, day(date) % 2, event_type) AS place FROM ({BARS}) QUALIFY place <= 40", "date")
def first_in_order(spark, d):
    """The first forty rows of a selection, in its order."""
    rows = _bars(spark, d).select(F.col("event_type").alias("ticker"), F.concat(F.lit("s"), (F.dayofmonth("date") % 2).cast("string")).alias("source"), "date")
    first = select_rows(rows, "ticker").limit(40).collect()  # forty rows
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(first)], "ticker string, source string, date date, place long")
