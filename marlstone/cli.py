"""Command line: run, sources, load, query, report, datasets, metadata."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession

from . import api
from .contracts import CONTRACTS
from .plans.ingest import run_pipeline
from .session import local_session
from .settings import VERSION, get_settings
from .sources.connectors import list_connectors
from .sources.rawzone import Files


def show(df: DataFrame, rows: int) -> int:
    df.show(rows, truncate=False)
    return 0


def cmd_run(spark: SparkSession, a: argparse.Namespace) -> int:
    day = lambda x: dt.date.fromisoformat(x) if x else None
    result = run_pipeline(spark, mode=a.mode, sources=tuple(a.sources) if a.sources else None, start=day(a.start), end=day(a.end))
    print(result.summary())
    for dataset, source in result.quarantined:
        print(f"quarantined: {dataset}/{source}")
    return 0


def cmd_report(spark: SparkSession, a: argparse.Namespace) -> int:
    if not Files(spark, get_settings().warehouse_dir).exists(get_settings().warehouse_dir):
        print("there is no warehouse yet: start with the command run")
        return 1
    run = None if a.all else a.run or api.last_run(spark)
    return show(api.validation_report(spark, run).select("run_id", "dataset", "source", "stage", "check_name", "passed", "severity", "message"), a.rows)


def cmd_datasets(spark: SparkSession, a: argparse.Namespace) -> int:
    print("\n".join(api.list_datasets(spark)) or "nothing is loaded")
    return 0


def cmd_query(spark: SparkSession, a: argparse.Namespace) -> int:
    name = a.sql.strip().lower()
    return show(api.named_query(spark, name) if name in api.NAMED else api.query(spark, a.sql), a.rows)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description="research data on Spark")
    p.add_argument("--version", action="version", version=f"marlstone {VERSION}")
    p.add_argument("--rows", type=int, default=50, help="rows to print")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="ingest, check and load")
    run.add_argument("--mode", choices=["offline", "live"], default="offline")
    run.add_argument("--sources", nargs="+", choices=["yahoo", "fred", "akshare"])
    run.add_argument("--start", help="YYYY-MM-DD")
    run.add_argument("--end", help="YYYY-MM-DD")
    run.set_defaults(func=cmd_run)
    sub.add_parser("sources", help="connectors and whether they can fetch").set_defaults(func=lambda s, a: show(list_connectors(s), a.rows))
    load = sub.add_parser("load", help="a canonical table, filtered")
    load.add_argument("dataset", choices=sorted(CONTRACTS))
    for name in ("indicators", "tickers", "sources"):
        load.add_argument(f"--{name}", nargs="+")
    load.add_argument("--start")
    load.add_argument("--end")
    load.set_defaults(func=lambda s, a: show(api.load_dataset(s, a.dataset, indicators=a.indicators, tickers=a.tickers, sources=a.sources, start=a.start, end=a.end), a.rows))
    query = sub.add_parser("query", help="SQL, or a named query: " + ", ".join(api.NAMED))
    query.add_argument("sql")
    query.set_defaults(func=cmd_query)
    report = sub.add_parser("report", help="checks of the last run")
    report.add_argument("--run", help="of this run")
    report.add_argument("--all", action="store_true", help="of all runs")
    report.set_defaults(func=cmd_report)
    sub.add_parser("datasets", help="what is loaded").set_defaults(func=cmd_datasets)
    sub.add_parser("metadata", help="the load log").set_defaults(func=lambda s, a: show(api.dataset_metadata(s), a.rows))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.func(spark or local_session(), args)


if __name__ == "__main__":
    sys.exit(main())
