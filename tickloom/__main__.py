"""Command line: ``python -m tickloom list | run | result | report | check``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import config
from .operators.runtime import parse_strategies
from .plans import catalogue
from .sources import results, views


def session(master: str | None) -> SparkSession:
    b = SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC")
    return (b.master(master) if master else b).getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickloom", description="Queries over quotes, trades and decisions.")
    p.add_argument("--master", help="where Spark runs; its own settings if left out")
    p.add_argument("--config", help="a TOML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query")
    run.add_argument("query")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="write to this path; else twenty rows are shown")
    run.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    run.add_argument("--strategies", help="only rows of these strategies, such as A,C")
    for name, what in (("result", "write a run's result"), ("report", "write a session's report")):
        r = sub.add_parser(name, help=what)
        r.add_argument("--data", required=True)
        r.add_argument("--out", required=True)
    check = sub.add_parser("check", help="validate a result: its returns against the ordered checks")
    check.add_argument("path")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = config.read(args.config) if args.config else config.Config()
    if args.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    if args.command == "run" and args.query not in catalogue.queries():
        print(f"no query {args.query!r}; see: tickloom list", file=sys.stderr)
        return 2
    spark = session(args.master)
    if args.command == "run":
        df = catalogue.queries()[args.query](spark, args.data)
        only = parse_strategies(args.strategies) if args.strategies else list(settings.strategies)
        if "strategy" in df.columns and len(only) < 3:
            df = df.where(views.F.col("strategy").isin(only))
        if args.out:
            df.write.mode("error").format(args.format).save(args.out)
        else:
            df.show(20, truncate=False)
    elif args.command == "result":
        results.write_run(spark, args.data, args.out)
    elif args.command == "report":
        results.write_report(spark, args.data, args.out)
    else:
        from .operators.validation import verdict

        checks = verdict(results.read_returns(spark, args.path), results.read_num_features(spark, args.path)).collect()
        for r in checks:
            print(f"{'pass' if r['passed'] else 'FAIL'}  {r['name']}: {r['value']:.6f}")
        return 0 if all(r["passed"] for r in checks) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
