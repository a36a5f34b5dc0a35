"""Command line: ``spark-submit -m runledger`` or ``python -m runledger``.

    bootstrap    check and copy the sources, build the merged table
    refresh      copy the sources, upsert all that changed
    stream       bootstrap when needed, then refresh on every landed version
    projects     print the names of the projects, newest first
    overview     print the projects with their counts, newest first
    report       print the tables of one project, or write them below --out
    export       write one project as CSV, or all without --project
    vacuum       delete data that no recent state of the ledger shows

A source is given as ``name=format:location``, such as ``ms1=sqlite:/shared/ms1.sqlite``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame

from runledger import Ledger, LedgerConfig, Metric, build_session
from runledger.sources.databases import SourceDatabase
from runledger.streaming.ingest import start_refresh_stream


def source(text: str) -> SourceDatabase:
    name, eq, rest = text.partition("=")
    fmt, colon, location = rest.partition(":")
    if not (name and eq and fmt and colon and location):
        raise argparse.ArgumentTypeError(f"expected name=format:location, got {text!r}")
    return SourceDatabase(name, location, fmt)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runledger", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["bootstrap", "refresh", "stream", "projects", "overview", "report", "export", "vacuum"])
    p.add_argument("--root", required=True, help="folder of the ledger, shared by all executors")
    p.add_argument("--report", type=source, action="append", required=True, help="a report source; may be repeated")
    p.add_argument("--metadata", type=source, required=True)
    p.add_argument("--recent", type=int, default=None, help="newest samples per source that a refresh looks at beside all that changed")
    p.add_argument("--config", help="JSON file with settings: fields of LedgerConfig, metrics as objects")
    p.add_argument("--project", help="for report and export")
    p.add_argument("--metrics", help="comma list of metric keys, for report")
    p.add_argument("--out", help="folder for export and report")
    p.add_argument("--landing", help="landing folder, for stream")
    p.add_argument("--checkpoint", help="checkpoint folder of the stream")
    p.add_argument("--once", action="store_true", help="stream what has landed, then stop")
    p.add_argument("--master", help="Spark master, when not given by spark-submit")
    return p


def load_config(path: str | None) -> LedgerConfig:
    """The settings, with those of a JSON file in place of the defaults."""
    if path is None:
        return LedgerConfig()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if "metrics" in given:
        given["metrics"] = tuple(Metric(**m) for m in given["metrics"])
    return LedgerConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def print_all(table: DataFrame) -> None:
    """Every row, a partition at a time, as tab-separated text."""
    print("\t".join(table.columns))
    for row in table.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> None:
    p = parser()
    args = p.parse_args(argv)
    needs = {"report": ["project"], "export": ["out"], "stream": ["landing", "checkpoint"]}
    for name in needs.get(args.command, []):
        if not getattr(args, name):
            p.error(f"{args.command} needs --{name}")
    spark = build_session(master=args.master)
    ledger = Ledger(spark, args.root, args.report, args.metadata, load_config(args.config))
    if args.command == "bootstrap":
        print(ledger.bootstrap())
    elif args.command == "refresh":
        ledger.validate()
        if not ledger.sync():
            raise SystemExit("not all sources could be copied")
        print(ledger.refresh(args.recent))
    elif args.command == "stream":
        if not ledger.table.exists():
            ledger.bootstrap()
        start_refresh_stream(ledger, args.landing, args.checkpoint, args.once).awaitTermination()
    elif args.command == "projects":
        print_all(ledger.projects())
    elif args.command == "overview":
        print_all(ledger.overview().orderBy("newest", ascending=False))
        print_all(ledger.freshness())
    elif args.command == "report":
        keys = args.metrics.split(",") if args.metrics else None
        for title, table in ledger.report(args.project, keys).items():
            print(title)
            if args.out:
                table.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{title}")
            else:
                print_all(table)
    elif args.command == "export":
        done = ledger.export_csv(args.project, args.out) if args.project else ledger.export_all_csv(args.out)
        print(done or f"no rows for {args.project}")
    elif args.command == "vacuum":
        print(f"{ledger.vacuum()} folders deleted")


if __name__ == "__main__":
    main()
