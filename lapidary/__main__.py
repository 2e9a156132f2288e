"""Command line: scan, recommend and clean a file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .api import Cleaner


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lapidary", description="Refine a table.")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "recommend", "clean"):
        p = sub.add_parser(name)
        p.add_argument("file")
    p.add_argument("--partitions", type=int, default=4)
    p.add_argument("--backend", default="auto")
    p.add_argument("--export", default="parquet")
    p.add_argument("--output", default=".")
    p.add_argument("--report", default=None)
    p.add_argument("--quiet", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lapidary").getOrCreate()
    try:
        if args.command == "scan":
            for k, v in Cleaner(spark, args.file).scan().scan_report.items():
                print(f"{k}: {v}")
        elif args.command == "recommend":
            for r in Cleaner(spark, args.file).auto_clean().recommend_visualizations().recommendations:
                print(f"{r['priority']}: {r['chart']} - {r['title']}")
        else:
            c = Cleaner(spark, args.file, args.partitions, args.backend, args.export, verbose=not args.quiet)
            c.scan().auto_clean().optimize_memory().export(folder=args.output)
            if args.report:
                c.generate_report(args.report, args.report.rpartition(".")[2])
            print(c.summary())
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
