"""Command line: list the registered queries, run one, or describe a folder of files."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from nearfield.functions import signal
from nearfield.io import session
from nearfield.sources import ingest


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="nearfield", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries and what they cover")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    scan = commands.add_parser("scan", help="list files below a folder, by kind")
    describe = commands.add_parser("describe", help="read and describe the files below a folder")
    for p in (scan, describe):
        p.add_argument("folder")
        p.add_argument("--out")
    args = parser.parse_args(argv)
    from nearfield.plans import catalogue

    if args.command == "list":
        for name in sorted(catalogue.QUERIES):
            print(f"{name}: {catalogue.COVERS[name]}")
        return 0
    spark = session()
    if args.command == "run":
        out = catalogue.QUERIES[args.query](spark, args.folder)
    elif args.command == "scan":
        out = ingest.kinds_of(ingest.listing(spark, args.folder))
    else:
        out = signal.described_files(ingest.contents(ingest.listing(spark, args.folder).where(F.col("ext").isin(ingest.AUDIO))))
    if args.out:
        out.write.mode("overwrite").parquet(args.out)
    else:
        out.show(50, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
