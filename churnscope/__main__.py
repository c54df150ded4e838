"""Command line: list the queries, or run one.

  python -m churnscope list
  python -m churnscope run <query> --data /path/to/tables [--out result.parquet]
  python -m churnscope run <query> --raw-csv accounts.csv [--out result.csv]

``--data`` derives the accounts from the order tables of a folder;
``--raw-csv`` reads a raw account export (21 columns with a header) instead.
Without ``--out`` the first rows are printed.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="churnscope")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered queries")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("query")
    src = run.add_mutually_exclusive_group(required=True)
    src.add_argument("--data", help="folder with the order tables (Parquet)")
    src.add_argument("--raw-csv", help="raw account export (CSV with header)")
    run.add_argument("--out", help="write the result (.csv or Parquet folder)")
    run.add_argument("--rows", type=int, default=20, help="rows to print without --out")
    run.add_argument("--master", default=None, help="e.g. local[8]; default: from spark-submit, else local[*]")
    args = parser.parse_args(argv)

    from churnscope.plans.registry import specs

    if args.cmd == "list":
        for name, spec in sorted(specs().items()):
            print(f"{name:32s} {' '.join(spec.ids)}")
        return 0

    from churnscope.plans.frames import Frames, register_accounts_table
    from churnscope.session import build_session

    spec = specs().get(args.query)
    if spec is None:
        print(f"unknown query {args.query}; see 'list'", file=sys.stderr)
        return 2
    import os

    master = args.master or (None if os.environ.get("SPARK_ENV_LOADED") else "local[*]")
    spark = build_session(master=master)
    key = args.data or f"csv:{args.raw_csv}"
    if args.raw_csv:
        register_accounts_table(spark, key, args.raw_csv)
    df = spec.build(Frames(spark, key))
    if args.out:
        writer = df.write.mode("overwrite")
        if args.out.lower().endswith(".csv"):
            writer.option("header", "true").csv(args.out)
        else:
            writer.parquet(args.out)
        print(f"wrote {args.out}")
    else:
        df.show(args.rows, truncate=False)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
