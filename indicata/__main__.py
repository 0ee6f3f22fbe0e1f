"""Command line: list, run and explain the registered indicator queries.

    python -m indicata list
    python -m indicata run poverty_runs --sf-dir DIR --out PATH [--format csv] [--partition-by cut]
    python -m indicata explain survey_breakdown --sf-dir DIR

``run`` writes through the indicator sink (B1); on a cluster submit it with
spark-submit and point ``--out`` at shared storage.
"""

from __future__ import annotations

import argparse
import sys

from indicata.plans import catalog
from indicata.session import get_session


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="indicata")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--sf-dir", required=True)
        p.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
        if name == "run":
            p.add_argument("--out", required=True)
            p.add_argument("--format", default="parquet", choices=["parquet", "csv"])
            p.add_argument("--partition-by", nargs="*", default=[])
    args = ap.parse_args(argv)
    queries = catalog.queries()
    if args.cmd == "list":
        for name, fn in queries.items():
            doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
            print(f"{name:24s} {doc}")
        return 0
    if args.query not in queries:
        print(f"unknown query {args.query!r}; see `python -m indicata list`", file=sys.stderr)
        return 2
    spark = get_session(args.master)
    df = queries[args.query](spark, args.sf_dir)
    if args.cmd == "explain":
        df.explain("formatted")
    else:
        from indicata.sources import write_indicator
        write_indicator(df, args.out, args.format, args.partition_by)
    return 0


if __name__ == "__main__":
    sys.exit(main())
