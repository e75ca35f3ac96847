"""Command line: ``python -m alertmill queries | run NAME TABLES OUT | gates TABLES [GATE ...]``.

run writes a query's result as parquet; gates prints every gate's result and ends with 1 if one fails.
"""

from __future__ import annotations

import argparse
import sys

from .plans import evaluation, training
from .session import build_session, temporary_tables


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="alertmill")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the queries")
    run = sub.add_parser("run", help="write a query's result")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("out")
    gate = sub.add_parser("gates", help="run acceptance gates")
    gate.add_argument("tables")
    gate.add_argument("gate", nargs="*")
    args = parser.parse_args(argv)
    known = evaluation.QUERIES | training.QUERIES
    if args.command == "queries":
        print("\n".join(sorted(known)))
        return 0
    if args.command == "run" and args.name not in known:
        parser.error(f"no query {args.name!r}")
    spark = build_session()
    with temporary_tables(spark):
        if args.command == "run":
            known[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
            return 0
        results = evaluation.run_gates_on(spark, args.tables, args.gate or None).collect()  # one row a gate
    for r in results:
        print(f"{'PASS' if r['passed'] else 'FAIL'}  {r['gate']}  {r['detail']}")
    return 0 if all(r["passed"] for r in results) else 1


if __name__ == "__main__":
    sys.exit(main())
