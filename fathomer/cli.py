"""Command line: ``python -m fathomer.cli index|search|skeleton|traverse|blast|backfill|watch|serve|version``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from fathomer.plans.store import Store
from fathomer.plans.tools import Tools, as_json
from fathomer.sources.embedders import detect

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fathomer")
    top.add_argument("--store", default=".fathomer", help="folder of the index")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("index", "watch"):
        p = sub.add_parser(name)
        p.add_argument("--path", default=".")
        p.add_argument("--force", action="store_true", help="index files that have not changed, too")
    index = sub.choices["index"]
    index.add_argument("--no-hidden", dest="hidden", action="store_false", help="pass over names that begin with a dot or an underscore")
    index.add_argument("--reconcile", action="store_true", help="delete files that are gone")
    sub.add_parser("serve", help="answer tool calls on standard input and output")
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("--mode", default="hybrid", choices=("keyword", "semantic", "hybrid"))
    p.add_argument("--limit", type=int, default=10)
    for name, what in (("skeleton", "path"), ("blast", "symbol")):
        sub.add_parser(name).add_argument(what)
    p = sub.add_parser("traverse")
    p.add_argument("query")
    p.add_argument("--depth", type=int, default=3)
    sub.add_parser("backfill")
    sub.add_parser("version")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "version":
        print(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("fathomer").getOrCreate()
    tools = Tools(spark, Store(spark, args.store), detect())
    if args.command == "index":
        s = tools.index(args.path, force=args.force, hidden=args.hidden, remove_gone=args.reconcile)
        print(f"indexed {s.files_indexed} files, skipped {s.files_skipped}, {s.symbols} symbols, {s.duration:.1f} s")
    elif args.command == "watch":
        from fathomer.streaming.watch import watch

        watch(spark, args.path, tools.store, embedder=tools.embedder, force=args.force).awaitTermination()
    elif args.command == "serve":
        from fathomer.server import Server

        Server(tools).run(sys.stdin, sys.stdout)
    elif args.command == "search":
        print(as_json(tools.search(args.query, args.mode, args.limit), "rank"))
    elif args.command == "skeleton":
        print(as_json(tools.file_skeleton(args.path), "start_line", "id"))
    elif args.command == "traverse":
        print(as_json(tools.feature_traverse(args.query, args.depth), "hop", "id"))
    elif args.command == "blast":
        print(tools.blast_radius_json(args.symbol))
    elif args.command == "backfill":
        print(f"embedded {tools.backfill()} symbols")
    return 0


if __name__ == "__main__":
    sys.exit(main())
