"""Command line: ``python -m vectrove --data-dir ./data COMMAND``."""

from __future__ import annotations

import argparse
import json

from vectrove.db import Database
from vectrove.sources.schema import CompactionConfig


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vectrove")
    parser.add_argument("--data-dir", default="./data")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="collections as JSON")
    commands.add_parser("sql", help="run a query and print its rows as JSON lines").add_argument("query")
    commands.add_parser("flush").add_argument("collection")
    commands.add_parser("compact").add_argument("collection")
    maintain = commands.add_parser("maintain", help="check all collections for compaction, again and again")
    maintain.add_argument("--interval", type=float, default=60)
    serve = commands.add_parser("serve", help="answer queries over Arrow Flight and compact in the background")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=50052)
    serve.add_argument("--interval", type=float, default=60)
    args = parser.parse_args(argv)
    database = Database(args.data_dir)
    if args.command == "list":
        print(json.dumps(database.list_collections()))
    elif args.command == "sql":
        for row in database.sql(args.query).to_pylist():
            print(json.dumps(row, default=str))
    elif args.command == "flush":
        database.flush(args.collection)
    elif args.command == "compact":
        print(json.dumps(database.compact(args.collection)))
    elif args.command == "serve":
        from vectrove.server import FlightServer

        compactor = database.start_compactor(CompactionConfig(check_interval_secs=args.interval))
        try:
            FlightServer(database, args.host, args.port).serve()
        finally:
            compactor.stop()
    else:
        database.start_compactor(CompactionConfig(check_interval_secs=args.interval))._thread.join()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
