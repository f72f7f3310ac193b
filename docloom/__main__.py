"""The command line: ``python -m docloom COMMAND CONFIG ...``, each CONFIG a TOML file (see ``docloom.plans.project``)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from docloom.plans import admin
from docloom.plans.config import ConfigError
from docloom.plans.project import Project
from docloom.streaming import apply

EXAMPLE = """[source]
tables = "file:///data"
changes = "file:///log"
[store]
root = "file:///views"
[[sync.tables]]
table = "customer"
index = "customers"
key = ["c_custkey"]
"""


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="docloom")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, help: commands.add_parser(name, help=help)
    add("example", "print a configuration to begin with")
    for name, help in (("validate", "check configurations"), ("run", "load what is new and follow the change logs"), ("poll", "take in what is new in polled tables"), ("load", "load all tables"), ("status", "how far a stream has come"), ("metrics", "what a stream has taken in"), ("reconcile", "find documents without a row"), ("reload", "load rows of a table again"), ("reindex", "build a table's index anew under its alias"), ("alias", "name an index"), ("rejects", "list or retry documents put aside")):
        add(name, help).add_argument("config", nargs="+" if name in ("validate", "run") else None)
    of = commands.choices
    of["run"].add_argument("--every", help="keep running, with a batch this often, such as '1 second'")
    of["poll"].add_argument("--every", type=float, help="go on, looking again after so many seconds")
    of["metrics"].add_argument("--stream", help="if not the configuration's own, such as poll-public.customer")
    of["status"].add_argument("--position", type=int, default=0)
    of["reconcile"].add_argument("--delete", action="store_true")
    for name in ("reload", "reindex"):
        of[name].add_argument("--table", required=True)
    of["reload"].add_argument("--where")
    of["reload"].add_argument("--version", type=int)
    of["reindex"].add_argument("--alias", required=True)
    of["reindex"].add_argument("--drop-old", action="store_true")
    of["alias"].add_argument("--alias", required=True)
    of["alias"].add_argument("--index", required=True)
    of["rejects"].add_argument("--retry", action="store_true")
    of["rejects"].add_argument("--limit", type=int, default=20)
    return parser


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """Run a command; what it found goes to standard output as JSON lines. 1 if something is wrong, 2 if a configuration is."""
    args = arguments().parse_args(argv)
    say = lambda **found: print(json.dumps(found, default=str))
    if args.command == "example":
        print(EXAMPLE, end="")
        return 0
    paths = args.config if isinstance(args.config, list) else [args.config]
    projects, faults = [], 0
    for path in paths:
        try:
            projects.append(Project.read(path, Path(path).stem))
        except (ConfigError, OSError, ValueError, TypeError) as e:
            faults += 1
            say(config=path, fault=str(e))
    if faults or args.command == "validate":
        return 2 if faults else 0
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "run":
        trigger = {"processingTime": args.every} if args.every else None
        ended = apply.run_all({p.name: lambda p=p: p.start(spark, trigger) for p in projects})
        for name, fault in ended.items():
            say(config=name, fault=fault)
        return int(any(ended.values()))
    project = projects[0]
    if args.command == "poll":
        say(pages=project.poll(spark, args.every))
        return 0
    store, tables = project.store(spark), project.tables(spark)
    views = [v for v in project.views if v.table == getattr(args, "table", v.table)]
    if not views:
        say(fault=f"no view of {args.table}")
        return 1
    if args.command == "load":
        for v in views:
            say(table=v.table, waves=admin.load_ranges(v, tables, store, [], 0))
    elif args.command == "status":
        found = admin.status(store, project.name, args.position)
        say(**found)
        return int(not found["caught_up"])
    elif args.command == "metrics":
        say(**store.counts(args.stream or project.name))
    elif args.command == "reconcile":
        for v in views:
            scanned, orphaned = admin.reconcile(v, tables, store, args.delete)
            say(table=v.table, scanned=scanned, orphaned=orphaned)
    elif args.command == "reload":
        for v in views:
            admin.load(v, tables, store, args.version, args.where)
    elif args.command == "reindex":
        told = admin.reindex(views[0], tables, store, args.alias, args.drop_old)
        say(verdict=told, index=store.named(args.alias))
        return int(told == "mismatch")
    elif args.command == "alias":
        store.name(args.alias, args.index)
    elif args.command == "rejects":
        if args.retry:
            store.retry_rejects()
        rows, total = store.newest_rejects(args.limit)
        for r in rows.select("reject_id", "index", "id", "version", "reject").collect():
            say(**r.asDict())
        say(total=total)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
