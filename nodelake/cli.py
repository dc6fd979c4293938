"""Command line: init, index, search, status, forget, config."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import SparkSession

from . import api, config
from .errors import InvalidGitRepositoryError, RepoExistsError, RepoNotFoundError
from .operators.store import Store
from .service import Repo, preview

VERSION = "0.1.0"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nodelake")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--verbose", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("path", nargs="?", default=".")
    index = commands.add_parser("index")
    index.add_argument("name")
    index.add_argument("--full", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("name")
    search.add_argument("--limit", type=int, default=10)
    commands.add_parser("status")
    commands.add_parser("forget").add_argument("name")
    commands.add_parser("serve", help="answer a tool client on standard input and output")
    settings = commands.add_parser("config").add_subparsers(dest="action", required=True)
    settings.add_parser("show")
    settings.add_parser("init").add_argument("--force", action="store_true")
    settings.add_parser("edit")
    settings.add_parser("path")
    return p


def _store(args) -> Store:
    spark = SparkSession.builder.appName("nodelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not args.verbose:
        spark.sparkContext.setLogLevel("ERROR")
    return Store.connect(spark, config.Settings.load().store)


def main(argv: list[str] | None = None, store: Store | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _run(args, store)
    except (RepoNotFoundError, RepoExistsError, InvalidGitRepositoryError) as e:
        print(e, file=sys.stderr)
        return 1


def _run(args, store: Store | None) -> int:
    if args.command == "init":
        print(f"{(r := Repo.init(args.path)).name}: {r.path}")
    elif args.command == "config":
        path = config.config_dir() / "config.toml"
        if args.action == "path":
            print(path)
        elif args.action == "show":
            print(path.read_text() if path.exists() else config.to_toml(config.asdict(config.Settings.load())))
        elif args.action == "init":
            if path.exists() and not args.force:
                print(f"{path} exists", file=sys.stderr)
                return 1
            print(config.Settings().save())
        else:
            path = path if path.exists() else config.Settings().save()
            return subprocess.call([os.environ.get("EDITOR", "vi"), str(path)])
    elif args.command == "index":
        r = Repo.get(args.name).index(store or _store(args), args.full)
        done = r.files_synced or r.nodes_deleted
        print(f"checked {r.files_checked}, synced {len(r.files_synced)}, deleted {r.nodes_deleted}, skipped {r.skipped_files}" if done else "up to date")
        for e in r.errors:
            print(e, file=sys.stderr)
    elif args.command == "search":
        for h in Repo.get(args.name).search(store or _store(args), args.query, args.limit).collect():
            print(f"{h['score']:.4f}  {h['file_path']}:{h['start_line']}  {h['node_type']} {h['node_name']}  {preview(h['content'])}")
    elif args.command == "status":
        store = store or _store(args)
        for repo in Repo.list():
            print("  ".join(f"{k}: {v}" for k, v in repo.status(store).items()))
    elif args.command == "serve":
        api.serve(store or _store(args), sys.stdin, sys.stdout)
    else:
        Repo.remove(args.name, store or _store(args))
        print(f"forgot {args.name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
