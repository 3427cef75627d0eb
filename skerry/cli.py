"""Command line: index, search, status, and the list of indexes under a folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from skerry import __version__
from skerry.config import load
from skerry.engine import Engine, default_index, forget, index_folder, indexes


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skerry")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--store", help="folder of the index; with --home the one of the folder indexed, else the first")
    p.add_argument("--home", help="folder of all indexes")
    p.add_argument("--config", action="append", default=[])
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("folder")
    i.add_argument("--full", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("folder")
    s.add_argument("query")
    s.add_argument("--mode", default="hybrid")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--prf", action="store_true")
    t = sub.add_parser("status")
    t.add_argument("folder")
    sub.add_parser("list")
    f = sub.add_parser("forget")
    f.add_argument("folder")
    a = p.parse_args(argv)
    if not (a.home if a.command in ("list", "forget") else a.store or a.home):
        p.error("--home is needed" if a.command in ("list", "forget") else "--store or --home is needed")
    spark = SparkSession.builder.appName("skerry").getOrCreate()
    if a.command == "list":
        print(json.dumps(indexes(spark, a.home)))
        return 0
    if a.command == "forget":
        return 0 if forget(spark, a.home, a.folder) else 1
    mine = index_folder(a.home, a.folder) if a.home else None
    store = a.store or (mine if a.command == "index" else default_index(spark, a.home, a.folder) or mine)
    engine = Engine(spark, a.folder, store, load(*a.config))
    if a.command == "index":
        print(json.dumps(engine.reindex(a.full)))
    elif a.command == "status":
        print(json.dumps(engine.status()))
    else:
        for r in engine.search(a.mode, a.query, a.k, a.prf).orderBy("rank").collect():  # k rows
            print(f"{r.rank}. {r.path} [{r.score:.4f}] {r.snippet}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
