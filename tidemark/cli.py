"""Command line: ``data publish|list|validate``, ``runs list|compare``, ``query``."""

from __future__ import annotations

import argparse
import json


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    verbs = top.add_subparsers(dest="verb", required=True)
    data = verbs.add_parser("data").add_subparsers(dest="what", required=True)
    publish = data.add_parser("publish")
    publish.add_argument("source")
    publish.add_argument("root")
    publish.add_argument("name")
    data.add_parser("list").add_argument("root")
    data.add_parser("validate").add_argument("path")
    runs = verbs.add_parser("runs").add_subparsers(dest="what", required=True)
    runs.add_parser("list").add_argument("store")
    compare = runs.add_parser("compare")
    compare.add_argument("store")
    compare.add_argument("run", nargs="+")
    query = verbs.add_parser("query")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "data":
        from tidemark.sources.connectors import read_directory
        from tidemark.sources.snapshot import Snapshot, list_snapshots, publish

        if args.what == "list":
            print("\n".join(list_snapshots(args.root)))
        elif args.what == "validate":
            print(json.dumps(Snapshot(session(), args.path, verify=True).manifest["tables"], sort_keys=True))
        else:
            spark = session()
            print(publish(spark, read_directory(spark, args.source), args.root, args.name).path)
    elif args.verb == "runs":
        from tidemark.operators.search import Store

        store = Store(args.store)
        if args.what == "list":
            for row in store.db.execute("select id, kind, status from runs order by id"):
                print("\t".join(row))
        else:
            print(json.dumps(store.compare(args.run), sort_keys=True))
    else:
        from tidemark.plans.catalog import QUERIES

        QUERIES[args.name](session(), args.folder).write.parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
