"""Command line: index, watch, search, eval, compare and collections."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from siltstone import report
from siltstone.operators import evaluate
from siltstone.operators.store import Store
from siltstone.plans import evaluation, index, search
from siltstone.session import local_session, scratch, ship_package
from siltstone.sources import config, golden
from siltstone.sources.repo import RepoSource
from siltstone.streaming import watch

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    p.add_argument("--store", default="siltstone-store", help="folder of the collections")
    p.add_argument("--collection", default="code_chunks")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="bring a collection up to date with a folder")
    a.add_argument("repo")
    a.add_argument("--languages", help="list with commas")
    a.add_argument("--config")
    a.add_argument("--watch", action="store_true", help="go on with every change")
    a = sub.add_parser("search", help="ranked chunks for a question")
    a.add_argument("query")
    a.add_argument("--mode")
    a.add_argument("--limit", type=int, default=5)
    a.add_argument("--languages")
    a.add_argument("--repos")
    a.add_argument("--answer", action="store_true", help="print the prompt's answer by the stand-in model, too")
    a.add_argument("--answer-limit", type=int, default=5)
    a = sub.add_parser("eval", help="metrics over golden queries in YAML")
    a.add_argument("dataset")
    a.add_argument("--mode")
    a.add_argument("--limit", type=int, default=10)
    a.add_argument("--type")
    a.add_argument("--subtype")
    a.add_argument("--json", action="store_true")
    a.add_argument("--answer", action="store_true", help="score answers of the stand-in model, too")
    a.add_argument("--answer-limit", type=int, default=5)
    a = sub.add_parser("compare", help="reports of eval --json side by side, with changes against the first")
    a.add_argument("reports", nargs="+")
    a.add_argument("--labels", help="list with commas; the files' names if not given")
    a = sub.add_parser("collections", help="list or delete collections")
    a.add_argument("action", choices=["list", "delete"])
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command in ("search", "eval"):
        search.mode_of(args.mode)
        search.limit_of(args.limit, 10 if args.command == "eval" else 1)
    spark = local_session(os.environ.get("SILTSTONE_CORES", "*"))
    ship_package(spark)
    store = Store(spark, os.path.abspath(args.store))
    if args.command == "compare":
        labels = search.listed(args.labels) or [os.path.splitext(os.path.basename(p))[0] for p in args.reports]
        if len(labels) != len(args.reports):
            raise ValueError(f"{len(labels)} labels for {len(args.reports)} reports")
        print(report.comparison(evaluate.comparison(golden.reports(spark, [os.path.abspath(p) for p in args.reports])).collect(), labels))
        return 0
    if args.command == "collections":
        if args.action == "list":
            print("\n".join(store.names()))
        else:
            store.delete(args.collection)
        return 0
    if args.command == "index":
        root = os.path.abspath(args.repo)
        settings = config.load(args.config)
        languages = search.listed(args.languages) or None

        def run() -> None:
            files = index.scan(spark, root, os.path.basename(root), settings, languages)
            print(index.run(spark, store, args.collection, files, languages=languages, repos=[os.path.basename(root)]))

        run()
        if args.watch:
            spark.dataSource.register(RepoSource)
            changes = spark.readStream.format("repo").option("mode", "changes").option("state", os.path.join(os.path.abspath(args.store), ".listings")).option("skip_dirs", ",".join(settings.skip_dirs)).load(root)
            watch.follow(changes, run, os.path.join(os.path.abspath(args.store), ".watch"), settings).awaitTermination()
        return 0
    with scratch(spark):
        return _ask(args, spark, store)


def _ask(args: argparse.Namespace, spark: SparkSession, store: Store) -> int:
    """The commands that search: their results are printed before their steps are removed."""
    request = search.Request(search.mode_of(args.mode), args.limit, tuple(search.listed(getattr(args, "languages", None))), tuple(search.listed(getattr(args, "repos", None))))
    if args.command == "search":
        asked = spark.createDataFrame([("q", args.query)], "query_id string, query string")
        found = search.search(spark, store, args.collection, asked, request).cache()
        print(report.results(found.collect()))
        if args.answer:
            print(search.generate(search.prompts(found, asked, args.answer_limit), search.echo).first()["text"])
        return 0
    queries = golden.load(spark, args.dataset, args.type, args.subtype)
    done = evaluation.run(spark, store, args.collection, queries, request, args.dataset, model=search.echo if args.answer else None, generator="echo", answer_limit=args.answer_limit)
    print(report.as_json(done) if args.json else report.evaluation(done))
    return 1 if done["aggregate"]["errors"] else 0


if __name__ == "__main__":
    sys.exit(main())
