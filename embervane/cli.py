"""Command line: ``python -m embervane.cli init|index|search``."""

from __future__ import annotations

import argparse
import sys

from .errors import EmbervaneError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="embervane")
    out.add_argument("--data-dir", default=".embervane", help="folder of the store")
    commands = out.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="create the store and remember the model folder")
    init.add_argument("--model-dir")
    index = commands.add_parser("index", help="index the .md and .txt files of a folder, or one file")
    index.add_argument("path")
    index.add_argument("--model-dir")
    index.add_argument("--flat", action="store_true", help="without folders inside")
    search = commands.add_parser("search", help="find the chunks nearest to a text")
    search.add_argument("query")
    search.add_argument("--model-dir")
    search.add_argument("--top-k", type=int, default=5)
    return out


def run(args: argparse.Namespace, spark=None) -> list[str]:
    """The lines that a command prints."""
    from pyspark.sql import SparkSession

    from .operators.embed import Embedder
    from .plans import index as plan
    from .sources.store import ChunkStore

    spark = spark or SparkSession.builder.appName("embervane").getOrCreate()
    store = ChunkStore(spark, args.data_dir)
    if args.command == "init":
        store.init()
        if args.model_dir:
            store.set_meta(plan.MODEL_KEY, plan.validate_model_dir(args.model_dir))
        return [f"initialised {args.data_dir}"]
    model = Embedder.load(plan.resolve_model_dir(store, args.model_dir))
    if args.command == "index":
        store.init()
        return [f"indexed {plan.index_directory(spark, args.path, store, model, not args.flat)} chunks"]
    return plan.display(plan.search_store(store, args.query, model, args.top_k))


def main(argv: list[str] | None = None) -> int:
    try:
        print("\n".join(run(parser().parse_args(argv))))
    except EmbervaneError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
