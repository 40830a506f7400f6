"""Command line: index a folder into generations, search it, show its status."""

from __future__ import annotations

import argparse

from .api import Corpus, SearchRequest
from .operators.manifest import Generations
from .session import local_session
from .sources import prepare


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gleanery")
    parser.add_argument("--home", required=True, help="folder of the generations")
    actions = parser.add_subparsers(dest="action", required=True)
    index = actions.add_parser("index")
    index.add_argument("vault")
    index.add_argument("folder")
    find = actions.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=20)
    find.add_argument("--path-prefix")
    actions.add_parser("status")
    args = parser.parse_args(argv)
    spark = local_session("*", 8)
    kept = Generations(spark, args.home)
    if args.action == "index":
        sources = prepare.prepare(prepare.read_tree(spark, args.folder, args.vault)).cache()
        print(kept.publish_index(sources, prepare.chunks(sources)))
    elif args.action == "search":
        Corpus(read=kept.reader()).search(SearchRequest(args.query, limit=args.limit, path_prefix=args.path_prefix)).orderBy("rank").show(args.limit, False)
    else:
        Corpus(kept.read("chunks")).status(kept.read("sources")).show(truncate=False)


if __name__ == "__main__":
    main()
