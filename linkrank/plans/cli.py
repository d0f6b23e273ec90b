"""Command line: ``python -m linkrank.plans.cli run --raw DIR --processed DIR --results DIR``."""

from __future__ import annotations

import argparse
import sys

from ..config import Layout, Params
from ..session import session
from ..sources import files, sqldump, xmldump
from .pipeline import Run


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="linkrank")
    common = argparse.ArgumentParser(add_help=False)
    for folder in ("raw", "processed", "results"):
        common.add_argument(f"--{folder}", required=True)
    common.add_argument("--force", action="store_true", help="build tables that are complete, too")
    common.add_argument("--compression", choices=("snappy", "zstd", "none"), default="snappy")
    common.add_argument("--chunk-size", type=int, default=0, help="most rows in a file, 0: no bound")
    common.add_argument("--resume", action="store_true", help="dumps are in several files, of which those that are done are passed over")
    common.add_argument("--prefix", default="", help="what the names of raw files begin with")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", parents=[common], help="all stages, or some")
    run.add_argument("--stage", action="append", choices=Run.STAGES, default=[])
    ingest = commands.add_parser("ingest", parents=[common], help="dumps to tables")
    ingest.add_argument("--table", choices=tuple(sqldump.DUMPS))
    extract = commands.add_parser("extract", parents=[common], help="articles from the XML dump")
    for sub in (run, extract):
        sub.add_argument("--limit", type=int, default=0, help="0: no limit")
        sub.add_argument("--min-articles", type=int, default=xmldump.MIN_ARTICLES, help="articles that make up for malformed pages")
        sub.add_argument("--strict-xml", action="store_true")
        sub.add_argument("--exact-text", action="store_true", help="clean markup by a Pandas UDF")
    for sub in (run,):
        sub.add_argument("--group-size", type=int, default=Params.group_size)
        sub.add_argument("--shingle-size", type=int, default=Params.shingle_size)
        sub.add_argument("--permutations", type=int, default=Params.permutations)
    adopt = commands.add_parser("adopt", help="mark a table that is there as complete")
    adopt.add_argument("path")
    adopt.add_argument("--min-rows", type=int, default=xmldump.MIN_ARTICLES)
    check = commands.add_parser("verify", help="compare files with a SHA-1 manifest")
    check.add_argument("files")
    check.add_argument("manifest")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    if args.command == "adopt":
        print(files.adopt(spark, args.path, args.min_rows))
        return 0
    if args.command == "verify":
        for row in files.verified(spark, args.files, files.read_manifest(spark, args.manifest)).orderBy("file").toLocalIterator():
            print(row["status"], row["file"])
        return 0
    sizes = {k: getattr(args, k) for k in ("group_size", "shingle_size", "permutations") if hasattr(args, k)}
    made = Run(
        spark, Layout(args.raw, args.processed, args.results), Params(**sizes), force=args.force, exact_text=getattr(args, "exact_text", False), strict_xml=getattr(args, "strict_xml", False),
        limit=getattr(args, "limit", 0) or None, min_articles=getattr(args, "min_articles", xmldump.MIN_ARTICLES), resume=args.resume, compression=args.compression, rows_per_file=args.chunk_size, prefix=args.prefix)
    if args.command == "ingest":
        made.ingest(args.table)
    elif args.command == "extract":
        made.extract()
    else:
        for name, seconds in made.run(*args.stage).items():
            print(f"{name} {seconds:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
