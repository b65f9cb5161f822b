"""Command line: python -m textloom merge|build."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from textloom.plans.build import BuildConfig, build, merge_crawl
from textloom.session import get_session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="textloom")
    commands = out.add_subparsers(dest="command", required=True)
    merge = commands.add_parser("merge", help="add a crawl to the merged tables of a folder")
    merge.add_argument("--folder", required=True)
    merge.add_argument("--crawl", required=True)
    make = commands.add_parser("build", help="clean and chunk merged tables, and verify what was written")
    make.add_argument("--input-dir", required=True)
    make.add_argument("--output-dir", required=True)
    make.add_argument("--max-chars", type=int, default=900)
    make.add_argument("--overlap-chars", type=int, default=120)
    make.add_argument("--with-files", action="store_true", help="take texts of documents without chunks from files")
    return out


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    spark = get_session()
    if given.command == "merge":
        merge_crawl(spark, given.folder, given.crawl, datetime.now(UTC).isoformat(timespec="seconds"))
    else:
        build(spark, BuildConfig(given.input_dir, given.output_dir, given.max_chars, given.overlap_chars), given.with_files)


if __name__ == "__main__":
    main()
