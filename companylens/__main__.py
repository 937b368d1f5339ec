"""Batch job that runs the pipeline and its export; ``run.py`` starts it for spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from companylens.schema import DEFAULT_RANKING_SIZE
from companylens.sinks.export import run_and_export
from companylens.sources.companies import SOURCES


def build_argument_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="companylens")
    parser.add_argument("--source", choices=SOURCES, default="synthetic")
    parser.add_argument("--path", required=True, help="input file or folder")
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    parser.add_argument("--output", required=True, help="export folder")
    parser.add_argument("--ranking-size", type=int, default=DEFAULT_RANKING_SIZE)
    parser.add_argument("--public-root", default=None, help="folder closed to private sources")
    parser.add_argument(
        "--allow-private-public-export",
        action="store_true",
        help="write private results without a folder to stay out of, or into it",
    )
    parser.add_argument("--no-overwrite", action="store_true")
    return parser


def main(arguments: list[str] | None = None) -> None:
    options = build_argument_parser().parse_args(arguments)
    spark = SparkSession.builder.appName("companylens").getOrCreate()
    result, export = run_and_export(
        spark,
        options.source,
        options.path,
        options.output,
        options.format,
        options.ranking_size,
        public_root=options.public_root,
        allow_private_public_export=options.allow_private_public_export,
        overwrite=not options.no_overwrite,
    )
    print(f"{result.row_count:,} records, {export.artifact_count} artifacts in {export.directory}")


if __name__ == "__main__":
    main()
