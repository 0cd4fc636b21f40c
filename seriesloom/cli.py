"""Run registered queries and write them as a report bundle.

python -m seriesloom.cli report TABLES OUTPUT [QUERY ...]; python -m seriesloom.cli stage NAME TABLES OUTPUT; python -m seriesloom.cli config FILE
"""

from __future__ import annotations

import argparse
import logging
import subprocess

from pyspark.sql import SparkSession

from .config import STAGES, load
from .plans.registry import all_queries
from .settings import using
from .sources.files import manifest, write_bundle

log = logging.getLogger("seriesloom")


def commit() -> str:
    """The commit of the working folder, if it is one."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return ""


def report(spark: SparkSession, tables: str, output: str, names: list[str], stage: str = "report", fmt: str = "parquet", settings: dict | None = None) -> None:
    """The named queries as one bundle, with a manifest that says what ran."""
    known = all_queries()
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"no such queries: {unknown}")
    log.info("%s: %d queries over %s", stage, len(names), tables)
    with using(settings or {}):  # plans are made here, so the settings are in them
        sheets = {n: known[n](spark, tables) for n in names}
    write_bundle(sheets, output, {n: (known[n].__doc__ or "") for n in names}, fmt)
    manifest(spark, f"{output}/manifest", stage, {"tables": tables, "queries": names, "settings": settings or {}}, n_queries=len(names), commit=commit())
    log.info("%s: written to %s", stage, output)


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    kinds = parser.add_subparsers(dest="kind", required=True)
    one = kinds.add_parser("report", help="some or all queries")
    one.add_argument("tables"), one.add_argument("output"), one.add_argument("queries", nargs="*")
    one = kinds.add_parser("stage", help="the queries of a stage")
    one.add_argument("name", choices=sorted(STAGES)), one.add_argument("tables"), one.add_argument("output")
    one = kinds.add_parser("config", help="a stage's YAML file")
    one.add_argument("file")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("seriesloom").getOrCreate()
    if args.kind == "report":
        report(spark, args.tables, args.output, args.queries or list(all_queries()), fmt=args.format)
    elif args.kind == "stage":
        report(spark, args.tables, args.output, list(STAGES[args.name][0]), args.name, args.format, STAGES[args.name][1])
    else:
        c = load(args.file)
        report(spark, c.tables, c.output, list(c.queries), c.stage or "report", c.format, c.given())


if __name__ == "__main__":
    main()
