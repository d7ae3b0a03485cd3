"""python -m cloakframe run POLICY INPUT OUTPUT"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .sources import mask_file


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cloakframe", description="Masks personal data in tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="apply a YAML or TOML policy to a table and write Parquet")
    run.add_argument("config")
    run.add_argument("input")
    run.add_argument("output")
    run.add_argument("--single-file", action="store_true", help="write one file within the output folder")
    given = parser.parse_args(args)
    for what, path in (("config", given.config), ("input", given.input)):
        if "://" not in path and not Path(path).exists():
            print(f"error: no {what} {path}", file=sys.stderr)
            return 1
    try:
        spark = SparkSession.builder.appName("cloakframe").getOrCreate()
        rows = mask_file(spark, given.config, given.input, given.output, given.single_file)
    except Exception as e:  # the user gets a message, whatever went wrong
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"wrote {rows} rows to {given.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
