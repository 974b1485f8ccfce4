"""python -m tallyframe PATH --out DIR [--view NAME ...] [--format json|parquet]: views of all programs under PATH.

Exit codes: 0 done, 1 failed, 2 wrong use.
"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .api import VIEWS, analyze_path

    parser = argparse.ArgumentParser(prog="tallyframe", description="Views of all programs under a path.")
    parser.add_argument("path")
    parser.add_argument("--out", required=True)
    parser.add_argument("--view", action="append", choices=sorted(VIEWS))
    parser.add_argument("--format", default="json", choices=("json", "parquet"))
    options = parser.parse_args(args)
    try:
        analyze_path(SparkSession.builder.getOrCreate(), options.path).write(options.out, options.view, options.format)
    except Exception as e:  # noqa: BLE001
        print(f"tallyframe: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
