"""Command line: ``python -m sluice export OUT [filters]``; exit 0 written, 1 the file exists, 2 any other error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sluice import api
from sluice.settings import Settings
from sluice.sources.warehouse import Warehouse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice")
    p.add_argument("command", choices=["export"])
    p.add_argument("output")
    p.add_argument("--warehouse", default=Settings.from_env().warehouse)
    for name, kind in (("source", str), ("location", str), ("posted-within-days", int), ("exp-min", int), ("exp-max", int), ("run-id", str)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args(argv)
    filters = {k: getattr(a, k) for k in ("source", "location", "posted_within_days", "exp_min", "exp_max")}
    try:
        path, n = api.export_jobs(Warehouse(SparkSession.builder.getOrCreate(), a.warehouse), a.output, a.overwrite, a.run_id, **filters)
    except FileExistsError as e:
        print(f"exists: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # the exit code tells the caller
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(f"{path}: {n} jobs can be exported")
    return 0


if __name__ == "__main__":
    sys.exit(main())
