"""Command lines of the jobs: values come from a small JSON file and may be overridden."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def main(run: Callable, name: str, paths: list[str], numbers: list[str]) -> None:
    """Reads the arguments, runs the job in a session of its own and stops that."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")))
    for key in paths:
        parser.add_argument(f"--{key}")
    for key in numbers:
        parser.add_argument(f"--{key.replace('_', '-')}", type=int)
    given = vars(parser.parse_args())
    values = json.loads(Path(given.pop("config")).read_text()) | {k: v for k, v in given.items() if v is not None}
    if missing := [k for k in paths if not values.get(k)]:
        parser.error(f"no value for {', '.join(missing)}, neither in the file nor on the command line")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **{k: values[k] for k in [*paths, *numbers] if k in values})
    finally:
        spark.stop()
