"""driftsieve: ingest, withdraw and stats on the command line; JSON on standard output."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import sys

from pyspark.sql import SparkSession

from driftsieve.plans.engine import Sieve


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftsieve", description=__doc__)
    p.add_argument("--state-dir", required=True)
    p.add_argument("--master", help="Spark's master; by default as Spark is set up")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="take in a release")
    ingest.add_argument("inputs", nargs="+")
    ingest.add_argument("--dataset", required=True)
    ingest.add_argument("--output-dir", required=True)
    ingest.add_argument("--text-column")
    withdraw = sub.add_parser("withdraw", help="forget a release")
    withdraw.add_argument("--dataset", required=True)
    withdraw.add_argument("--purge-outputs", action="store_true")
    sub.add_parser("stats", help="what the index holds")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING, stream=sys.stderr)
    if spark is None:
        builder = SparkSession.builder.appName("driftsieve")
        spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    sieve = Sieve(spark, a.state_dir)
    if a.command == "ingest":
        out = dataclasses.asdict(sieve.ingest(a.inputs, a.dataset, a.output_dir, a.text_column))
    elif a.command == "withdraw":
        out = dataclasses.asdict(sieve.withdraw(a.dataset, a.purge_outputs))
    else:
        out = sieve.stats()
    print(json.dumps(out, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
