"""``python -m keyloom INPUT OUTPUT [N]``: report the minimal keys of a text table.

Run it with ``spark-submit`` on a cluster; the session's settings apply.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from keyloom.plans.discover import minimal_keys
from keyloom.sources import delimited, report

LAYOUTS = {
    "comma": delimited.read_comma,
    "tab": delimited.read_tab,
    "person": delimited.read_fixed,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = argparse.ArgumentParser(prog="keyloom")
    args.add_argument("input")
    args.add_argument("output")
    args.add_argument("n_columns", nargs="?", type=int, default=-1, help="leftmost columns to use, -1 for all")
    args.add_argument("--layout", choices=LAYOUTS, default="comma")
    args.add_argument("--tolerance", type=int, default=0, help="rows that may stand in the way of a key")
    given = args.parse_args(argv)
    spark = spark or SparkSession.builder.appName("keyloom").getOrCreate()
    table = LAYOUTS[given.layout](spark, given.input).good
    keys = minimal_keys(delimited.first_n_columns(table, given.n_columns), given.tolerance)
    report.save_report(keys, given.output)


if __name__ == "__main__":
    main()
