"""``python -m tracequarry -a CONFIG``: runs the steps of a configuration and shows their results."""

from __future__ import annotations

import argparse

from tracequarry.plans.pipeline import run
from tracequarry.session import session
from tracequarry.sources.config import read_config


def main() -> None:
    parser = argparse.ArgumentParser(prog="tracequarry")
    parser.add_argument("-a", "--algorithm-configs", required=True, help="a JSON list of steps")
    parser.add_argument("--master", help="the Spark master, unless spark-submit sets it")
    args = parser.parse_args()
    spark = session(args.master)
    for name, result in run(spark, read_config(args.algorithm_configs, spark)):
        for key, table in (result if isinstance(result, dict) else {"": result}).items():
            print(name, key)
            table.show(20, truncate=False)


if __name__ == "__main__":
    main()
